"""Headers with nested maps and lists, whole corpora, bad files as rows."""

import json

import pytest

from talegraph.catalog import rel_dim
from talegraph.sources import corpus

TEXT = """---
# a comment
id: scene/key
title: "The: Key"
aliases: [old key, 'the, one']
tags:
- a
- "#b"
edges:
  - rel: occurs_at
    to: location/l
  - present_at: character/c
  - causes: scene/two
props:
  word_count: 120
  ratio: -.5
  open: true
  none:
  claims:
    - speaker: character/c
      fact: fact/f
    - {speaker: character/d, fact: "fact/g"}
  deep:
    list:
      -
        - 1
        - x
      - []
features: {mood: [calm, 2], n: {m: null}}
visible_to:
  - reader
  - viewer: character/c
    learned_at: 3
story_from: 4
reveal_at: 9
locked: true
---
# Heading

First  line.
"""


def test_nested_header():
    head = corpus.parse_header(TEXT.split("---\n")[1])
    assert head["title"] == "The: Key" and head["aliases"] == ["old key", "the, one"] and head["tags"] == ["a", "#b"]
    assert head["props"] == {"word_count": 120, "ratio": -0.5, "open": True, "none": None, "claims": [{"speaker": "character/c", "fact": "fact/f"}, {"speaker": "character/d", "fact": "fact/g"}], "deep": {"list": [[1, "x"], []]}}
    assert head["features"] == {"mood": ["calm", 2], "n": {"m": None}} and head["visible_to"] == ["reader", {"viewer": "character/c", "learned_at": 3}]
    assert corpus.parse_header("") == {} and corpus.parse_header("a:\nb: 1") == {"a": None, "b": 1}


@pytest.mark.parametrize("bad", ["a: 1\n   b: 2", "a: [1, 2", "a: {1}", "just text", "a: 1\na: 2", "\ta: 1", "- a\n- b", "a: [1] 2", "a:\n    b: 1\n  c: 2"])
def test_bad_headers(bad):
    with pytest.raises(corpus.HeaderError):
        corpus.parse_header(bad)


def test_whole_corpus(spark, tmp_path):
    files = {
        "scenes/key.md": TEXT, "scenes/two.md": "---\nid: scene/two\nedges: [{rel: causes, to: scene/key}, {rel: no_such, to: scene/key}]\n---\nBody", "locations/l.md": "# L\r\ntext\r\n", "characters/c.md": "\n",
        "scenes/open.md": "---\ntitle: x\nno end", "scenes/edge.md": "---\nedges: [1]\n---\n", "scenes/when.md": "---\nstory_from: soon\n---\n", "scenes/README.md": "not read", "scenes/again.md": "---\nid: scene/two\n---\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "scenes/bytes.md").write_bytes(b"\xff\xfe")
    parsed = corpus.read_frontmatter_corpus(spark, str(tmp_path)).cache()
    rows = {r.path.split("/")[-1]: r for r in parsed.collect()}
    assert len(rows) == 9
    key = rows["key.md"]
    assert (key.id, key.kind, key.summary, key.story_from, key.story_to, key.reveal_at, key.locked) == ("scene/key", "Scene", "First line.", 4, None, 9, True)
    assert json.loads(key.props)["word_count"] == 120 and json.loads(key.visible_to)[1]["learned_at"] == 3 and json.loads(key.features)["mood"] == ["calm", 2]
    assert (rows["l.md"].id, rows["l.md"].title, rows["c.md"].id) == ("location/L", "L", "character/c")
    assert {n: r.error for n, r in rows.items() if r.error} == {"open.md": "the header is not closed", "edge.md": "an edge has a relation and an end", "when.md": "story_from is a whole number", "bytes.md": "not UTF-8"}
    rels = rel_dim(spark)
    edges, aliases, tags = corpus.loaded_tables(parsed, rels)
    assert {(e.src, e.rel, e.dst) for e in edges.collect()} == {("scene/key", "occurs_at", "location/l"), ("scene/key", "present_at", "character/c"), ("scene/key", "causes", "scene/two"), ("scene/two", "causes", "scene/key"), ("scene/two", "no_such", "scene/key")}
    assert {a.alias for a in aliases.collect()} == {"old key", "the, one"} and {t.tag for t in tags.collect()} == {"#a", "#b"}
    problems = {(r.at.split("/")[-1] if r.at.endswith(".md") else r.at, r.problem) for r in corpus.load_problems(parsed, rels).collect()}
    assert problems == {(n, r.error) for n, r in rows.items() if r.error} | {
        ("scene/two", "id comes twice"), ("scene/key occurs_at location/l", "end is not there"), ("scene/two no_such scene/key", "unknown relation"), ("causes scene/key", "on a cycle"), ("causes scene/two", "on a cycle"),
    }


def test_snapshots_and_vectors(spark, tmp_path):
    """A snapshot is there whole or not at all, the newest is read; vectors follow content id, text and model."""
    folder = f"{tmp_path}/snap"
    nodes = spark.createDataFrame([("a", 1), ("b", 1)], "id string, rev int")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    docs = spark.createDataFrame([("a", "c1", "x", True), ("b", "c2", "y", True), ("d", "c3", "z", False)], "id string, cid string, text string, live boolean")
    none = spark.createDataFrame([], "id string, hash string")
    first = corpus.consolidate(docs, none, {"node": nodes, "edge": edges}, folder, 1)
    assert {(r.id, r.action) for r in first.collect()} == {("a", "index"), ("b", "index")}
    later = spark.createDataFrame([("a", 2)], "id string, rev int")
    (tmp_path / "snap" / "v=3").mkdir(parents=True)  # begun and never ended
    corpus.write_snapshot({"node": later, "edge": edges}, folder, 2)
    back = corpus.read_snapshot(spark, folder)
    assert set(back) == {"node", "edge"} and [(r.id, r.rev) for r in back["node"].collect()] == [("a", 2)] and back["edge"].count() == 1
    old = first.select("id", "hash").cache()
    changed = spark.createDataFrame([("a", "c9", "x", True), ("b", "c2", "y", True), ("d", "c3", "z", True)], docs.schema)
    assert {r.id: r.action for r in corpus.sync_vectors(changed, old).collect()} == {"a": "index", "b": "keep", "d": "index"}
    assert {r.id: r.action for r in corpus.sync_vectors(docs.where("id = 'a'"), old, "another").collect()} == {"a": "index", "b": "remove"}


def test_manifests_beside_chapters(spark, tmp_path):
    (tmp_path / "one.md").write_text("text")
    (tmp_path / "two.md").write_text("more")
    (tmp_path / "one.story.json").write_text(json.dumps({"schema_version": 1, "source_sha256": "x", "unresolved": [], "nodes": [{"id": "scene/a", "kind": "Scene", "title": "A", "start_off": 0, "end_off": 4, "quote": "text"}], "edges": []}))
    rows = {r.file: r for r in corpus.read_manifests(spark, str(tmp_path)).collect()}
    assert rows["one"].manifest.nodes[0].id == "scene/a" and bytes(rows["one"].content) == b"text" and rows["two"].manifest is None
