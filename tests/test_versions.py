"""Content as of a revision, and the hash tree of a graph."""

import json

from test_commit import _at, _run, graph

from talegraph.operators import editlog, versions


def test_content_as_of(spark):
    nodes = [("character/a", {"x": "0"}, False, 1, False), ("character/b", {}, False, 1, False), ("character/c", {}, False, 1, False)]
    ops = [
        ("p1", 0, "UPDATE", "character/a", "props.x", None, "1", "k1"), ("p2", 0, "UPDATE", "character/a", "title", None, "T", "k2"), ("p3", 0, "UPDATE", "character/a", "props.x", None, "2", "k3"),
        ("p4", 0, "LINK", "character/a", "related", None, "character/b", "k4"), ("p5", 0, "UPDATE", "character/a", "props.x", None, "1", "k5"), ("p6", 0, "INVALIDATE", "character/b", None, None, None, "k6"),
    ]
    got = _run(spark, nodes, [("character/c", "related", "character/a")], ops, [], [(o[0], _at(i)) for i, o in enumerate(ops)])
    v = versions.versions_of(got, got.revisions.sparkSession.createDataFrame(ops, "proposal string, seq int, verb string, target string, field string, from_val string, to_val string, idem_key string"))
    base = versions.base_value(graph(spark, nodes, [("character/c", "related", "character/a")]), v.select("node", "field").distinct())
    reads = spark.createDataFrame([("r1", "character/a", 1), ("r2", "character/a", 2), ("r4", "character/a", 4), ("r6", "character/a", 6), ("r9", "character/a", 9), ("rb", "character/b", 1), ("rc", "character/c", 1)], "reader string, node string, rev int")
    out = {(r.reader, r.field): (r.then, r.now) for r in versions.asof_content(reads, v, base).collect()}
    assert out["r1", "props.x"] == ("0", "1") and out["r2", "props.x"] == ("1", "1") and out["r4", "props.x"] == ("2", "1")
    assert out["r1", "title"] == ("t character/a", "T") and ("r4", "title") not in out
    assert out["r4", "edge:related:character/b"] == (None, "open") and out["r6", "edge:*:character/b"] == (None, "closed")
    assert out["rb", "$invalidate"] == (None, "gone") and not [k for k in out if k[0] in ("r9", "rc")]
    since = {r.reader: r.fields for r in versions.changed_since(reads, v, base).collect()}
    # what came back to its value did not change, nor does a title count
    assert since == {"r1": ["edge:*:character/b", "edge:related:character/b", "props.x"], "r2": ["edge:*:character/b", "edge:related:character/b"], "r4": ["edge:*:character/b", "edge:related:character/b", "props.x"], "r6": ["edge:*:character/b"], "rb": ["$invalidate"]}


def test_root_by_update_is_root_from_scratch(spark):
    def cids(rows):
        return spark.createDataFrame(list(rows.items()), "id string, cid string")

    rows = {f"n/{i}": f"c{i}" for i in range(700)}
    leaves = editlog.root_leaves(cids(rows), 2)
    rows |= {"n/3": "new", "n/x": "added"}
    del rows["n/9"]
    changed = spark.createDataFrame([("n/3",), ("n/x",), ("n/9",)], "id string")
    after = editlog.root_update(leaves, cids(rows), changed, 2)
    assert editlog.root_of(after, 2).collect() == editlog.graph_root(cids(rows), 2).collect() != editlog.root_of(leaves, 2).collect()
    assert editlog.root_leaves(cids(rows), 2).exceptAll(after).count() == 0
    assert editlog.root_digits(1) == 1 and editlog.root_digits(16 * 1_024) == 1 and editlog.root_digits(16 * 1_024 + 1) == 2


def test_content_ids_tell_contents_apart(spark):
    """Values that hold the separators of other values."""
    one = graph(spark, [("a/x", {}, False, 1, False)], [], aliases=[("a/x", "p,q")])
    two = graph(spark, [("a/x", {}, False, 1, False)], [], aliases=[("a/x", "p"), ("a/x", "q")])
    three = graph(spark, [("a/x", {"k": json.dumps(["p"])}, False, 1, False)], [], aliases=[("a/x", "p"), ("a/x", "q")])
    assert len({editlog.content_cid(g).first().cid for g in (one, two, three)}) == 3
