"""Markdown with a front-matter header, and snapshots of the graph."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import short_text
from ..operators.traverse import on_cycles

NODE = (
    "id string, kind string, title string, summary string, aliases array<string>, tags array<string>, edges array<struct<rel: string, to: string>>, body string, error string, "
    "props string, features string, visible_to string, story_from int, story_to int, reveal_at int, locked boolean, path string"
)
_SCALAR = re.compile(r"-?\d+$|-?\d*\.\d+$")


class HeaderError(ValueError):
    """A header that is not in the form that parse_header reads."""


def _scalar(text: str):
    """A plain value: null, true, false, numbers, quoted or bare text, or a list or map written inline."""
    text = text.strip()
    if text and text[0] in "[{":
        value, rest = _inline(text)
        if rest.strip():
            raise HeaderError(f"after an inline value: {rest.strip()}")
        return value
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    if _SCALAR.match(text):
        return int(text) if text.lstrip("-").isdigit() else float(text)
    return text


def _inline(text: str):
    """[a, b] or {k: v} at the start of text, and what follows it."""
    close, out = ("]", []) if text[0] == "[" else ("}", {})
    text = text[1:].lstrip()
    while not text.startswith(close):
        key = None
        if close == "}":
            m = re.match(r"([^:{}\[\],]+):\s*", text)
            if not m:
                raise HeaderError("a key is asked for in a map")
            key, text = m[1].strip().strip("'\""), text[m.end():]
        if text and text[0] in "[{":
            value, text = _inline(text)
        else:
            m = re.match(r"\"[^\"]*\"|'[^']*'|[^,\[\]{}]*", text)
            value, text = _scalar(m[0]), text[m.end():]
        if key is None:
            out.append(value)
        else:
            out[key] = value
        text = text.lstrip()
        if text.startswith(","):
            text = text[1:].lstrip()
        elif not text.startswith(close):
            raise HeaderError("an inline list or map is not closed")
    return out, text[1:]


def _lines(text: str) -> list[tuple[int, str]]:
    """Indentation and content of each line that says something."""
    out = []
    for line in text.splitlines():
        bare = line.strip()
        if bare and not bare.startswith("#"):
            lead = line[: len(line) - len(line.lstrip())]
            if "\t" in lead:
                raise HeaderError("a tab indents a line")
            out.append((len(lead), bare))
    return out


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """Lists by dashes and maps by keys at one indentation, deeper ones inside; the value and the next line."""
    is_list = lines[at][1].startswith("- ") or lines[at][1] == "-"
    out: list | dict = [] if is_list else {}
    while at < len(lines) and lines[at][0] == indent:
        line = lines[at][1]
        if is_list != (line.startswith("- ") or line == "-"):
            break
        if is_list:
            rest = line[1:].strip()
            if re.match(r"[\w$.-]+:(\s|$)", rest):  # a map that begins on the line of its dash
                inner = indent + len(line) - len(rest)
                lines[at] = (inner, rest)
                value, at = _block(lines, at, inner)
                out.append(value)
                continue
            at += 1
            if not rest and at < len(lines) and lines[at][0] > indent:
                value, at = _block(lines, at, lines[at][0])
            else:
                value = _scalar(rest)
            out.append(value)
            continue
        m = re.match(r"([\w$.-]+|\"[^\"]+\"|'[^']+'):\s*(.*)$", line)
        if not m:
            raise HeaderError(f"neither key nor item: {line}")
        key, rest = m[1].strip("'\""), m[2]
        if key in out:
            raise HeaderError(f"a key twice: {key}")
        at += 1
        if not rest and at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
            value, at = _block(lines, at, lines[at][0])
        else:
            value = _scalar(rest)
        out[key] = value
    if at < len(lines) and lines[at][0] > indent:
        raise HeaderError(f"indented too far: {lines[at][1]}")
    return out, at


def parse_header(text: str) -> dict:
    """Maps and lists nested by indentation or written inline; comments on lines of their own."""
    lines = _lines(text)
    if not lines:
        return {}
    out, at = _block(lines, 0, lines[0][0])
    if at < len(lines) or not isinstance(out, dict):
        raise HeaderError(f"a line outside the map: {lines[min(at, len(lines) - 1)][1]}")
    return out


def _texts(value) -> list[str]:
    value = value if isinstance(value, list) else [] if value is None else [value]
    return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in value]


def _edges(value) -> list[dict]:
    """Edges as maps with rel and to, or as 'rel: to'."""
    out = []
    for e in value if isinstance(value, list) else []:
        if isinstance(e, dict) and "rel" in e and "to" in e:
            out.append({"rel": str(e["rel"]), "to": str(e["to"])})
        elif isinstance(e, dict) and len(e) == 1:
            out += [{"rel": str(k), "to": str(v)} for k, v in e.items()]
        elif isinstance(e, str) and ":" in e:
            rel, to = e.split(":", 1)
            out.append({"rel": rel.strip(), "to": to.strip()})
        else:
            raise HeaderError("an edge has a relation and an end")
    return out


def _whole(head: dict, name: str) -> int | None:
    value = head.get(name)
    if value is not None and (not isinstance(value, int) or isinstance(value, bool)):
        raise HeaderError(f"{name} is a whole number")
    return value


def _json(value, kind: type) -> str | None:
    if value is None:
        return None
    if not isinstance(value, kind):
        raise HeaderError("a map is asked for" if kind is dict else "a list is asked for")
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _parsed(path: str, content: bytes) -> tuple:
    """One row of NODE; a bad file is a row with its error and what could be read."""
    folder = path.rstrip("/").split("/")[-2] if "/" in path else ""
    stem = path.split("/")[-1].removesuffix(".md")
    guess = folder[:1].upper() + folder[1:].removesuffix("s")
    try:
        text = bytes(content).decode("utf-8").removeprefix("\ufeff").replace("\r\n", "\n")
        head = {}
        if m := re.match(r"---\n(.*?)(?:^|\n)---[ \t]*(?:\n|$)", text, re.S):
            head, text = parse_header(m[1]), text[m.end():]
        elif text.startswith("---\n"):
            raise HeaderError("the header is not closed")
        kind = str(head.get("kind") or guess)
        title = str(head.get("title") or next((x[2:].strip() for x in text.splitlines() if x.startswith("# ")), stem)).strip()
        name = re.sub(r"[/\\]", "-", re.sub(r"\s+", "", title))
        first = next((x for x in text.splitlines() if x.strip() and not x.startswith("#")), title)
        return (
            str(head.get("id") or f"{kind.lower()}/{name}"), kind, title, str(head.get("summary") or first), _texts(head.get("aliases")), _texts(head.get("tags")), _edges(head.get("edges")), text, None,
            _json(head.get("props"), dict), _json(head.get("features"), dict), _json(head.get("visible_to"), list), _whole(head, "story_from"), _whole(head, "story_to"), _whole(head, "reveal_at"), head.get("locked") if isinstance(head.get("locked"), bool) else None, path,
        )
    except (UnicodeDecodeError, HeaderError) as e:
        error = "not UTF-8" if isinstance(e, UnicodeDecodeError) else str(e)
        return (None, guess, stem, None, [], [], [], None, error, None, None, None, None, None, None, None, path)


def parse_frontmatter(files: DataFrame) -> DataFrame:
    """files (path, content binary) -> NODE columns: id, kind by folder, title by first heading, summary by first line."""
    names = [c.split(":")[0].split(" ")[0] for c in re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", NODE).split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pd.DataFrame([_parsed(p, c) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=names, dtype=object)
            yield rows

    out = files.select("path", "content").mapInPandas(parse, NODE)
    return out.withColumn("summary", short_text(F.col("summary")))


def loaded_tables(parsed: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed files -> edges (src, rel, dst, hard), aliases (node, alias) and tags (node, tag) of those without an error; tags begin with #."""
    fine = parsed.where("error is null")
    edges = fine.select(F.col("id").alias("src"), F.explode("edges").alias("e")).select("src", "e.rel", F.col("e.to").alias("dst")).distinct()
    edges = edges.join(F.broadcast(rels.select("rel", "hard")), "rel", "left").select("src", "rel", "dst", F.coalesce("hard", F.lit(False)).alias("hard"))
    aliases = fine.select(F.col("id").alias("node"), F.explode("aliases").alias("alias")).distinct()
    tag = F.when(F.col("tag").startswith("#"), F.col("tag")).otherwise(F.concat(F.lit("#"), F.col("tag")))
    return edges, aliases, fine.select(F.col("id").alias("node"), F.explode("tags").alias("tag")).select("node", tag.alias("tag")).distinct()


def load_problems(parsed: DataFrame, rels: DataFrame) -> DataFrame:
    """path or id, problem: files that could not be read, ids that come twice, edges without an end or of no relation, and nodes on a cycle of a relation that must have none."""
    edges, _, _ = loaded_tables(parsed, rels)
    out = parsed.where("error is not null").select(F.col("path").alias("at"), F.col("error").alias("problem"))
    out = out.unionByName(parsed.where("error is null").groupBy(F.col("id").alias("at")).agg(F.count("*").alias("n")).where("n > 1").select("at", F.lit("id comes twice").alias("problem")))
    ids = parsed.where("error is null").select(F.col("id").alias("dst")).distinct()
    out = out.unionByName(edges.join(ids, "dst", "left_anti").select(F.concat_ws(" ", "src", "rel", "dst").alias("at"), F.lit("end is not there").alias("problem")))
    out = out.unionByName(edges.join(F.broadcast(rels.select("rel")), "rel", "left_anti").select(F.concat_ws(" ", "src", "rel", "dst").alias("at"), F.lit("unknown relation").alias("problem")))
    closed = edges.join(F.broadcast(rels.where("acyclic").select("rel")), "rel")
    keyed = closed.select(F.to_json(F.array("rel", "src")).alias("src"), F.to_json(F.array("rel", "dst")).alias("dst"))
    return out.unionByName(on_cycles(keyed).select(F.from_json("id", "array<string>").alias("x")).select(F.concat_ws(" ", F.col("x")[0], F.col("x")[1]).alias("at"), F.lit("on a cycle").alias("problem"))).distinct()


def read_frontmatter_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.md below a folder but readme.md; files without a byte are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return parse_frontmatter(files.where(~F.lower("path").endswith("/readme.md")))


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Parquet of each table in a folder of its version; the one-row manifest is written last, so a reader sees all or nothing."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version, sorted(tables))], "version int, tables array<string>").coalesce(1).write.mode("append").json(f"{folder}/manifest")


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    last = spark.read.schema("version int, tables array<string>").json(f"{folder}/manifest").orderBy(F.desc("version")).first()
    return {name: spark.read.parquet(f"{folder}/v={last.version}/{name}") for name in last.tables}


#: Name of the model that search.embed_blake is.
MODEL = "hashed-ngram-384"


def sync_vectors(docs: DataFrame, old: DataFrame, model: str = MODEL) -> DataFrame:
    """docs (id, cid, text, live), old (id, hash) -> id, action, hash: index, keep or remove, by the hash of content id, text and model."""
    text = F.to_json(F.array(*(F.coalesce(c, F.lit("")) for c in (F.col("cid"), F.col("text"))), F.lit(model)))
    now = docs.where("live").select("id", F.sha2(text, 256).alias("hash"))
    both = now.join(old.select("id", F.col("hash").alias("was")), "id", "full")
    action = F.when(F.col("hash").isNull(), "remove").when(F.col("was").eqNullSafe(F.col("hash")), "keep").otherwise("index")
    return both.select("id", action.alias("action"), "hash")


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """file, content, manifest: every chapter of a folder beside its *.story.json, joined by the stem of their names."""
    entry = "array<struct<id: string, kind: string, title: string, start_off: int, end_off: int, quote: string>>"
    schema = f"schema_version int, source_sha256 string, unresolved array<string>, nodes {entry}, edges array<struct<src: string, rel: string, dst: string>>"
    stem = F.regexp_extract(F.col("path"), r"([^/]+?)(?:\.story\.json|\.md)$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select(stem.alias("file"), "content")
    told = spark.read.format("binaryFile").option("pathGlobFilter", "*.story.json").load(folder)
    told = told.select(stem.alias("file"), F.from_json(F.col("content").cast("string"), schema).alias("manifest"))
    return files.join(told, "file", "left")


def consolidate(docs: DataFrame, old: DataFrame, tables: dict[str, DataFrame], folder: str, version: int) -> DataFrame:
    """What the vectors need (as sync_vectors), after the tables are rewritten as a new snapshot of whole files."""
    write_snapshot({name: df.hint("rebalance") for name, df in tables.items()}, folder, version)
    return sync_vectors(docs, old)
