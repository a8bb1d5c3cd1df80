"""Payloads of nodes: references inside them, their canonical form, and what is wrong with them, by path.

payloads: id, kind, props, visible_to, evidence, the last three as JSON text or null.  They are read as
variants, so values keep their JSON type.  An error is one row: id, path, error."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph, cut
from .apply import PROMISE_STEPS

# Where references stand in a payload: kind of the node (- any), property, part of an item (- none), kinds that it may name (- any)
REFERENCES = """
Promise F - Fact,Scene
Promise T - Scene
Promise P - Scene
Fact subject - -
Scene location - Location
Scene characters * Character
Scene pre subject -
Scene post subject -
Scene forbid subject -
Rule pre subject -
Rule post subject -
Rule forbid subject -
Scene claims speaker Character
Scene claims fact Fact
Scene mentions entity -
"""
# Operators of conditions, ways to learn, kinds of foreshadowing
OPS = ("eq", "ne", "in", "not_in", "exists", "not_exists")
PATHWAYS = ("direct", "observed", "told", "common")
FORESHADOWS = ("object", "event", "rule")
READER = "reader"


def references() -> list[tuple[str, str, str, list[str]]]:
    rows = [line.split() for line in REFERENCES.strip().splitlines()]
    return [(kind, name, part, [] if kinds == "-" else kinds.split(",")) for kind, name, part, kinds in rows]


def _get(v: str | Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column) -> Column:
    """JSON type of a variant: the word before any parameters."""
    return F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)


def _is(v: Column, *names: str) -> Column:
    return F.coalesce(_type(v).isin(*names), F.lit(False))


_TEXT, _LIST, _MAP, _WHOLE, _NUMBER = ("STRING",), ("ARRAY",), ("OBJECT",), ("BIGINT",), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _filled(v: Column) -> Column:
    return _is(v, *_TEXT) & F.coalesce(F.trim(v.cast("string")) != "", F.lit(False))


def _items(df: DataFrame, name: str, source: str = "v") -> DataFrame:
    """df with i and item of a list in a variant."""
    return df.select("*", F.posexplode(F.try_variant_get(source, f"$.{name}" if name else "$", "array<variant>")).alias("i", "item"))


def _parsed(payloads: DataFrame) -> DataFrame:
    """id, kind, v: properties as a variant, parsed before or now."""
    return payloads.select("id", "kind", "v") if "v" in payloads.columns else payloads.select("id", "kind", F.try_parse_json("props").alias("v"))


def payload_references(payloads: DataFrame) -> DataFrame:
    """id, path, ref, kinds: every typed reference inside the properties; ref is null where no text stands."""
    p = _parsed(payloads)
    parts = None
    for kind, name, part, kinds in references():
        mine = p.where(F.col("kind") == kind)
        if part == "-":
            value, path = _get("v", f"$.{name}"), F.lit(f"props.{name}")
            mine = mine.where(value.isNotNull() & ~_is(value, "VOID"))
        else:
            mine = _items(mine, name)
            value = F.col("item") if part == "*" else _get("item", f"$.{part}")
            path = F.concat(F.lit(f"props.{name}["), F.col("i").cast("string"), F.lit("]" if part == "*" else f"].{part}"))
        ref = F.when(_filled(value), value.cast("string"))
        rows = mine.select("id", path.alias("path"), ref.alias("ref"), F.array(*map(F.lit, kinds)).cast("array<string>").alias("kinds"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def _canonical(ref: Column, kinds: list[str]) -> Column:
    """scheme cut, a known kind in lower case; null if it names no kind."""
    bare = F.regexp_replace(ref, "^story://", "")
    head = F.lower(F.substring_index(bare, "/", 1))
    known = bare.contains("/") & head.isin(*(k.lower() for k in kinds)) & (F.substring_index(bare, "/", -1) != "")
    return F.when(known, F.concat(head, bare.substr(F.length(head) + 1, F.length(bare))))


def _kind_names(kinds: DataFrame) -> list[str]:
    return [r.kind for r in kinds.select("kind").collect()]  # catalogued


def reference_errors(g: Graph, payloads: DataFrame, kinds: DataFrame) -> DataFrame:
    """References that are none, of the wrong kind, or to nodes that neither live nor come with the payloads."""
    names = _kind_names(kinds)
    r = payload_references(payloads).withColumn("to", _canonical(F.col("ref"), names))
    there = g.live_node.select(F.col("id").alias("to")).unionByName(payloads.select(F.col("id").alias("to"))).distinct().withColumn("there", F.lit(True))
    r = r.join(there, "to", "left")
    of = F.initcap(F.substring_index("to", "/", 1))
    error = (
        F.when(F.col("ref").isNull(), "a reference is asked for").when(F.col("to").isNull(), "a reference names its kind")
        .when((F.size("kinds") > 0) & ~F.array_contains("kinds", of), "a reference of another kind").when(F.col("there").isNull(), "the node is not there")
    )
    return r.select("id", "path", error.alias("error")).where("error is not null")


def _wrong(df: DataFrame, checks: list[tuple[Column, Column | str, str]]) -> DataFrame:
    """Rows of id, path, error for each check that holds."""
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct((F.lit(p) if isinstance(p, str) else p).alias("path"), F.lit(e).alias("error"))) for c, p, e in checks)), lambda x: x.isNotNull())
    return df.select("id", F.explode(found).alias("x")).select("id", "x.path", "x.error")


def _has(v: str, path: str) -> Column:
    return _get(v, path).isNotNull()


def _set(v: str, path: str) -> Column:
    value = _get(v, path)
    return value.isNotNull() & ~_is(value, "VOID")


def _keys(v: Column) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))


def kind_props_errors(g: Graph, payloads: DataFrame) -> DataFrame:
    """What each kind asks of its properties, beside its references: promises and their steps, conditions, scene contracts, fact triples, session lists."""
    was = g.live_node.select("id", F.lit(True).alias("old"), F.coalesce(F.get_json_object("props", "$.status"), F.lit("hypothetical")).alias("was"))
    p = _parsed(payloads)
    out = _wrong(p.where("v is null or not coalesce(schema_of_variant(v) like 'OBJECT%', false)"), [(F.lit(True), "props", "an object is asked for")])
    p = p.where("v is not null")

    triggers = g.live_edge.where("rel = 'requires_trigger'").select(F.col("src").alias("id")).distinct().withColumn("trigger", F.lit(True))
    payoffs = g.live_edge.where("rel = 'pays_off'").select(F.col("dst").alias("id")).distinct().withColumn("payoff", F.lit(True))
    promise = p.where("kind = 'Promise'").join(was, "id", "left").join(triggers, "id", "left").join(payoffs, "id", "left")
    status = F.coalesce(_get("v", "$.status", "string"), F.lit("hypothetical"))
    steps = F.create_map(*(x for k, to in PROMISE_STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, to)).cast("array<string>"))))
    moved = F.col("old").isNull() | (status != F.col("was"))
    has_t, has_p = _set("v", "$.T"), _set("v", "$.P")
    debt = _get("v", "$.debt")
    part = [
        (~status.isin(*PROMISE_STEPS), "props.status", "no status of a promise"),
        (status.isin(*PROMISE_STEPS) & F.col("old") & (status != F.col("was")) & ~F.array_contains(F.element_at(steps, F.col("was")), status), "props.status", "no such step of a promise"),
        ((status == "eligible") & moved & ~has_t & ~F.coalesce(F.col("old") & F.col("trigger"), F.lit(False)), "props.T", "eligible without a trigger"),
        ((status == "actualized") & moved & ~F.coalesce(has_p | (F.col("old") & F.col("payoff")), has_p), "props.P", "actualized without a payoff"),
        ((status == "actualized") & F.col("old").isNull() & ~has_t, "props.T", "actualized without a trigger"),
        (_set("v", "$.foreshadow_type") & ~F.coalesce(_get("v", "$.foreshadow_type", "string").isin(*FORESHADOWS), F.lit(False)), "props.foreshadow_type", "no kind of foreshadowing"),
        (_set("v", "$.debt") & (~_is(debt, *_NUMBER) | (_get("v", "$.debt", "double") < 0)), "props.debt", "a number of 0 or more is asked for"),
    ]
    for c in ("s_eff", "delta_coh"):
        part.append((_set("v", f"$.{c}") & (~_is(_get("v", f"$.{c}"), *_NUMBER) | ~_get("v", f"$.{c}", "double").between(0, 1)), f"props.{c}", "a number from 0 to 1 is asked for"))
    out = out.unionByName(_wrong(promise, part))

    ruled = p.where("kind in ('Scene', 'Rule')")
    for phase in ("pre", "post", "forbid"):
        path = F.concat(F.lit(f"props.{phase}["), F.col("i").cast("string"), F.lit("]"))
        op = F.coalesce(_get("item", "$.op", "string"), F.lit("eq"))
        out = out.unionByName(_wrong(ruled, [(_has("v", f"$.{phase}") & ~_is(_get("v", f"$.{phase}"), *_LIST), f"props.{phase}", "a list is asked for")]))
        out = out.unionByName(_wrong(_items(ruled, phase), [
            (~_is(F.col("item"), *_MAP), path, "an object is asked for"),
            (_is(F.col("item"), *_MAP) & (F.size(F.array_except(_keys(F.col("item")), F.array(*map(F.lit, ("subject", "field", "op", "value"))))) > 0), path, "an unknown part"),
            (_is(F.col("item"), *_MAP) & ~_has("item", "$.subject"), F.concat(path, F.lit(".subject")), "a reference is asked for"),
            (_is(F.col("item"), *_MAP) & ~_filled(_get("item", "$.field")), F.concat(path, F.lit(".field")), "a field is asked for"),
            (_is(F.col("item"), *_MAP) & ~op.isin(*OPS), F.concat(path, F.lit(".op")), "no such operator"),
            (_is(F.col("item"), *_MAP) & ~op.isin("exists", "not_exists") & ~_has("item", "$.value"), F.concat(path, F.lit(".value")), "a value is asked for"),
            (_is(F.col("item"), *_MAP) & op.isin("in", "not_in") & _has("item", "$.value") & ~_is(_get("item", "$.value"), *_LIST), F.concat(path, F.lit(".value")), "a list is asked for"),
        ]))

    scene = p.where("kind = 'Scene'")
    contract = ("story_time", "location", "characters")
    some = F.lit(False)
    for c in contract:
        some = some | _has("v", f"$.{c}")
    out = out.unionByName(_wrong(scene, [(some & ~_has("v", f"$.{c}"), f"props.{c}", "a scene's contract is whole or not there") for c in contract] + [
        (_has("v", "$.story_time") & ~_is(_get("v", "$.story_time"), *_TEXT, *_WHOLE), "props.story_time", "text or a whole number is asked for"),
        (_has("v", "$.characters") & ~F.coalesce(F.size(_get("v", "$.characters", "array<variant>")) > 0, F.lit(False)), "props.characters", "a list of characters is asked for"),
        (F.coalesce(F.size(F.array_distinct(_get("v", "$.characters", "array<string>"))) < F.size(_get("v", "$.characters", "array<string>")), F.lit(False)), "props.characters", "one character twice"),
    ]))
    for name, parts in (("claims", ("speaker", "fact")), ("mentions", ("entity", "name"))):
        path = F.concat(F.lit(f"props.{name}["), F.col("i").cast("string"), F.lit("]"))
        checks = [(F.array_sort(_keys(F.col("item"))) != F.array_sort(F.array(*map(F.lit, parts))), path, "exactly " + " and ".join(parts))]
        if name == "mentions":
            checks.append((_has("item", "$.name") & ~_filled(_get("item", "$.name")), F.concat(path, F.lit(".name")), "a name is asked for"))
        out = out.unionByName(_wrong(scene, [(_has("v", f"$.{name}") & ~_is(_get("v", f"$.{name}"), *_LIST), f"props.{name}", "a list is asked for")])).unionByName(_wrong(_items(scene, name), checks))
    out = out.unionByName(_wrong(p.where("kind = 'Fact'"), [
        (~_set("v", "$.subject"), "props.subject", "a reference is asked for"), (~_filled(_get("v", "$.predicate")), "props.predicate", "a predicate is asked for"), (~_has("v", "$.object"), "props.object", "an object is asked for"),
    ]))
    lists = [(~F.coalesce((F.size(_get("v", f"$.{c}", "array<variant>")) > 0) & F.forall(_get("v", f"$.{c}", "array<variant>"), _filled), F.lit(False)), f"props.{c}", "a list of texts is asked for") for c in ("open_threads", "next")]
    return out.unionByName(_wrong(p.where("kind = 'Session'"), lists))


def visibility_errors(g: Graph, payloads: DataFrame, kinds: DataFrame) -> DataFrame:
    """visible_to: for facts only, each viewer the reader or a living character and once, when and how it was learned."""
    names = _kind_names(kinds)
    p = payloads.where("visible_to is not null").select("id", "kind", F.try_parse_json("visible_to").alias("v"))
    listed = _is(F.col("v"), *_LIST)
    out = _wrong(p, [(~listed | F.col("v").isNull(), "visible_to", "a list is asked for"), (listed & (F.col("kind") != "Fact") & (F.size(_get("v", "$", "array<variant>")) > 0), "visible_to", "for facts only")])
    each = _items(p, "")
    plain, whole = _is(F.col("item"), *_TEXT), _is(F.col("item"), *_MAP)
    viewer = F.when(plain, F.col("item").cast("string")).otherwise(_get("item", "$.viewer", "string"))
    each = each.withColumn("viewer", viewer).withColumn("to", F.when(F.col("viewer") != READER, _canonical(F.col("viewer"), names)))
    people = g.live_node.where("kind = 'Character'").select(F.col("id").alias("to"), F.lit(True).alias("there"))
    each = each.join(people, "to", "left")
    path = F.concat(F.lit("visible_to["), F.col("i").cast("string"), F.lit("]"))
    learned = _get("item", "$.learned_at")
    out = out.unionByName(_wrong(each, [
        (~plain & ~whole, path, "text or an object is asked for"),
        (whole & (F.size(F.array_except(_keys(F.col("item")), F.array(*map(F.lit, ("viewer", "learned_at", "pathway"))))) > 0), path, "an unknown part"),
        ((plain | whole) & F.col("viewer").isNull(), F.concat(path, F.lit(".viewer")), "a viewer is asked for"),
        ((F.col("viewer") != READER) & ~F.coalesce(F.col("to").startswith("character/"), F.lit(False)), F.concat(path, F.lit(".viewer")), "a viewer is the reader or a character"),
        (F.col("to").startswith("character/") & F.col("there").isNull(), F.concat(path, F.lit(".viewer")), "the viewer is not there"),
        (whole & _set("item", "$.learned_at") & (~_is(learned, *_WHOLE) | (_get("item", "$.learned_at", "double") < 0)), F.concat(path, F.lit(".learned_at")), "a whole number of 0 or more is asked for"),
        (whole & _has("item", "$.pathway") & ~F.coalesce(_get("item", "$.pathway", "string").isin(*PATHWAYS), F.lit(False)), F.concat(path, F.lit(".pathway")), "no such way to learn"),
    ]))
    twice = each.where("viewer is not null").groupBy("id", F.coalesce("to", "viewer").alias("who")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("i")).alias("at")).where("n > 1")
    return out.unionByName(twice.select("id", F.concat(F.lit("visible_to["), F.element_at("at", -1).cast("string"), F.lit("].viewer")).alias("path"), F.lit("one viewer twice").alias("error")))


def evidence_errors(payloads: DataFrame) -> DataFrame:
    """evidence: exactly file, start, end and quote; a safe relative path; offsets in order."""
    p = payloads.where("evidence is not null").select("id", F.try_parse_json("evidence").alias("v"))
    out = _wrong(p, [(F.col("v").isNull() | ~_is(F.col("v"), *_LIST), "evidence", "a list is asked for")])
    path = F.concat(F.lit("evidence["), F.col("i").cast("string"), F.lit("]"))
    exact = F.array_sort(_keys(F.col("item"))) == F.array(*map(F.lit, ("end", "file", "quote", "start")))
    file = _get("item", "$.file", "string")
    safe = _filled(_get("item", "$.file")) & ~file.rlike(r"^[/\\]") & ~F.array_contains(F.split(F.regexp_replace(file, r"\\", "/"), "/"), "..")
    start, end = _get("item", "$.start"), _get("item", "$.end")
    whole = _is(start, *_WHOLE) & _is(end, *_WHOLE)
    first, last = _get("item", "$.start", "long"), _get("item", "$.end", "long")
    quote = _get("item", "$.quote")
    return out.unionByName(_wrong(_items(p, ""), [
        (~exact, path, "exactly file, start, end and quote"),
        (exact & ~F.coalesce(safe, F.lit(False)), F.concat(path, F.lit(".file")), "a safe relative path is asked for"),
        (exact & ~whole, path, "offsets are whole numbers"),
        (exact & whole & ((first < 0) | (last < first)), path, "offsets are out of order"),
        (exact & ~_is(quote, *_TEXT, "VOID"), F.concat(path, F.lit(".quote")), "text or null is asked for"),
    ]))


def validate_payloads(g: Graph, payloads: DataFrame, kinds: DataFrame) -> DataFrame:
    """id, path, error: everything that is wrong with payloads, held against the graph and against each other.

    Payloads and what is asked of the graph are written once, payloads parsed and by kind, as each rule reads them anew and most ask for one kind."""
    g = replace(g, node=cut(g.live_node.select("id", "kind", "props", "tx_to")))
    payloads = payloads.withColumn("v", F.try_parse_json("props"))
    payloads = cut(payloads.withColumn("kind", F.concat(F.lit("="), "kind")), "kind").withColumn("kind", F.substring("kind", 2, 1_000_000))
    return reference_errors(g, payloads, kinds).unionByName(kind_props_errors(g, payloads)).unionByName(visibility_errors(g, payloads, kinds)).unionByName(evidence_errors(payloads)).distinct()


def normalize_payload_refs(payloads: DataFrame, kinds: DataFrame) -> DataFrame:
    """payloads with every typed reference in canonical form, composed (NFC); what names no kind stays."""
    names = {k.lower() for k in _kind_names(kinds)}
    table: dict[str, list[tuple[str, str]]] = {}
    for kind, name, part, _ in references():
        table.setdefault(kind, []).append((name, part))

    def one(ref):
        if not isinstance(ref, str):
            return ref
        bare = unicodedata.normalize("NFC", ref).removeprefix("story://")
        head, slash, rest = bare.partition("/")
        return f"{head.lower()}/{rest}" if slash and rest and head.lower() in names else ref

    @F.pandas_udf("props string, visible_to string")
    def run(kind: pd.Series, props: pd.Series, seen: pd.Series) -> pd.DataFrame:
        out = []
        for k, text, viewers in zip(kind, props, seen, strict=True):
            try:
                doc = json.loads(text) if text else None
            except ValueError:
                doc = None
            if isinstance(doc, dict):
                for name, part in table.get(k, ()):
                    value = doc.get(name)
                    if part == "-":
                        doc |= {name: one(value)} if name in doc else {}
                    elif isinstance(value, list):
                        doc[name] = [one(x) if part == "*" else x | {part: one(x[part])} if isinstance(x, dict) and part in x else x for x in value]
                text = json.dumps(doc, ensure_ascii=False, separators=(",", ":"))
            try:
                told = json.loads(viewers) if viewers else None
            except ValueError:
                told = None
            if isinstance(told, list):
                told = [one(x) if isinstance(x, str) else x | {"viewer": one(x["viewer"])} if isinstance(x, dict) and "viewer" in x else x for x in told]
                viewers = json.dumps(told, ensure_ascii=False, separators=(",", ":"))
            out.append((text, viewers))
        return pd.DataFrame(out, columns=["props", "visible_to"])

    both = run("kind", "props", "visible_to")
    return payloads.withColumn("x", both).withColumn("props", F.col("x.props")).withColumn("visible_to", F.col("x.visible_to")).drop("x")
