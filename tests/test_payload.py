"""Payloads: each error by its path, references in canonical form."""

import json

from test_commit import graph

from talegraph.catalog import kind_dim
from talegraph.operators import payload

SCHEMA = "id string, kind string, props string, visible_to string, evidence string"


def rows(spark, *some):
    return spark.createDataFrame([(i, i.split("/")[0].capitalize(), None if p is None else p if isinstance(p, str) else json.dumps(p), None if v is None else json.dumps(v), None if e is None else json.dumps(e)) for i, p, v, e in some], SCHEMA)


def world(spark):
    nodes = [(i, {}, False, 1, False) for i in ("character/a", "character/b", "location/l", "scene/s", "fact/f", "promise/old", "promise/free")] + [("promise/done", {"status": "actualized"}, False, 1, False), ("character/gone", {}, False, 1, True)]
    return graph(spark, nodes, [("promise/old", "requires_trigger", "scene/s")])


GOOD = [
    ("promise/n", {"F": "fact/f", "T": "scene/s", "P": "scene/s", "status": "actualized", "debt": 1.5, "s_eff": 0, "foreshadow_type": "rule"}, None, None),
    ("promise/old", {"status": "eligible"}, None, None), ("promise/done", {"status": "prevented"}, None, None),
    ("scene/n", {"story_time": 3, "location": "story://Location/l", "characters": ["character/a", "Character/b"], "claims": [{"speaker": "character/a", "fact": "fact/n"}], "mentions": [{"entity": "scene/s", "name": "S"}], "pre": [{"subject": "character/a", "field": "x", "op": "in", "value": [1]}, {"subject": "character/a", "field": "x", "op": "exists"}]}, None, None),
    ("fact/n", {"subject": "character/a", "predicate": "p", "object": None}, ["reader", "character/a", {"viewer": "character/b", "learned_at": 0, "pathway": "told"}], [{"file": "a/b.md", "start": 0, "end": 0, "quote": None}]),
    ("session/x", {"open_threads": ["t"], "next": ["n"]}, [], []), ("location/x", {}, None, None),
]

BAD = [
    (("promise/b", {"status": "never"}, None, None), {("props.status", "no status of a promise")}),
    (("promise/done", {"status": "eligible"}, None, None), {("props.status", "no such step of a promise"), ("props.T", "eligible without a trigger")}),
    (("promise/free", {"status": "eligible"}, None, None), {("props.T", "eligible without a trigger")}),
    (("promise/c", {"status": "actualized", "P": "scene/s"}, None, None), {("props.T", "actualized without a trigger")}),
    (("promise/d", {"F": "location/l", "T": "nowhere", "P": 3, "debt": -1, "s_eff": 1.5, "delta_coh": True, "foreshadow_type": "x"}, None, None), {
        ("props.F", "a reference of another kind"), ("props.T", "a reference names its kind"), ("props.P", "a reference is asked for"), ("props.debt", "a number of 0 or more is asked for"),
        ("props.s_eff", "a number from 0 to 1 is asked for"), ("props.delta_coh", "a number from 0 to 1 is asked for"), ("props.foreshadow_type", "no kind of foreshadowing")}),
    (("scene/b", {"location": "location/l"}, None, None), {("props.story_time", "a scene's contract is whole or not there"), ("props.characters", "a scene's contract is whole or not there")}),
    (("scene/c", {"story_time": 1.5, "location": "character/a", "characters": ["character/a", "character/a", "location/l", "character/gone", 4]}, None, None), {
        ("props.story_time", "text or a whole number is asked for"), ("props.location", "a reference of another kind"), ("props.characters", "one character twice"), ("props.characters[2]", "a reference of another kind"),
        ("props.characters[3]", "the node is not there"), ("props.characters[4]", "a reference is asked for")}),
    (("scene/d", {"pre": {}, "post": ["x", {"field": "f", "value": 1}, {"subject": "character/a", "field": " ", "op": "like", "value": 1, "more": 1}, {"subject": "character/zz", "field": "f"}, {"subject": "character/a", "field": "f", "op": "in", "value": 1}]}, None, None), {
        ("props.pre", "a list is asked for"), ("props.post[0]", "an object is asked for"), ("props.post[0].subject", "a reference is asked for"), ("props.post[1].subject", "a reference is asked for"), ("props.post[2]", "an unknown part"), ("props.post[2].field", "a field is asked for"),
        ("props.post[2].op", "no such operator"), ("props.post[3].subject", "the node is not there"), ("props.post[3].value", "a value is asked for"), ("props.post[4].value", "a list is asked for")}),
    (("scene/e", {"claims": [{"speaker": "fact/f", "fact": "fact/f", "x": 1}], "mentions": [{"entity": "scene/s", "name": ""}]}, None, None), {
        ("props.claims[0]", "exactly speaker and fact"), ("props.claims[0].speaker", "a reference of another kind"), ("props.mentions[0].name", "a name is asked for")}),
    (("fact/b", {}, [{"viewer": "location/l"}, "character/gone", "reader", "reader", {"viewer": "character/a", "learned_at": -1, "pathway": "dream", "x": 1}, 5], [{"file": "/etc", "start": 0, "end": 1, "quote": ""}, {"file": "a/../b", "start": 3, "end": 1, "quote": 4}, {"file": "a"}, {"file": "a", "start": 0.5, "end": 1, "quote": ""}]), {
        ("props.subject", "a reference is asked for"), ("props.predicate", "a predicate is asked for"), ("props.object", "an object is asked for"), ("visible_to[0].viewer", "a viewer is the reader or a character"), ("visible_to[1].viewer", "the viewer is not there"),
        ("visible_to[3].viewer", "one viewer twice"), ("visible_to[4]", "an unknown part"), ("visible_to[4].learned_at", "a whole number of 0 or more is asked for"), ("visible_to[4].pathway", "no such way to learn"), ("visible_to[5]", "text or an object is asked for"),
        ("evidence[0].file", "a safe relative path is asked for"), ("evidence[1].file", "a safe relative path is asked for"), ("evidence[1]", "offsets are out of order"), ("evidence[1].quote", "text or null is asked for"), ("evidence[2]", "exactly file, start, end and quote"), ("evidence[3]", "offsets are whole numbers")}),
    (("session/b", {"open_threads": []}, None, None), {("props.open_threads", "a list of texts is asked for"), ("props.next", "a list of texts is asked for")}),
    (("location/b", "[1]", ["reader"], {"x": 1}), {("props", "an object is asked for"), ("visible_to", "for facts only"), ("evidence", "a list is asked for")}),
    (("concept/b", "not json", None, None), {("props", "an object is asked for")}),
]


def test_good_payloads_have_no_error(spark):
    assert payload.validate_payloads(world(spark), rows(spark, *GOOD), kind_dim(spark)).collect() == []


def test_each_error_has_its_path(spark):
    got = {}
    for r in payload.validate_payloads(world(spark), rows(spark, *(x for x, _ in BAD)), kind_dim(spark)).collect():
        got.setdefault(r.id, set()).add((r.path, r.error))
    for x, want in BAD:
        assert got.get(x[0]) == want, x[0]


def test_references_in_canonical_form(spark):
    some = [
        ("scene/n", {"location": "story://LOCATION/l", "characters": ["Character/é", 3], "claims": [{"speaker": "story://character/a", "fact": "FACT/f"}], "pre": [{"subject": "Rule/r", "value": "Rule/r"}], "note": "Rule/r"}, None, None),
        ("fact/n", {"subject": "Nobody/x"}, ["reader", "CHARACTER/a", {"viewer": "story://character/b"}], None), ("rule/r", {"forbid": [{"subject": "Location/l"}, 7]}, None, None), ("concept/c", "bad", None, None),
    ]
    got = {r.id: (r.props, r.visible_to) for r in payload.normalize_payload_refs(rows(spark, *some), kind_dim(spark)).collect()}
    assert json.loads(got["scene/n"][0]) == {"location": "location/l", "characters": ["character/é", 3], "claims": [{"speaker": "character/a", "fact": "fact/f"}], "pre": [{"subject": "rule/r", "value": "Rule/r"}], "note": "Rule/r"}
    assert json.loads(got["fact/n"][0]) == {"subject": "Nobody/x"} and json.loads(got["fact/n"][1]) == ["reader", "character/a", {"viewer": "character/b"}]
    assert json.loads(got["rule/r"][0]) == {"forbid": [{"subject": "location/l"}, 7]} and got["concept/c"] == ("bad", None)
