"""Node kinds, relations, rules and policies as small tables.

The catalogues are fixed values of the data model, so they are written out as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Kind layer internal default_locked
KINDS = """
Character substance 0 0
Location substance 0 0
Object substance 0 0
Faction substance 0 0
Rule substance 0 1
Concept substance 0 0
Scene event 0 0
Event event 0 0
Beat event 0 0
Chapter event 0 0
Act event 0 0
Promise device 0 0
Twist device 0 0
Reveal device 0 0
Fact device 0 0
Thread device 0 0
Arc device 0 0
Session device 1 0
"""

# Rel group hard acyclic max_per_dst src dst (- none)
RELATIONS = """
contains structure 1 1 - - -
extends structure 1 1 - - -
member_of structure 1 0 - - -
alias_of structure 1 0 - - -
performs event_role 1 0 - Character Scene
undergoes event_role 1 0 - - -
witnesses event_role 1 0 - - -
focalizes event_role 1 0 1 - -
occurs_at spatiotemporal 1 0 - Scene Location
present_at spatiotemporal 1 0 - - -
causes causal 1 1 - - -
enables causal 1 0 - - -
prevents causal 1 0 - - -
precedes causal 1 0 - - -
plants device 1 0 - Scene Promise
requires_trigger device 1 0 - Promise Scene
pays_off device 1 0 - Scene Promise
reveals device 1 0 - - -
depends_on device 1 0 - - -
contradicts device 1 0 - - -
kin_of social 1 0 - - -
ally_of social 1 0 - - -
hostile_to social 1 0 - - -
owns object 1 0 - - -
uses object 1 0 - - -
part_of object 1 0 - - -
grounded_in evidence 1 0 - - span
mentioned_in evidence 0 0 - - -
"""

# Rule severity executable tier
RULES = """
timeline.absolute error 1 1
timeline.duration warn 0 1
timeline.simultaneity error 1 1
plot.causeless warn 1 1
plot.causal_violation error 0 1
plot.abandoned error 1 1
character.memory error 1 1
character.knowledge error 1 1
character.skill warn 0 2
character.forgotten_ability warn 0 1
world.core_rule error 1 1
world.social_norm info 0 2
world.geography error 0 1
detail.appearance error 1 1
detail.nomenclature warn 1 1
detail.quantity warn 0 1
narrative.perspective error 1 1
narrative.tone info 0 2
style.drift info 0 2
promise.unearned error 1 1
promise.premature error 1 1
promise.trigger_undefined warn 0 1
graph.orphan_edge error 0 1
graph.causal_cycle error 1 1
graph.unreachable warn 1 1
plot.contradiction error 0 2
"""

# Policy risk effect verb kind field rel hard locked value (- any; value: null or set)
POLICIES = """
locked-node always forbid - - - - - 1 -
canon-rule always forbid UPDATE|INVALIDATE Rule - - - - -
contradiction-edge always allow LINK - - contradicts - - -
existing-value-change review allow UPDATE - - - - - set
hard-unlink review allow UNLINK - - - 1 - -
hard-link review allow LINK - - - 1 - -
promise-transition review allow - Promise props.status - - - -
new-node auto allow ADD - - - - - -
null-fill auto allow UPDATE - - - - - null
soft-link auto allow LINK - - - 0 - -
soft-unlink auto allow UNLINK - - - 0 - -
invalidate-node review allow INVALIDATE - - - - - -
"""


def _rows(text: str) -> list[list[str | None]]:
    return [[None if x == "-" else x for x in line.split()] for line in text.strip().splitlines()]


def kind_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, layer, internal == "1", locked == "1") for k, layer, internal, locked in _rows(KINDS)]
    return spark.createDataFrame(rows, "kind string, layer string, internal boolean, default_locked boolean")


def rel_dim(spark: SparkSession) -> DataFrame:
    rows = [(r, g, hard == "1", acyclic == "1", int(most) if most else None, s, d) for r, g, hard, acyclic, most, s, d in _rows(RELATIONS)]
    return spark.createDataFrame(rows, "rel string, grp string, hard boolean, acyclic boolean, max_per_dst int, src_kind string, dst_kind string")


def rule_dim(spark: SparkSession) -> DataFrame:
    rows = [(r, s, x == "1", int(t)) for r, s, x, t in _rows(RULES)]
    return spark.createDataFrame(rows, "rule string, severity string, executable boolean, tier int")


def policy_dim(spark: SparkSession) -> DataFrame:
    rows = [(p, risk, effect, verb.split("|") if verb else None, kind, field, rel, None if hard is None else hard == "1", None if locked is None else locked == "1", value) for p, risk, effect, verb, kind, field, rel, hard, locked, value in _rows(POLICIES)]
    return spark.createDataFrame(rows, "policy string, risk string, effect string, verbs array<string>, kind string, field string, rel string, hard boolean, locked boolean, value string")


def values_sql(rows: list[tuple], columns: str) -> str:
    """A catalogue as SQL text for both Spark and DuckDB."""

    def lit(x: object) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x) + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({columns})"


RULES_SQL = values_sql([(r, s, x == "1", int(t)) for r, s, x, t in _rows(RULES)], "rule, severity, executable, tier")
KINDS_SQL = values_sql([(k, layer, i == "1", d == "1") for k, layer, i, d in _rows(KINDS)], "kind, layer, internal, default_locked")
RELS_SQL = values_sql([(r, g, h == "1", a == "1", int(m) if m else None, s, d) for r, g, h, a, m, s, d in _rows(RELATIONS)], "rel, grp, hard, acyclic, max_per_dst, src_kind, dst_kind")
POLICIES_SQL = values_sql([(p, r, e, v, k, f, rel, None if h is None else h == "1", None if lk is None else lk == "1", val) for p, r, e, v, k, f, rel, h, lk, val in _rows(POLICIES)], "policy, risk, effect, verb, kind, field, rel, hard, locked, value")
