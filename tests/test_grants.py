"""Leases with refusal: batch against a serial run, stream against batch."""

import datetime
import random

from pyspark.sql import functions as F

from talegraph.streaming import grants

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "session string, scope string, action string, ttl int, ts timestamp"


def overlaps(a, b):
    def wild(s):
        return s == "book" or s.endswith(".*")

    x, y = a.removesuffix(".*"), b.removesuffix(".*")
    below = lambda up, low: up == "book" or low.startswith((up + ".", up + "/"))
    return x == y or (wild(a) and below(x, y)) or (wild(b) and below(y, x))


def serial(rows):
    held, out = {}, []
    for session, scope, action, ttl, ts in sorted(set(rows), key=lambda r: (r[4], r[0], r[1], r[2])):
        held = {k: v for k, v in held.items() if v > ts}
        if action == "release":
            out.append((ts, session, scope, "released" if held.pop((session, scope), None) else "nothing"))
        elif any(s != session and overlaps(c, scope) for s, c in held):
            out.append((ts, session, scope, "refused"))
        else:
            out.append((ts, session, scope, "renewed" if (session, scope) in held else "acquired"))
            held[session, scope] = ts + datetime.timedelta(seconds=min(max(ttl, 1), 86_400))
    return sorted(out), held


def log(seed, n, broad):
    rng = random.Random(seed)
    scopes = [f"scene/A{i}{c}" for i in range(3) for c in (".*", ".C1.*", ".C1.S1", ".C2", ".C2.*", "")] + ["note/x", "note/x.*"]
    scopes += ["book", "scene.*", "scene", "note.*"] if broad else []
    return [(f"s{rng.randrange(5)}", rng.choice(scopes), "release" if rng.random() < 0.25 else "acquire", rng.choice([60, 600, 3000, 10**6]), T0 + datetime.timedelta(seconds=60 * i + rng.randrange(3))) for i in range(n)]


def test_batch_is_serial(spark):
    for seed, broad in ((1, False), (2, True), (3, True)):
        rows = log(seed, 150, broad)
        got = grants.grant_leases(spark.createDataFrame(rows, SCHEMA).repartition(4))
        want, held = serial(rows)
        assert sorted((r.ts, r.session, r.scope, r.outcome) for r in got.outcomes.collect()) == want
        assert {x[3] for x in want} == {"acquired", "renewed", "refused", "released", "nothing"}
        last = max(r[4] for r in rows)
        assert {(r.session, r.scope): r.expires_at for r in grants.held_at(got, F.lit(last)).collect()} == held


def test_named_cases(spark):
    at = [T0 + datetime.timedelta(minutes=i) for i in range(9)]
    rows = [
        ("a", "story://scene/A2.C14.*", "acquire", 900, at[0]), ("a", "scene/A2.C14.*", "acquire", 1200, at[1]), ("b", "scene/A2.C14.S03", "acquire", 900, at[2]), ("b", "scene/A2.C15.*", "acquire", 60, at[2]),
        ("b", "scene/A2.C14.*", "release", 0, at[3]), ("a", "scene/A2.C14.*", "release", 0, at[4]), ("c", "scene/A2.C15.S1", "acquire", 1, at[5]), ("d", "book", "acquire", 900, at[6]), ("e", "note/n", "acquire", 900, at[7]),
        (None, "x/y", "acquire", 1, at[0]), ("f", None, "acquire", 1, at[0]), ("f", "x/y", "peek", 1, at[0]), ("f", "x/y", "acquire", None, None),
    ]
    got = {(r.session, r.scope, r.ts): r.outcome for r in grants.grant_leases(spark.createDataFrame(rows, SCHEMA)).outcomes.collect()}
    assert [got[s, c, t] for s, c, t in (("a", "scene/A2.C14.*", at[0]), ("a", "scene/A2.C14.*", at[1]), ("b", "scene/A2.C14.S03", at[2]), ("b", "scene/A2.C15.*", at[2]))] == ["acquired", "renewed", "refused", "acquired"]
    assert got["b", "scene/A2.C14.*", at[3]] == "nothing" and got["a", "scene/A2.C14.*", at[4]] == "released"
    assert got["c", "scene/A2.C15.S1", at[5]] == "acquired" and got["d", "book", at[6]] == "acquired" and got["e", "note/n", at[7]] == "refused" and len(got) == 9
    none = grants.grant_leases(spark.createDataFrame([], SCHEMA))
    assert none.outcomes.count() == 0 and none.held.count() == 0


def test_stream_is_batch(spark, tmp_path):
    rows = log(5, 90, True)
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    got = []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    query = grants.grant_stream(stream, f"{tmp_path}/state", f"{tmp_path}/at", lambda df, n: got.extend((r.ts, r.session, r.scope, r.outcome) for r in df.collect()))
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == serial(rows)[0]
