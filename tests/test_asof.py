"""As-of lists and joins against plain Python: own times for each question, hot keys, ties and nulls."""

import datetime as dt
import random
from dataclasses import replace

from pyspark.sql import functions as F

from faultline import schemas
from faultline.config import RunConfig
from faultline.operators import dedup, similarity
from faultline.operators.asof import last_before, numbered

NOW = dt.datetime(2024, 3, 1)


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = sorted((r.place, r.t) for r in numbered(df, ["k"], [F.col("t"), F.desc("i")]).where("k = 'a'").collect())
    assert got == [(n, t) for n, (t, _) in enumerate(sorted(((t, -i) for k, t, i in rows if k == "a")), 1)]
    assert numbered(df, ["k"], [F.col("t")]).where("k is null").agg(F.max("place")).first()[0] == sum(k is None for k, _, _ in rows)
    assert numbered(df.limit(0), ["k"], [F.col("t")]).collect() == []


def test_last_before(spark):
    rng = random.Random(2)
    keys = ["hot"] * 8 + ["b", "c", None]
    events = {(rng.choice(keys), rng.randint(0, 900)): i for i in range(600)}
    asked = [(rng.choice(keys), rng.choice([None, rng.randint(-5, 905)])) for _ in range(900)] * 2
    e = spark.createDataFrame([(k, t, v) for (k, t), v in events.items()] + [("b", None, 7)], "k string, t int, v int")
    a = spark.createDataFrame(asked, "k string, t int")
    want = set()
    for k, t in asked:
        before = [(u, v) for (j, u), v in events.items() if j == k and t is not None and u <= t]
        if before:
            want.add((k, t, max(before)[1]))
    for parts in ("1", "7", "40"):  # slices of one key
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = [tuple(r) for r in last_before(a, e, ["k"], "t", "v").collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(want) and set(got) == want
    assert last_before(a.limit(0), e, ["k"], "t", "v").collect() == [] and last_before(a, e.limit(0), ["k"], "t", "v").collect() == []


WORDS = ["database", "timeout", "kafka", "consumer", "blob not found", "file size", "login", "of", "the"]


def test_candidates_as_of_their_own_times(spark):
    rng = random.Random(3)
    tickets = []
    for i in range(400):
        said = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        created = rng.choice([None, at(rng.randint(0, 3000)), at(60 * rng.randint(0, 50)), at(-300000)])
        tickets.append((f"K-{i}", rng.choice(["OPS", "WEB"]), said, rng.choice(["", None, "kafka login"]), rng.choice([["datadog-log"], ["x"], None]), created, "Open", rng.choice(["To Do", "To Do", "Done"]), "Low"))
    queries = [(i, rng.choice(["OPS", "WEB", None]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 10))), rng.choice(["x file size y", None, "kafka"]), rng.choice([at(rng.randint(-10, 3100)), at(60 * rng.randint(0, 52))]), "e", "l") for i in range(150)]
    t = spark.createDataFrame(tickets, schemas.TICKETS)
    q = spark.createDataFrame(queries, "query_id long, project string, title string, message string, as_of timestamp, error_type string, logger string")
    for most in (5, 100):
        config = replace(RunConfig(), search_max_results=most)
        n = config.candidates
        want = set()
        for i, project, title, message, as_of, _, _ in queries:
            words = [w for w in (title or "").split() if len(w) >= 4][:8]
            phrases = [p for p in similarity.PHRASES if p in f"{title} {message or ''}"]
            found = []
            for key, own, summary, description, labels, created, _, state, _ in tickets:
                said = f"{summary} {description or ''}".split()
                near = any(w in said for w in words) or any(p in summary or p in (description or "") for p in phrases) or "datadog-log" in (labels or [])
                if own == project and state != "Done" and near and created is not None and as_of - dt.timedelta(days=180) <= created <= as_of:
                    found.append((created, key))
            want |= {(i, key) for _, key in sorted(found, key=lambda x: (-x[0].timestamp(), x[1]))[:n]}
        got = [(r.query_id, r.key) for r in similarity.candidate_tickets(q, t, config).collect()]
        assert sorted(got) == sorted(want) and len(want) > 300


def test_the_index_does_not_grow_with_the_times_asked(spark):
    """The rows that are read for a question are two buckets a term, whatever other times are asked."""
    t = spark.createDataFrame([(f"K-{i}", "OPS", "database", "", ["datadog-log"], at(i), "Open", "To Do", "Low") for i in range(1000)], schemas.TICKETS)
    config = replace(RunConfig(), search_max_results=10)
    q = spark.range(2000).select(F.col("id").alias("query_id"), F.lit("OPS").alias("project"), F.lit("database").alias("title"), F.lit("").alias("message"), (F.lit(NOW) + F.make_interval(mins=(F.col("id") / 2).cast("int"))).alias("as_of"))
    got = similarity.candidate_tickets(q, t, config)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert got.count() == sum(min(10, i // 2 + 1) for i in range(2000))


def test_error_types_of_one_day(spark):
    """10^5 candidates and 3,000 tickets of one type and day: no row for each pair of them."""
    n = 100_000
    cands = spark.range(n).select(F.col("id").alias("cand_id"), F.lit("OPS").alias("project"), F.lit(" TimeOut ").alias("error_type"), (F.lit(NOW) + F.make_interval(secs=(F.col("id") % 80_000).cast("int"))).alias("as_of"))
    made = [(f"K-{i}", "OPS", "s", "d", ["datadog-log", "timeout"], at(i // 3), "Open", "To Do", "Low") for i in range(3000)]
    hits = dedup.dup_error_type(cands, spark.createDataFrame(made, schemas.TICKETS), 7)
    assert hits.count() == n
    newest = lambda second: max((created, key) for key, _, _, _, _, created, *_ in made if created <= NOW + dt.timedelta(seconds=second))[1]
    for r in hits.where("cand_id in (0, 59, 60, 12345, 79999, 99999)").collect():
        assert r.ticket_key == newest(r.cand_id % 80_000)


def test_error_types_against_all_pairs(spark):
    rng = random.Random(6)
    kinds = ["timeout", "disk", "unknown", "", None]
    made = [(f"K-{i}", rng.choice(["OPS", "WEB"]), "s", "d", rng.choice([["datadog-log", "timeout"], ["datadog-log", "disk", "timeout"], ["timeout"], None]), rng.choice([at(60 * rng.randint(0, 600)), None]), "Open", "Done", "Low") for i in range(400)]
    cands = [(i, rng.choice(["OPS", "WEB", None]), rng.choice(kinds), at(60 * rng.randint(-10, 900))) for i in range(300)]
    want = {}
    for i, project, kind, as_of in cands:
        found = [(m[5], m[0]) for m in made if m[1] == project and kind not in ("unknown", "", None) and m[4] and {"datadog-log", kind} <= set(m[4]) and m[5] and as_of - dt.timedelta(days=2) <= m[5] <= as_of]
        if found:
            want[i] = max(found)[1]
    c = spark.createDataFrame(cands, "cand_id long, project string, error_type string, as_of timestamp")
    got = {r.cand_id: r.ticket_key for r in dedup.dup_error_type(c, spark.createDataFrame(made, schemas.TICKETS), 2).collect()}
    assert got == want and len(want) > 40
