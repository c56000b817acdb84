"""Large runs and tickets, which are split over many tasks, against the plain folds."""

import datetime as dt
import random

from pyspark.sql import functions as F

from faultline.operators import dedup
from faultline.operators.components import components

NOW = dt.datetime(2024, 3, 1)
CANDS = "cand_id long, run_id string, project string, seq long, cap int, fingerprint string, loghash string, error_type string, create_ticket boolean, decision string, strategy_name string"


def plain_fold(rows, dry_run=False):
    """What each candidate comes to, one after the other."""
    out, state = {}, {}
    for i, run, _, _, cap, fp, h, kind, due, found, strategy in sorted(rows, key=lambda r: (r[3], r[0])):
        prints, hashes, kinds, made = state.setdefault(run, (set(), set(), set(), []))
        kind = kind or "unknown"
        if not due:
            said = "not-needed"
        elif found == "duplicate-fingerprint" or fp in prints:
            said = "duplicate-fingerprint"
        elif strategy == "loghash" or h and h in hashes:
            said = "duplicate-jira"
        elif strategy == "error_type" or kind in kinds:
            said = "duplicate-error-type"
            prints.add(fp)
        elif found:
            said = found
            prints.add(fp)
        elif dry_run:
            said = "simulated"
        elif cap and len(made) >= cap:
            said = "cap-reached"
        else:
            said = "created"
            made.append(i)
            prints.add(fp)
            hashes.add(h)
            kinds |= {kind} - {"", "unknown"}
        out[i] = said
    return out


def test_runs_by_components(spark):
    rng = random.Random(11)
    for cap, wide in ((0, 6), (3, 6), (2, 40), (9, 40), (None, 12)):
        rows = []
        for i in range(300):
            strategy = rng.choice([None] * 6 + ["fingerprint", "loghash", "error_type", "similarity"])
            found = dedup.DECISIONS[strategy] if strategy else None
            kind = rng.choice([None, "unknown", "", *[f"k{rng.randint(0, wide)}"] * 3])
            rows.append((i, rng.choice(["r", "r", "r", "s", None]), "OPS", rng.randint(0, 10**6), cap, f"f{rng.randint(0, 60 * wide // 6)}", rng.choice(["", f"h{rng.randint(0, wide * 6)}"]), kind, rng.random() > 0.1, found, strategy))
        df = spark.createDataFrame(rows, CANDS)
        for dry_run in (False, True):
            want = plain_fold(rows, dry_run)
            for rows_a_task in (100_000, 100):
                got = {r.cand_id: r.in_run for r in dedup.resolve_in_run(df, dry_run, rows_a_task=rows_a_task).collect()}
                assert got == want, (cap, wide, dry_run, rows_a_task)
        assert "cap-reached" in set(plain_fold(rows).values()) or not cap
    assert dedup.resolve_in_run(df.limit(0)).collect() == []


def test_one_large_run_on_many_tasks(spark):
    """A run of 10^5 candidates of 20,000 types: its parts are dealt over all tasks."""
    n = 100_000
    df = spark.range(n).select(
        F.col("id").alias("cand_id"), F.lit("r").alias("run_id"), F.lit("OPS").alias("project"), F.col("id").alias("seq"), F.lit(7).alias("cap"), F.concat(F.lit("f"), F.col("id") % 50_000).alias("fingerprint"),
        F.concat(F.lit("h"), F.col("id") % 50_000).alias("loghash"), F.concat(F.lit("t"), F.col("id") % 20_000).alias("error_type"), F.lit(True).alias("create_ticket"), F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("strategy_name"),
    )
    got = dedup.resolve_in_run(df, rows_a_task=1000)
    counts = {r.in_run: r["count"] for r in got.groupBy("in_run").count().collect()}
    assert counts["created"] == 7 and sum(counts.values()) == n
    assert sorted(r.cand_id for r in got.where("in_run = 'created'").collect()) == list(range(7))
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_large_runs_are_dealt_once(spark):
    """The fold up to the cap reads the rows where the first one did, without another shuffle."""
    rows = [(i, "r" if i % 9 else None, "OPS", 500 - i, 3, f"f{i % 50}", f"h{i % 40}", f"k{i % 30}", True, None, None) for i in range(500)]
    got = dedup.resolve_in_run(spark.createDataFrame(rows, CANDS), rows_a_task=20)
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1  # that of small runs
    assert {r.cand_id: r.in_run for r in got.collect()} == plain_fold(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[root(a)] = root(b)
    for last in (1 << 16, 3):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), last=last).collect()}
        assert set(got) == {v for a, b in edges if a != b for v in (a, b)}
        assert {(got[a] == got[b]) == (root(a) == root(b)) for a in got for b in got} == {True}


def test_hot_tickets_by_links(spark):
    rng = random.Random(12)
    data = [(rng.choice(["t", None]), rng.choice("aaaab"), NOW + dt.timedelta(seconds=rng.choice([60, 7]) * rng.randint(0, 2000))) for _ in range(900)] + [("t", "a", None), ("t", "c", None), ("t", "a", NOW)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, team_id string, ticket_key string, ts timestamp")
    earlier = spark.createDataFrame([("t", "a", "2024-02-29T23:55:00Z"), ("t", "b", "nonsense"), (None, "a", "2024-03-01T03:00:00Z"), ("t", "b", "2024-03-01T00:10:00Z")], "team_id string, ticket_key string, last_ts string")
    told = {("t", "a"): dt.datetime(2024, 2, 29, 23, 55), (None, "a"): dt.datetime(2024, 3, 1, 3), ("t", "b"): dt.datetime(2024, 3, 1, 0, 10)}
    for last, known in ((None, {}), (earlier, told)):
        want = []
        before = dict(known)
        for team, ticket, ts in sorted((r for r in data if r[2]), key=lambda r: r[2]):
            ok = (team, ticket) not in before or ts - before[team, ticket] >= dt.timedelta(minutes=30)
            if ok:
                before[team, ticket] = ts
            want.append((team, ticket, ts, ok))
        want += [(*r, False) for r in data if r[2] is None]
        for times_a_task in (100_000, 100):
            got = dedup.comment_cooldown(df, 30, last, times_a_task)
            assert got.columns == [*df.columns, "allowed"]
            assert sorted(((r.team_id, r.ticket_key, r.ts, r.allowed) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 20
