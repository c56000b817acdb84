"""Operators on small tables, and order-dependent ones against plain Python."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from faultline import schemas
from faultline.config import RunConfig
from faultline.functions import payload
from faultline.operators import classify, dedup, filters, investigate, report, similarity
from faultline.operators import tickets as ticket_ops
from faultline.plans import bases, jobs

NOW = dt.datetime(2024, 3, 1)
LOG = "seq long, message string, logger string, service string, env string, status string, ts timestamp, thread string, detail string, timestamp string"


def logs_of(spark, messages, logger="com.x.A", service="shop"):
    return spark.createDataFrame([(i, m, logger, service, "prod", "error", NOW, f"t{i}", "", "") for i, m in enumerate(messages)], LOG)


def tickets_of(spark, rows):
    full = [(k, "OPS", s, d, lab, NOW - dt.timedelta(days=age), st, "Done" if st == "Done" else "To Do", "Low") for k, s, d, lab, age, st in rows]
    return spark.createDataFrame(full, schemas.TICKETS)


def team_table(spark, cap=None, services=("shop",)):
    return spark.createDataFrame([("t1", "One", "OPS", list(services), "prod", True, cap, {}), ("t2", "Two", "OPS", ["shop"], "prod", False, 1, {})], schemas.TEAMS)


def test_lcs_and_ratio(spark):
    rng = random.Random(2)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b):
                prev, row[j + 1] = row[j + 1], max(row[j + 1], row[j], prev + 1 if x == y else 0)
        return row[-1]

    texts = ["".join(rng.choice("ab cé🙂") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 90, 130, 200]))) for _ in range(400)]
    a, b = texts[::2], texts[1::2]
    assert similarity.lcs_lengths(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
    assert similarity.lcs_lengths([], []).tolist() == [] and similarity.lcs_lengths(["abc"], [""]).tolist() == [0]
    cases = [("database connection error",) * 2, ("database connection error", "database connection failed"), ("database connection error", "user authentication failed"), ("x", ""), ("", "")]
    got = [r.r for r in similarity.with_ratio(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string"), "a", "b", "r").orderBy("i").collect()]
    assert got[0] == 1.0 and round(got[1], 4) == 0.8636 and got[2] < 0.5 and got[3:] == [0.0, 0.0]


def test_filters(spark):
    df = logs_of(spark, ["Read timeout", "disk FULL", "401 unauthorized", "fine"]).withColumn("status", F.when(F.col("seq") == 3, "warn").otherwise("error"))
    ids = lambda d: sorted(r.seq for r in d.collect())
    assert ids(filters.filter_logs(df, "shop", "prod", "", "TIMEOUT, full", "OR")) == [0, 1]
    assert ids(filters.filter_logs(df, "shop", "prod", "error,warn")) == [0, 1, 2, 3]
    assert ids(filters.filter_logs(df, "shop", "prod", "error", None, "AND", 1, NOW)) == [0, 1, 2]
    assert ids(filters.template_filter(df, "authentication")) == [2]
    assert filters.probe_without_extra(df, "prod", "error", "nowhere").first().relaxed_hits == 4
    assert ids(filters.cap_pages(df, 1, 2)) == [0, 1]
    asked = spark.createDataFrame([("q", "why read timeout in shop-service", None, "prod", False), ("r", "unauthorized", "shop", "prod", False)], "question_id string, query string, service string, env string, all_status boolean")
    assert [(r.question_id, r.seq) for r in filters.rule_query_filter(df, asked).collect()] == [("r", 2)]
    tickets = tickets_of(spark, [("A-1", "Read timeout", "x", [], 1, "Open"), ("A-2", "Read timeout", "y", [], 2, "Done"), ("A-3", "other", "z", [], 3, "Open")])
    q = spark.createDataFrame([(1, "OPS", "the READ timeout")], "query_id long, project string, query string")
    assert [r.key for r in filters.search_tickets(tickets, q, "open").collect()] == ["A-1"]
    assert [r.key for r in filters.search_tickets(tickets, q, "done").collect()] == ["A-2"]


def test_classifier(spark):
    df = logs_of(spark, ["Database connection failed", "Kafka consumer error", "all good", "HTTP 404 not found error", "fatal: disk full"])
    got = {r.seq: r for r in classify.classify(df).collect()}
    assert (got[0].error_type, got[0].severity, got[0].ticket_title) == ("database-connection", "high", "Database Connection Failed in A")
    assert abs(got[0].confidence - 0.9) < 1e-9 and got[0].create_ticket
    assert got[1].error_type == "kafka-consumer" and got[2].confidence == 0.0 and not got[2].create_ticket
    assert got[4].severity == "high" and "**Possible Causes**\n\n- System configuration issues" in got[4].ticket_description
    answered = classify.analyse(df.withColumn("answer", F.when(F.col("seq") == 0, '{"ticket_title": "T", "ticket_description": "D"}')))
    got = {r.seq: r for r in answered.collect()}
    assert got[0].ticket_title == "T" and not got[0].fallback_analysis and got[1].fallback_analysis
    assert classify.classification_stats(classify.classify(df.limit(0))).first().pattern_match_rate == 0.0


def candidates(spark, rows):
    full = [(i, "r", "OPS", i, 2, fp, h, e, True, d, s) for i, (fp, h, e, d, s) in enumerate(rows)]
    return spark.createDataFrame(full, "cand_id long, run_id string, project string, seq long, cap int, fingerprint string, loghash string, error_type string, create_ticket boolean, decision string, strategy_name string")


def test_in_run(spark):
    rows = [("f1", "h1", "X", None, None), ("f2", "h1", "Y", None, None), ("f3", "h2", "Y", None, None), ("f1", "h9", "Z", None, None), ("f4", "h3", "X", None, None), ("f5", "h5", "Q", None, None), ("f4", "h7", "Z", None, None)]
    got = [r.in_run for r in dedup.resolve_in_run(candidates(spark, rows)).orderBy("cand_id").collect()]
    assert got == ["created", "duplicate-jira", "created", "duplicate-fingerprint", "duplicate-error-type", "cap-reached", "duplicate-fingerprint"]
    found = [("f1", "h1", "X", "duplicate-jira", "similarity"), ("f1", "h2", "W", None, None), ("f2", "h3", "V", "duplicate-jira", "loghash"), ("f2", "h4", "U", None, None)]
    got = [r.in_run for r in dedup.resolve_in_run(candidates(spark, found)).orderBy("cand_id").collect()]
    assert got == ["duplicate-jira", "duplicate-fingerprint", "duplicate-jira", "created"]
    assert {r.in_run for r in dedup.resolve_in_run(candidates(spark, rows), dry_run=True).collect()} == {"simulated"}


def test_in_run_by_windows(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        kind = rng.choice("ABCD")
        h = kind + str(rng.randint(0, 4))
        rows.append((h, h, kind, None, None))
    cands = candidates(spark, rows)
    key = lambda d: sorted(map(tuple, d.collect()))
    exact, fast = key(dedup.resolve_in_run(cands)), key(dedup.resolve_in_run(cands, exact=False))
    assert [x[0] for x in exact] == [x[0] for x in fast]
    assert [x[1] == "created" for x in exact] == [x[1] == "created" for x in fast]


def test_caps(spark):
    for cap in (1, 2, 5):
        df = spark.createDataFrame([(i, "r", i, cap) for i in range(8)], "cand_id long, run_id string, seq long, cap int")
        assert dedup.apply_cap(df).where("decision = 'created'").count() == cap


def test_cooldown(spark):
    rng = random.Random(8)
    data = sorted((rng.choice("ab"), NOW + dt.timedelta(minutes=rng.randint(0, 2000))) for _ in range(200))
    df = spark.createDataFrame([("t", k, ts) for k, ts in data], "team_id string, ticket_key string, ts timestamp")
    want, last = [], {}
    for k, ts in data:
        ok = k not in last or ts - last[k] >= dt.timedelta(minutes=120)
        if ok:
            last[k] = ts
        want.append((k, ts, ok))
    got = [(r.ticket_key, r.ts, r.allowed) for r in dedup.comment_cooldown(df, 120).collect()]
    assert sorted(got) == sorted(want)
    assert all(r.allowed for r in dedup.comment_cooldown(df, 0).collect())
    one = spark.createDataFrame([("t", "a", NOW)], "team_id string, ticket_key string, ts timestamp")
    for last_ts, ok in (("2024-02-29T23:55:00Z", False), ("2024-02-29T23:45:00Z", True), ("nonsense", True)):
        last_df = spark.createDataFrame([("t", "a", last_ts)], "team_id string, ticket_key string, last_ts string")
        assert dedup.comment_cooldown(one, 10, last_df).first().allowed is ok


def test_duplicates_of_tickets(spark):
    tickets = tickets_of(spark, [
        ("A-1", "Database connection failed", "Original Log: Database connection failed for user 1", ["datadog-log"], 20, "Open"),
        ("A-2", "Old", "x", ["datadog-log", "timeout"], 9, "Open"), ("A-3", "New", "x", ["datadog-log", "timeout"], 3, "Done"), ("A-4", "n", "x", ["loghash-abc"], 5, "Open"), ("A-5", "n", "x", ["loghash-abc"], 4, "Done"),
    ])
    c = spark.createDataFrame([(1, "OPS", "abc", "timeout", NOW), (2, "OPS", "", "unknown", NOW)], "cand_id long, project string, loghash string, error_type string, as_of timestamp")
    assert [(r.cand_id, r.ticket_key) for r in dedup.dup_label(c, tickets).collect()] == [(1, "A-4")]
    assert [(r.cand_id, r.ticket_key) for r in dedup.dup_error_type(c, tickets).collect()] == [(1, "A-3")]
    q = spark.createDataFrame([(7, "OPS", "Database connection failed", "Database connection failed for user 1", NOW, "x", "y"), (8, "OPS", "nothing alike at all", "zzz", NOW, "x", "y")], "query_id long, project string, title string, message string, as_of timestamp, error_type string, logger string")
    assert [(r.query_id, r.key, r.score) for r in similarity.dup_similarity(q, tickets, RunConfig()).collect()] == [(7, "A-1", 1.0)]
    labelled = {r.key: r.labels for r in dedup.merge_ticket_labels(tickets, spark.createDataFrame([("A-1", "h"), ("A-1", "h")], "ticket_key string, loghash string")).collect()}
    assert labelled["A-1"] == ["datadog-log", "loghash-h"] and labelled["A-4"] == ["loghash-abc"]


def test_sketches_bound_ratios(spark):
    rng = random.Random(11)
    words = ["a", "an", "the", "disk", "disc", "full", "timeout", "time", "out", "error500", "0", "x" * 300, "connection", "connections", "noitcennoc"]
    text = lambda: " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 12])))
    both = [(text(), text()) for _ in range(1500)] + [("a b", "b a"), ("a", "a b"), ("", ""), ("", "a"), ("abc", "cab")]
    x, y = similarity.Sketches([a for a, _ in both]), similarity.Sketches([c for _, c in both])
    i = np.arange(len(both))
    top = similarity.tops(x, x.held(), i, y, i)
    found = similarity.with_ratio(spark.createDataFrame([(k, a, c) for k, (a, c) in enumerate(both)], "i int, a string, c string"), "a", "c", "r")
    ratio = {r.i: r.r or 0.0 for r in found.collect()}
    assert all(ratio[k] <= top[k] + 1e-9 for k in i) and sum(top[k] < 0.8 for k in i) > 300
    assert all(abs(ratio[k] - similarity.ratio_of(*both[k])) < 1e-9 for k in i)


def test_sketches_leave_all_that_counts(spark, monkeypatch):
    """The same scores with and without them, whatever the thresholds, also where tickets come in many blocks; and far fewer pairs."""
    rng = random.Random(12)
    words = ["database", "connection", "failed", "timeout", "gateway", "orders", "disk", "full", "user", "token", "expired", "report", "kafka", "offset"]
    said = lambda k: " ".join(rng.choices(words, k=k))
    tickets = tickets_of(spark, [(f"A-{i}", said(6), f"Original Log: {said(9)}" if i % 2 else said(20), ["datadog-log"], i + 1, "Open") for i in range(24)]).coalesce(1)
    held = [(r.summary, r.description.split(": ")[-1]) for r in tickets.collect()]
    asked = [(i, "OPS", said(6), said(rng.choice([3, 9, 30])), NOW, rng.choice(["timeout", "x", None]), rng.choice(["kafka", None, "y"])) for i in range(40)]
    asked += [(40 + i, "OPS", a if i % 3 else said(5), c + " " + said(i % 2), NOW, "timeout", "kafka") for i, (a, c) in enumerate(held)]
    q = spark.createDataFrame(asked, "query_id long, project string, title string, message string, as_of timestamp, error_type string, logger string").coalesce(1)
    seen = []

    def counted(pairs, *rest):
        left = may_count(pairs, *rest, block=block)
        seen.append((pairs.count(), left.count(), left.distinct().count()))
        return left

    may_count = similarity.may_count
    for config in (RunConfig(), RunConfig(similarity_threshold=0.6, partial_log_threshold=0.5)):
        monkeypatch.setattr(similarity, "may_count", lambda pairs, *_: pairs)
        want = sorted(map(tuple, similarity.dup_similarity(q, tickets, config).collect()))
        monkeypatch.setattr(similarity, "may_count", counted)
        for block in (similarity.TICKETS, 9) if config == RunConfig() else (similarity.TICKETS,):
            assert sorted(map(tuple, similarity.dup_similarity(q, tickets, config).collect())) == want and len(want) > 20
    assert all(left == once for _, left, once in seen) and seen[0][1] < seen[0][0] * 3 / 4 and seen[0] == seen[1]
    assert similarity.dup_similarity(q.limit(0), tickets, RunConfig()).collect() == [] == similarity.dup_similarity(q, tickets.limit(0), RunConfig()).collect()


def test_seen(spark):
    df = dedup.with_keys(logs_of(spark, ["Error 123456 in a@b.com", "Error 999999 in c@d.com", "Other"])).withColumn("run_id", F.lit("r"))
    assert sorted((r.seq, r.seen) for r in dedup.first_seen(df).collect()) == [(0, 2), (2, 1)]
    assert [r.skipped for r in dedup.mark_seen(df).orderBy("seq").collect()] == [False, True, False]
    assert dedup.dedup_stats(df).first().duplicates_found == 1


def test_triage_of_repeats(spark):
    """Ten like logs with other file numbers make one ticket."""
    df = logs_of(spark, [f"failed to get file size by name {i}_x.dpplan, cause: status code 404, (blobnotfound) error" for i in range(10)])
    out = jobs.triage_job(df, team_table(spark), tickets_of(spark, []), spark.createDataFrame([], schemas.FINGERPRINTS), RunConfig(), NOW)
    rows = out["decisions"].collect()
    assert [r.decision for r in rows] == ["created"] and out["new_tickets"].count() == 1
    assert out["fingerprints"].count() == 2
    again = jobs.triage_job(df, team_table(spark), tickets_of(spark, []), out["fingerprints"], RunConfig(), NOW)
    assert [r.decision for r in again["decisions"].collect()] == ["duplicate-fingerprint"]


def test_triage_caps(spark):
    kinds = ["Database connection failed", "Kafka consumer error", "Authentication failed: token expired", "disk full", "out of memory error", "internal server error"]
    for cap in (1, 2, 5):
        out = jobs.triage_job(logs_of(spark, kinds), team_table(spark, cap), tickets_of(spark, []), spark.createDataFrame([], schemas.FINGERPRINTS), RunConfig(), NOW)
        assert out["decisions"].where("decision = 'created'").count() == cap


def test_payload(spark):
    df = spark.createDataFrame([("**T** " + "x" * 200, "email-not-found", "t1", "prod", "abc", {"b": "low", "a": "high"}, 3)], "ticket_title string, error_type string, team_id string, env string, loghash string, severity_rules map<string,string>, occurrences int")
    r = df.select(payload.ticket_title(RunConfig()).alias("title"), payload.ticket_labels(RunConfig(aggregate_email_not_found=True), ("x",)).alias("labels"), payload.contextual_log(df.columns).alias("said")).first()
    assert r.title.startswith("[Datadog][email-not-found] T x") and r.title.endswith("…") and len(r.title) == len("[Datadog][email-not-found] ") + 120
    assert r.labels == ["datadog-log", "t1", "env-prod", "x", "loghash-abc", "email-not-found", "aggregate-email-not-found"]
    assert r.said.endswith("[Occurrences in last 48h]: 3\n[Severity hints]: a=high, b=low") and "[Message]: <no message>" in r.said


def test_transitions_and_consolidation(spark):
    t = spark.createDataFrame([("A", 0, "1", "Go", "In Progress"), ("A", 1, "2", "x", "Won't Fix"), ("A", 2, "3", "x", "Closed"), ("B", 0, "4", "Resolve it", "Foo"), ("C", 0, "5", "Reopen", "Open")], "issue_key string, pos int, id string, name string, to_status string")
    assert {(r.issue_key, r.id) for r in ticket_ops.pick_transition(t).collect()} == {("A", "3"), ("B", "4")}
    g = spark.createDataFrame([("g", "P-10", "Open"), ("g", "P-9", "Open"), ("g", "X", "Done"), ("h", "P-1", "Open")], "group_id string, key string, status string")
    got = {(r.key, r.action): r for r in ticket_ops.consolidate(g).collect()}
    assert set(got) == {("P-10", "comment"), ("P-10", "link"), ("P-10", "close"), ("X", "skip"), ("P-9", "summary")}
    assert got["P-9", "summary"].detail == "Consolidated 1 tickets into P-9 (skipped 1 already closed)"


def test_report_fallbacks(spark):
    rows = spark.createDataFrame([(None, True, True, None), (None, False, True, None), (None, None, None, None)], "decision string, ticket_created boolean, duplicate boolean, create_ticket boolean")
    r = report.audit_summary(rows).first()
    assert (r.total, r.created, r.duplicates, r.unknown_decisions) == (3, 1, 2, 3)
    assert report.run_stats(spark.createDataFrame([], "action string, processing_s double, started timestamp, ended timestamp")).first().logs_per_s == 0.0


def test_investigation(spark):
    df = logs_of(spark, ["Payment gateway broke down", "Payment gateway broke down", "other thing"]).withColumn("question_id", F.lit("q"))
    patterns = investigate.unique_patterns(df)
    assert sorted((r.rank, r.seq) for r in patterns.collect()) == [(1, 0), (2, 2)]
    tickets = tickets_of(spark, [("A-1", "Payment gateway broke down", "", ["datadog-log"], 1, "Open"), ("A-2", "gateway something", "", [], 2, "Open")])
    asked = spark.createDataFrame([("q", "OPS", "gateway trouble", NOW)], "question_id string, project string, query string, as_of timestamp")
    got = investigate.correlate(patterns.withColumns({"project": F.lit("OPS"), "as_of": F.lit(NOW)}), tickets, asked, RunConfig())
    found = {r.key: r.score for r in got.collect()}
    assert found["A-2"] == 0.0 and found["A-1"] >= 0.5
    assert report.basic_analysis(df).first().summary == "Found 3 error logs. Most common pattern (2 occurrences): 'Payment gateway broke down...'. "


def test_plans_have_no_cross_join(spark):
    d = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(d):
        return
    from faultline.plans import catalog

    for name in ("search_tickets", "dup_label", "dup_error_type", "candidate_tickets", "first_seen", "audit_counts", "apply_cap"):
        plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name
        assert "Python" not in plan and "Arrow" not in plan, name
    plan = filters.rule_query_filter(bases.logs(spark, d), catalog.questions(spark, d))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Join" not in plan and "Exchange" not in plan  # one scan, nothing is shuffled
    plan = catalog.QUERIES["correlate"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert bases.teams(spark).count() == 4


def test_rule_query_filter_against_all_pairs(spark):
    """Terms inside longer words, questions without terms, ids, services and states."""
    rng = random.Random(3)
    words = ["time", "timeout", "Station", "nation", "reading", "read-only", "é-time", "x123e4567-e89b-12d3-a456-426614174000y", "Überraschung", "ok"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), "l", rng.choice(["pay-api", "web", None]), rng.choice(["prod", "dev"]), rng.choice(["error", "warn", None]), NOW, "t", "", "") for i in range(150)]
    rows += [rows[3], (900, None, "l", "web", "prod", "error", NOW, "t", "", "")]
    df = spark.createDataFrame(rows, LOG)
    queries = ["time", "the station nation", "id 123E4567-E89B-12D3-A456-426614174000", "what is in pay-api", "read only timeout", "", None, "nothing here matches"]
    asked = [(f"q{i}{k}", t, s, "prod", k) for i, t in enumerate(queries) for s in (None, "web") for k in (True, False)]
    asked = [(f"{q}{s}", t, s, e, k) for q, t, s, e, k in asked]
    e = spark.createDataFrame(asked, "question_id string, query string, service string, env string, all_status boolean")
    parts = e.select("question_id", "all_status", "env", "service", filters.extract_entities("query").alias("e")).collect()
    want = []
    for p in parts:
        service = p.service or (p.e.services[0] if p.e.services else None)
        terms = [u.lower() for u in p.e.uuids[:2]] + list(p.e.keywords[:5])
        for r in rows:
            if r[4] == p.env and (p.all_status or r[5] == "error") and (service is None or r[3] == service) and (not terms or r[1] is not None) and all(x in r[1].lower() for x in terms):
                want.append((p.question_id, r[0]))
    for block in (50_000, 5):
        got = [(r.question_id, r.seq) for r in filters.rule_query_filter(df, e, block).collect()]
        assert sorted(got) == sorted(want) and len({q for q, _ in want}) > 12
    assert filters.rule_query_filter(df, e.limit(0)).collect() == []


def test_caps_by_slices(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 10**6) * 10 + i % 10, 7) for i in range(400)]
    df = spark.createDataFrame(rows, "cand_id long, run_id string, seq long, cap int")
    want = {r[0] for run in ("a", "b", None) for r in sorted((r for r in rows if r[1] == run), key=lambda r: r[2])[:7]}
    for n in (20_000, 10):
        assert {r.cand_id for r in dedup.apply_cap(df, rows_a_slice=n).where("decision = 'created'").collect()} == want
    assert dedup.apply_cap(df).count() == 400 and dedup.apply_cap(df.limit(0)).collect() == []
