"""Costly columns are computed once, and long texts are aligned in time."""

import os
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline.functions import text as t
from faultline.operators import classify, dedup, similarity
from faultline.plans import bases as b
from faultline.plans import catalog, jobs
from faultline.sources import io
from faultline.streaming import streams


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_aligned_in_time():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh é", k=rng.randint(2000, 4000))) for _ in range(61)]
    began = time.monotonic()
    found = similarity.lcs_lengths(texts[:-1], texts[1:])
    assert time.monotonic() - began < 15 and (found > 900).all()  # about 150 s with a step for each 64 letters


def test_filters_do_not_normalize_again(spark):
    rows = spark.createDataFrame([(i, "Read FAILED 123456 a@b.co", "l") for i in range(3)], "seq int, message string, logger string")
    mask = t.MESSAGE_MASKS[1][0]
    for df in (dedup.with_keys(rows).where("loghash <> '' and norm <> ''"), io.once(rows, h=t.loghash("message")).where("h <> ''").select("h", F.length("h"))):
        assert optimized(df).count(mask) == 1 and df.count() == 3
    prints = rows.select(F.lit("t").alias("team_id"), t.fingerprint(F.lit("x"), "message").alias("fingerprint"))
    assert optimized(io.merge_fingerprints(prints.where("false"), prints)).count(mask) == 1


def test_neighbours(spark, tmp_path):
    docs = [(i, "ab"[i % 3 == 0], f"Text {i}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = catalog.neighbours(spark, str(tmp_path))
    want = {}
    for lang in "ab":
        own = [d for d in docs if d[1] == lang]
        want |= {x[0]: (x[2].lower(), y[2].lower()) for x, y in zip(own, own[1:])}
    assert {r.doc_id: (r.x, r.y) for r in pairs.collect()} == want
    assert "lead(" not in optimized(pairs)  # a window over a language is one task


def test_state_of_first_seen_holds_hashes(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([("m", "l")], "message string, logger string").withColumn("ts", F.timestamp_seconds(F.lit(0))).write.parquet(path)
    stream = streams.stream_first_seen(spark.readStream.schema("message string, logger string, ts timestamp").parquet(path), 1)
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark [_key" in plan and stream.columns[-1] == "log_key"


def test_masks_with_boundaries_of_ascii(spark):
    rows = spark.createDataFrame([("é" + "a" * 20 + "ü é",)], "v string")
    got = rows.select(t.mask_pii_basic("v", True).alias("sql"), t.mask_pii_basic("v").alias("python")).first()
    assert got.sql == "é<TOKEN>ü é" and got.python == "é" + "a" * 20 + "ü é"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_bounds_of_pairs_are_compiled(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # what Spark can't compile fails
    try:
        assert catalog.dup_similarity(spark, "/root/testdata/sf0.001").count() >= 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_rules_see_plain_parts_first(spark):
    texts = ["database link: connection did fail", "fail connection database", "error 412 is no error", "a bad\nrequest", "bad request", "no space is left", ""]
    rows = spark.createDataFrame([(v,) for v in texts], "v string")
    for rule in (*classify.RULES, classify.GENERIC):
        any_of = re.compile("|".join(rule.patterns))
        got = rows.select("v", classify.may_match(F.col("v"), rule.patterns).alias("may"), (classify.confidence(F.col("v"), rule) >= 0.8).alias("hit")).collect()
        assert all(r.may or not any_of.search(r.v) for r in got) and all(r.hit for r in got if any_of.search(r.v))
    plain = [r for r in classify.RULES if r.error_type == "disk-space"][0]
    assert [r.may for r in rows.select(classify.may_match(F.col("v"), plain.patterns).alias("may")).collect()] == [v == "no space is left" for v in texts]


def test_dup_label_is_its_sql(spark, tmp_path):
    """Also where nothing is left of a text, and beside letters that are not ASCII's."""
    texts = ["12345678", "99999999", "é123456 disk", "é654321 disk", "duplicate entry\x0bx for key", "duplicate entry y for key", "same words", "same words", None]
    spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLES["dup_label"]).fetchall())
    assert sorted(map(tuple, catalog.dup_label(spark, str(tmp_path)).collect())) == want and {0, 1, 3} <= {r[0] for r in want}


def test_ticket_descriptions_are_their_sql(spark, tmp_path):
    """Also of empty and null texts and sources, marks of quotes, and letters and spaces that are not ASCII's."""
    texts = ["", None, "plain", "disk Original Log: full", "Original Log:", "É.", "é123456 disk", "disk é1234567890ab", "mañana.web.log", "İstanbul", "http://x\u00a0y", "\u00a0failed to get file size by name \u2003", "x" * 4100, "{"]
    rows = [(i, v, s) for i, (v, s) in enumerate((v, s) for v in texts for s in ("web", "", None))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLES["ticket_descriptions"]).fetchall())
    assert sorted(map(tuple, catalog.ticket_descriptions(spark, str(tmp_path)).collect())) == want and want[0][1:] == ("\nweb", "")


def test_candidates_deal_narrow_logs(spark, monkeypatch):
    """first_seen sorts the rows of a task: a split of a file must not be one."""
    seen = []
    first_seen = dedup.first_seen
    monkeypatch.setattr(dedup, "first_seen", lambda logs: seen.append(optimized(logs)) or first_seen(logs))
    at = F.timestamp_seconds(F.lit(1704067200))
    logs = spark.range(60).select(F.col("id").alias("seq"), F.lit("disk full").alias("message"), F.lit("l").alias("logger"), F.lit("en").alias("service"), F.lit("prod").alias("env"), at.alias("ts"))
    got = jobs.candidates(logs, b.teams(spark), catalog.CONFIG).collect()
    assert [(r.seq, r.seen, r.occurrences) for r in got] == [(0, 60, 60)]
    assert "RepartitionByExpression [seq" in seen[0]


def test_jobs_normalize_messages_once(spark, tmp_path, monkeypatch):
    """Not once more to count raw messages, for each strategy that reads tickets' labels, or for each use of the store."""
    mask = t.MESSAGE_MASKS[1][0]
    spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 20 AS user_id", "'view' AS event_type", "1.0 AS value").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, "some text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    seen = []

    def kept(df):
        seen.append(optimized(df).count(mask))
        return settled(df)

    settled = jobs.settled
    for module in (jobs, io, dedup):
        monkeypatch.setattr(module, "settled", kept)
    jobs.candidates(b.messages(spark, d), b.teams(spark), catalog.CONFIG, catalog.AS_OF)
    assert seen == [1]
    del seen[:]
    catalog._triage_exact(spark, d)
    assert sorted(seen)[-4:] == [0, 1, 1, 1]  # store, tickets, candidates
