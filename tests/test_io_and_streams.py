"""Sources, sinks and streams."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import dedup, report
from faultline.sources import io
from faultline.streaming import streams

NOW = dt.datetime(2024, 3, 1)


def event(message="m", log="x", **more):
    inner = {"logger": {"name": "com.x", "thread_name": "t"}, "properties": {"Log": log}} | more
    return {"attributes": {"message": message, "timestamp": "2024-03-01T00:00:00Z", "service": "s", "status": "error", "host": "h", "attributes": inner}}


def write_events(path, *events):
    path.mkdir(exist_ok=True)
    name = path / f"{len(list(path.iterdir()))}.json"
    name.write_text(json.dumps({"data": list(events), "meta": {"page": {"after": None}}}))


def test_events(spark, tmp_path):
    write_events(tmp_path / "in", event(log={"a": "café"}), event(log=[1, 2]), event(log=None), event(log=42), event(log="y" * 400), {"attributes": {"service": "s"}})
    rows = io.flatten_log_events(io.read_log_events(spark, str(tmp_path / "in"))).collect()
    assert [r.detail for r in rows[:4]] == ['{"a":"café"}', "[1,2]", "no detailed log", "42"]
    assert rows[4].detail == "y" * 300 + "... [truncated]"
    assert (rows[5].logger, rows[5].thread, rows[5].message, rows[5].detail) == ("unknown.logger", "unknown.thread", "<no message>", "no detailed log")
    assert rows[0].ts == NOW


def test_audit_files(spark, tmp_path):
    folder = tmp_path / "teams" / "alpha"
    folder.mkdir(parents=True)
    (folder / "audit_logs.jsonl").write_text('{"decision": "created", "occurrences": 2}\n\nnot json\n{"decision": "simulated"}\n')
    rows = io.read_audit(spark, str(tmp_path / "teams" / "*"))
    assert sorted((r.team_id, r.decision) for r in rows.collect()) == [("alpha", "created"), ("alpha", "simulated")]
    io.write_audit(rows, str(tmp_path / "out"))
    io.write_audit(rows, str(tmp_path / "out"))
    assert io.read_audit(spark, str(tmp_path / "out")).where("team_id = 'alpha'").count() == 4
    io.export_report(rows.select("team_id", "decision"), str(tmp_path / "csv"), "csv")
    assert "decision,team_id" in "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    [counts] = [r.counts for r in io.counters(report.audit_counts(rows, "decision")).collect()]
    assert counts == {"created": 1, "simulated": 1}


def test_fingerprints(spark, tmp_path):
    a = spark.createDataFrame([("t", "x"), ("t", "x"), ("t", "")], schemas.FINGERPRINTS)
    path = str(tmp_path / "store")
    assert io.read_fingerprints(spark, path).count() == 0
    streams.keep_fingerprints(path)(a, 0)
    streams.keep_fingerprints(path)(a.unionByName(spark.createDataFrame([("u", "y")], schemas.FINGERPRINTS)), 1)
    assert sorted(map(tuple, io.read_fingerprints(spark, path).select("team_id", "fingerprint").collect())) == [("t", "x"), ("u", "y")]
    assert streams.stream_new_fingerprints(a, spark.createDataFrame([("t", "x")], schemas.FINGERPRINTS)).count() == 1


def drain(df, name, tmp_path, mode="append"):
    with streams.state_in_rocksdb(df.sparkSession):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / ("cp" + name))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    drain.progress = q.recentProgress
    return df.sparkSession.sql(f"select * from {name}")


def test_store_after_a_crash(spark, tmp_path, monkeypatch):
    row = lambda *fs: spark.createDataFrame([("t", f) for f in fs], schemas.FINGERPRINTS)
    held = lambda: sorted(r.fingerprint for r in store.read().collect())
    store = io.FingerprintStore(spark, str(tmp_path / "store"))
    assert store.add(row("a", "b"), 0) and not store.add(row("z"), 0) and held() == ["a", "b"]
    with monkeypatch.context() as m:
        m.setattr(io.FingerprintStore, "swap", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        try:
            store.add(row("c"), 1)
            raise AssertionError("it should have been killed")
        except RuntimeError:
            pass
    assert held() == ["a", "b"] and store.current()["batch"] == 0  # written, but not swapped: nothing has changed
    assert store.add(row("b", "c", "c"), 1) and not store.add(row("b", "c"), 1) and held() == ["a", "b", "c"]
    folders = lambda: sum(p.is_dir() for p in (tmp_path / "store").iterdir())
    assert folders() == 3
    store.clean()
    assert folders() == 2 and held() == ["a", "b", "c"]
    io.write_fingerprints(store.read().where("fingerprint <> 'a'").unionByName(spark.createDataFrame([("u", "x")], schemas.FINGERPRINTS)), store.path)
    assert held() == ["b", "c", "x"] and store.current()["batch"] == 1
    monkeypatch.setattr(io.FingerprintStore, "SEGMENTS", 2)
    for k in range(2, 6):
        store.add(row(f"n{k}"), k)
        assert len(store.current()["segments"]) <= 3
    assert held() == ["b", "c", "n2", "n3", "n4", "n5", "x"] and store.current()["version"] == 7


def batches_stream(spark, tmp_path, batches, schema):
    """A stream that takes one of these batches of rows after the other."""
    import os

    path = str(tmp_path / "batches")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for f in (tmp_path / "batches").glob("*.parquet"):
            if f.stat().st_mtime > 1_600_000_000:
                os.utime(f, (1_500_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_of_logs(spark, tmp_path):
    for i in range(3):
        write_events(tmp_path / "in", event(f"failed for user{i}@x.com"), event("other"))
    seen = drain(streams.stream_first_seen(streams.stream_logs(spark, str(tmp_path / "in")), 24), "seen", tmp_path)
    assert sorted(r.norm for r in seen.collect()) == ["failed for email", "other"]


def rows_stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path), spark.read.parquet(path)


def test_trends_and_bursts(spark, tmp_path):
    rows = [(NOW + dt.timedelta(minutes=37 * i), ["created", "duplicate-jira", None][i % 3], "ab"[i % 2]) for i in range(40)] + [(NOW + dt.timedelta(days=9), None, "z")]
    stream, batch = rows_stream(spark, tmp_path, rows, "ts timestamp, decision string, fingerprint string")
    got = drain(streams.stream_trends(stream), "trends", tmp_path).where(F.col("start") < NOW + dt.timedelta(days=8)).collect()
    want = streams.stream_trends(batch).where(F.col("start") < NOW + dt.timedelta(days=8)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 20
    ended = drain(streams.error_bursts(stream, "50 minutes"), "bursts", tmp_path).where("fingerprint <> 'z'").collect()
    whole = streams.error_bursts(batch, "50 minutes").where("fingerprint <> 'z'").collect()
    assert sorted(map(str, ended)) == sorted(map(str, whole))


def test_stream_cooldown(spark, tmp_path):
    rows = [("t", "a", NOW + dt.timedelta(minutes=m)) for m in (0, 5, 15, 16, 40)]
    stream, _ = rows_stream(spark, tmp_path, rows, HITS)
    got = drain(streams.stream_comment_cooldown(stream, 10), "cooled", tmp_path).orderBy("ts").collect()
    assert [r.allowed for r in got] == [True, False, True, False, True]


HITS = "team_id string, ticket_key string, ts timestamp"


def test_cooldown_over_micro_batches_equals_the_table(spark, tmp_path):
    """Several micro-batches, unordered inside and overlapping by less than the lateness; at the end only the last ticket has state."""
    rng = random.Random(7)
    rows = sorted(((rng.choice("ts"), rng.choice("abc"), NOW + dt.timedelta(minutes=rng.randint(0, 1500))) for _ in range(300)), key=lambda r: r[2])
    batches = [rows[k : k + 75] for k in range(0, 300, 75)]
    for batch in batches:
        rng.shuffle(batch)
    batches.append([("t", "z", NOW + dt.timedelta(days=9))])
    stream = batches_stream(spark, tmp_path, batches, HITS)
    got = drain(streams.stream_comment_cooldown(stream, 45), "batched", tmp_path).collect()
    want = dedup.comment_cooldown(spark.createDataFrame(sum(batches, []), HITS), 45).select("team_id", "ticket_key", "ts", "allowed").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    data = [p for p in drain.progress if p.numInputRows]
    assert len(data) == 5 and drain.progress[-1].stateOperators[0].numRowsTotal == 1


def test_first_seen_forgets(spark, tmp_path):
    """A key comes again once its window is over; what is late is dropped; state doesn't grow with the keys ever seen."""
    hour = lambda h: NOW + dt.timedelta(hours=h)
    batches = [[(f"Disk {k} full" if h else "Login failed", "x", hour(h)) for k in ("a", "b", "c")] for h in range(0, 24, 2)]
    batches.insert(7, [("Login failed", "x", hour(13)), ("Too late", "x", hour(0))])
    stream = batches_stream(spark, tmp_path, batches, "message string, logger string, ts timestamp")
    seen = drain(streams.stream_first_seen(stream, 3), "forgets", tmp_path).collect()
    assert sorted(r.ts for r in seen if r.norm == "login failed") == [hour(0), hour(13)]
    assert not [r for r in seen if r.norm == "too late"]
    times = sorted(r.ts for r in seen if r.norm == "disk a full")
    assert times[0] == hour(2) and 2 < len(times) < 11 and all(y - x > dt.timedelta(hours=3) for x, y in zip(times, times[1:]))
    assert max(p.stateOperators[0].numRowsTotal for p in drain.progress) <= 5
