"""Reading log events, audit rows and fingerprints, and writing them."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions.text import parse_ts

DETAIL_LENGTH = 300


def read_log_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Search responses, one JSON document a line (or a file, if they span lines)."""
    return spark.read.schema(schemas.LOG_EVENTS).json(path)


def coerce_detail(value: Column, fallback: str = "no detailed log") -> Column:
    """A variant as text: objects and arrays as JSON, strings and numbers as they are, null as the fallback."""
    as_text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    text = F.when(value.isNull() | F.is_variant_null(value), F.lit(fallback)).otherwise(as_text)
    return F.when(F.char_length(text) > DETAIL_LENGTH, F.concat(F.left(text, F.lit(DETAIL_LENGTH)), F.lit("... [truncated]"))).otherwise(text)


def flatten_log_events(events: DataFrame, env: str = "prod") -> DataFrame:
    """A row for each event, with defaults for what is missing or null."""
    a = F.col("event.attributes")
    inner = a["attributes"]
    return events.select(F.explode("data").alias("event")).select(
        a["service"].alias("service"),
        F.lit(env).alias("env"),
        a["status"].alias("status"),
        a["host"].alias("host"),
        F.coalesce(inner["logger"]["name"], F.lit("unknown.logger")).alias("logger"),
        F.coalesce(inner["logger"]["thread_name"], F.lit("unknown.thread")).alias("thread"),
        F.coalesce(a["message"], F.lit("<no message>")).alias("message"),
        a["timestamp"].alias("timestamp"),
        coerce_detail(inner["properties"]["Log"]).alias("detail"),
        F.coalesce(inner["requestId"], inner["request_id"]).alias("request_id"),
        F.coalesce(inner["userId"], inner["user_id"]).alias("user_id"),
        F.coalesce(inner["errorType"], inner["error_type"]).alias("event_error_type"),
        parse_ts(a["timestamp"]).alias("ts"),
    )


def read_audit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Audit rows, one JSON object a line; blank and malformed lines are dropped.

    A row without team_id has that of its folder, teams/<id>/ or team_id=<id>/. Folders that don't exist are skipped if
    path is a pattern.
    """
    rows = spark.read.schema(schemas.AUDIT).option("mode", "DROPMALFORMED").json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"(?:/teams/|/team_id=)([^/]+)/", 1)
    return rows.withColumn("team_id", F.coalesce("team_id", F.nullif(folder, F.lit(""))))


def write_audit(rows: DataFrame, path: str) -> None:
    """Appends, in a folder for each team."""
    rows.write.mode("append").partitionBy("team_id").json(path)


def counters(counts: DataFrame) -> DataFrame:
    """(dim, value, n) as one row a dimension: a map in descending count."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("down"), "value", "n")))
    return counts.groupBy("dim").agg(F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["value"], p["n"]))).alias("counts"))


def export_report(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """rows as JSON, or as CSV with a header and the columns in the order of their names."""
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
    elif fmt == "csv":
        rows.select(sorted(rows.columns)).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"no such format: {fmt}")


def union_rows(*frames: DataFrame) -> DataFrame:
    """Rows of several teams or services with the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def merge_fingerprints(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct (team_id, fingerprint) of both; rows without a fingerprint don't count."""
    both = existing.select("team_id", "fingerprint").unionByName(new.select("team_id", "fingerprint"))
    return once(both, fingerprint=F.col("fingerprint")).where("fingerprint is not null and fingerprint <> ''").distinct()


class FingerprintStore:
    """The fingerprints of earlier runs, each once a team, in a folder that a crash leaves as it was.

    Rows lie in segments, folders of Parquet files that are never changed. The pointer, a small file, names the segments that
    count and the last batch that was added. A change writes its segment first and replaces the pointer last, in one rename:
    what fails before that is not seen by readers, and a batch that is added again after its pointer was replaced adds nothing.
    One writer at a time.
    """

    POINTER = "CURRENT.json"
    #: Segments beyond which a change writes all rows anew.
    SEGMENTS = 20

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> dict:
        """batch (-1: none yet), version and segments."""
        where, files = self._file(self.POINTER)
        if not files.exists(where):
            return {"version": 0, "batch": -1, "segments": []}
        stream = files.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        """(team_id, fingerprint); no rows where there is no store yet. What is read stays as it was when this was called."""
        segments = [f"{self.path}/{s}" for s in self.current()["segments"]]
        if not segments:
            return self.spark.createDataFrame([], schemas.FINGERPRINTS)
        return self.spark.read.schema(schemas.FINGERPRINTS).parquet(*segments)

    def write_segment(self, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        rows.select("team_id", "fingerprint").write.parquet(f"{self.path}/{name}")
        return name

    def swap(self, segments: list[str], batch: int) -> None:
        """Makes these the segments that count."""
        told = {"version": self.current()["version"] + 1, "batch": batch, "segments": segments}
        fresh, files = self._file(f".{self.POINTER}-{uuid.uuid4().hex}")
        out = files.create(fresh, True)
        try:
            out.write(bytearray(json.dumps(told).encode()))
        finally:
            out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(files.makeQualified(fresh), files.makeQualified(self._file(self.POINTER)[0]), options)

    def add(self, rows: DataFrame, batch: int | None = None) -> bool:
        """Adds what isn't there yet. batch: the number of a micro-batch; one that isn't beyond the last is not added again."""
        now = self.current()
        if batch is not None and batch <= now["batch"]:
            return False
        known = self.read()
        own = merge_fingerprints(self.spark.createDataFrame([], schemas.FINGERPRINTS), rows)
        new = own.alias("o").join(known.alias("k"), F.col("o.team_id").eqNullSafe(F.col("k.team_id")) & (F.col("o.fingerprint") == F.col("k.fingerprint")), "left_anti")
        if len(now["segments"]) >= self.SEGMENTS:
            segments = [self.write_segment(known.unionByName(new))]
        else:
            segments = [*now["segments"], self.write_segment(new)]
        self.swap(segments, now["batch"] if batch is None else batch)
        return True

    def replace_teams(self, rows: DataFrame) -> None:
        """rows instead of all that the store has of their teams. rows may read from the store."""
        teams = rows.select("team_id").distinct()
        known = self.read()
        others = known.alias("k").join(teams.alias("t"), F.col("k.team_id").eqNullSafe(F.col("t.team_id")), "left_anti")
        self.swap([self.write_segment(others.unionByName(merge_fingerprints(rows, rows)))], self.current()["batch"])

    def clean(self) -> None:
        """Removes segments that don't count: those of changes that failed, or were replaced. No reader may still use them."""
        where, files = self._file("")
        held = {self.POINTER, *self.current()["segments"]}
        for status in files.listStatus(where):
            if status.getPath().getName() not in held:
                files.delete(status.getPath(), True)


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """The store, or no rows where there is none yet."""
    return FingerprintStore(spark, path).read()


def write_fingerprints(rows: DataFrame, path: str) -> None:
    """Replaces what the store has of the teams in rows, which may read from it."""
    FingerprintStore(rows.sparkSession, path).replace_teams(rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Only a session on one machine (tests) may go without: it gets a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return _own_folder(context.applicationId)


@lru_cache(1)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"faultline-{application}-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for files that a job writes and reads again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """Checkpoints df in the shared folder, so that what follows doesn't compute or plan it again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    Spark moves filters below the columns they name, and so computes a costly one again for the filter and for each further
    use; it doesn't move them below an explode.
    """
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.withColumn("_once", made).select(*kept, *[F.col(f"_once.{name}").alias(name) for name in columns])


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_table(df: DataFrame, **options: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, so that what follows doesn't compute it anew.

    Once it is written, the shuffle files behind it are of no more use and are removed. drop_tables removes the table.
    options: of the Parquet writer.
    """
    spark = df.sparkSession
    path = new_folder(spark, "faultline")
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Removes tables of cut_table. Nothing that still is to be computed may read them."""
    for table in tables:
        remove_folder(table.sparkSession, table.cut_path)


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
