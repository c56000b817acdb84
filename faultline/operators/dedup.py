"""Finding logs that a ticket or an earlier log already covers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.config import RunConfig
from faultline.functions.text import fingerprint, log_key, logger_fingerprint, loghash_of, normalize_log_message
from faultline.operators.asof import last_before, numbered, same
from faultline.operators.components import components
from faultline.operators.similarity import dup_similarity
from faultline.sources.io import cut_table, drop_tables, once, settled

HITS = "cand_id long, ticket_key string, score double, message string"
# Which decision a strategy leads to.
DECISIONS = {"fingerprint": "duplicate-fingerprint", "loghash": "duplicate-jira", "error_type": "duplicate-error-type", "similarity": "duplicate-jira"}


class DedupStrategy(Protocol):
    """A strategy: (candidates, tickets, config) to hits (cand_id, ticket_key, score, message), one for a candidate at most."""

    def __call__(self, cands: DataFrame, tickets: DataFrame, config: RunConfig) -> DataFrame: ...


def with_keys(logs: DataFrame) -> DataFrame:
    """Adds norm, loghash and log_key; the message is normalised once."""
    logs = once(logs, norm=normalize_log_message("message"))
    return logs.withColumns({"loghash": loghash_of("norm"), "log_key": log_key("logger", "message", "norm")})


def with_fingerprints(cands: DataFrame) -> DataFrame:
    """Adds fingerprint and logger_fingerprint to rows with norm and error_type."""
    return cands.withColumns({"fingerprint": fingerprint("error_type", "message", "norm"), "logger_fingerprint": logger_fingerprint("logger", "message", "norm")})


def route_to_teams(logs: DataFrame, teams: DataFrame, config: RunConfig, team: str | None = None) -> DataFrame:
    """Logs of the services of enabled teams, with team_id, project, cap, severity_rules and run_id (team|service).

    The table of teams is configuration; Spark broadcasts it if it is as small as that.
    """
    active = teams.where("enabled" if team is None else (F.col("enabled") & (F.col("team_id") == team)))
    routes = active.select(
        "team_id", F.col("project_key").alias("project"), F.explode("services").alias("service"), "env",
        F.coalesce("max_tickets_per_run", F.lit(config.max_tickets_per_run)).alias("cap"), "severity_rules",
    )
    return logs.join(routes, ["service", "env"]).withColumn("run_id", F.concat_ws("|", "team_id", "service"))


def occurrences(logs: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds how often the run has the raw logger and message. Counts are combined before they are shuffled."""
    key = [run, F.sha1(F.concat_ws("|", "logger", "message")).alias("_raw")]
    counts = logs.groupBy(*key).agg(F.count("*").alias("occurrences"))
    return logs.withColumn("_raw", F.sha1(F.concat_ws("|", "logger", "message"))).join(counts, [run, "_raw"], "left").withColumn("occurrences", F.coalesce("occurrences", F.lit(1))).drop("_raw")


def first_seen(logs: DataFrame, run: str = "run_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The first log (by seq) of each run and log_key, with `seen` (how many there are).

    An aggregate, not a window: one error that is most of the traffic is reduced before the shuffle.
    """
    keep = keep or tuple(c for c in logs.columns if c not in (run, "log_key", "seq"))
    grouped = logs.groupBy(run, F.sha1("log_key").alias("_key")).agg(F.min_by(F.struct("seq", "log_key", *keep), F.col("seq")).alias("_first"), F.count("*").alias("seen"))
    return grouped.select(run, "_first.*", "seen")


def mark_seen(logs: DataFrame, run: str = "run_id") -> DataFrame:
    """All logs with `skipped`: true for all but the first of each run and log_key."""
    first = logs.groupBy(run, F.sha1("log_key").alias("_key")).agg(F.min("seq").alias("_seq"))
    return logs.withColumn("_key", F.sha1("log_key")).join(first, [run, "_key"]).withColumn("skipped", F.col("seq") > F.col("_seq")).drop("_key", "_seq")


def dup_fingerprint(cands: DataFrame, processed: DataFrame) -> DataFrame:
    """Candidates whose fingerprint, or logger fingerprint, an earlier run of the team has processed."""
    known = processed.select("team_id", "fingerprint").distinct()
    either = F.explode(F.array_distinct(F.array("fingerprint", "logger_fingerprint") if "logger_fingerprint" in cands.columns else F.array("fingerprint")))
    hit = cands.select("cand_id", "team_id", either.alias("fingerprint")).join(known, ["team_id", "fingerprint"], "left_semi").select("cand_id").distinct()
    return hit.select("cand_id", F.lit(None).cast("string").alias("ticket_key"), F.lit(1.0).alias("score"), F.lit("fingerprint already processed").alias("message"))


def dup_label(cands: DataFrame, tickets: DataFrame, prefix: str = "loghash", column: str | None = None) -> DataFrame:
    """Candidates with an open ticket of the project labelled <prefix>-<hash>; the newest such ticket.

    Tickets are reduced to the newest of each project and label first, so the join adds no rows.
    """
    open_ = tickets.where("status_category <> 'Done'").select("project", "key", "created", F.explode("labels").alias("label")).where(F.col("label").startswith(prefix + "-"))
    newest = open_.groupBy("project", "label").agg(F.max_by("key", F.struct("created", "key")).alias("ticket_key"))
    own = F.col(column or prefix)
    asked = once(cands.select("cand_id", "project", own.alias("_hash")), _hash=F.col("_hash")).where("_hash <> ''")
    hit = asked.select("cand_id", "project", F.concat(F.lit(prefix + "-"), "_hash").alias("label")).join(newest, ["project", "label"])
    return hit.select("cand_id", "ticket_key", F.lit(1.0).alias("score"), F.concat(F.lit("label "), "label").alias("message"))


def dup_error_type(cands: DataFrame, tickets: DataFrame, days: int = 7) -> DataFrame:
    """Candidates whose project has a ticket, open or not, labelled datadog-log and with the error type, of the last days.

    `as_of` of the candidate is the end of the window; of several tickets the newest counts, of equally new ones the largest
    key. An as-of join: the last ticket before each distinct (project, type, as_of), which then has to be new enough.
    """
    made = tickets.where(F.array_contains("labels", "datadog-log")).select("project", "key", F.col("created").alias("as_of"), F.explode("labels").alias("error_type")).where("error_type <> 'datadog-log'")
    kind = F.lower(F.trim("error_type"))
    asked = cands.where(~F.coalesce(kind, F.lit("")).isin("", "unknown")).select("cand_id", "project", kind.alias("error_type"), "as_of")
    wanted = asked.select("project", "error_type").distinct()
    events = made.join(wanted, ["project", "error_type"], "left_semi").groupBy("project", "error_type", "as_of")
    newest = events.agg(F.max(F.struct("as_of", "key")).alias("ticket"))
    last = last_before(asked, newest, ["project", "error_type"], "as_of", "ticket")
    last = last.where(F.col("ticket.as_of") >= F.col("as_of") - F.expr(f"INTERVAL {int(days)} DAYS"))
    hit = asked.join(last, ["project", "error_type", "as_of"])
    return hit.select("cand_id", F.col("ticket.key").alias("ticket_key"), F.lit(0.95).alias("score"), F.lit("recent ticket of this error type").alias("message"))


def similarity_hits(cands: DataFrame, tickets: DataFrame, config: RunConfig) -> DataFrame:
    """dup_similarity on candidates; equal questions are asked once."""
    asked = ["project", "title", "norm", "error_type", "logger", "as_of"]
    grouped = cands.groupBy(*asked).agg(F.min("cand_id").alias("query_id"), F.first("message").alias("message"))
    found = dup_similarity(grouped, tickets, config).join(grouped.select("query_id", *asked), "query_id")
    same = [F.col("c." + c).eqNullSafe(F.col("f." + c)) for c in asked]
    hit = cands.alias("c").join(found.alias("f"), same)
    return hit.select("c.cand_id", F.col("f.key").alias("ticket_key"), F.col("f.score"), F.lit("similar ticket").alias("message"))


def resolve_duplicates(cands: DataFrame, tickets: DataFrame, processed: DataFrame, config: RunConfig, strategies: list[tuple[str, Callable]] | None = None) -> DataFrame:
    """Candidates with strategy_name, existing_key, score and decision: the first strategy of the chain that hits.

    Each strategy sees only what the ones before left; its hits are checkpointed, so none runs twice. strategies: (name, function) in order; by default fingerprint,
    loghash, error_type, similarity. decision is null where none hits.
    """
    chain = strategies or [
        ("fingerprint", lambda c, t, g: dup_fingerprint(c, processed)),
        ("loghash", lambda c, t, g: dup_label(c, t, "loghash")),
        ("error_type", lambda c, t, g: dup_error_type(c, t, g.error_type_days)),
        ("similarity", similarity_hits),
    ]
    left, found = cands, None
    for name, strategy in chain:
        hits = settled(strategy(left, tickets, config).withColumn("strategy_name", F.lit(name)))
        found = hits if found is None else found.unionByName(hits)
        left = left.join(hits.select("cand_id"), "cand_id", "left_anti")
    decision = F.lit(None).cast("string")
    for name, value in DECISIONS.items():
        decision = F.when(F.col("strategy_name") == name, F.lit(value)).otherwise(decision)
    unknown = F.when(F.col("strategy_name").isNotNull(), F.coalesce(decision, F.lit("duplicate-unknown")))
    marked = cands.join(found.select("cand_id", "strategy_name", F.col("ticket_key").alias("existing_key"), "score"), "cand_id", "left")
    return marked.withColumn("decision", unknown)


RESOLVED = "cand_id long, in_run string"


#: Rows of a run that one task folds. Larger runs are split by components.
ROWS_A_TASK = 100_000


def resolve_in_run(cands: DataFrame, dry_run: bool = False, exact: bool = True, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(cand_id, in_run): what each candidate comes to when a run's rows are taken in order of seq.

    cands: cand_id, run_id, project, seq, cap (0: none), fingerprint, loghash, error_type, create_ticket and decision
    (what the snapshot found, or null), one row a log_key. A created row adds its fingerprint and a ticket with its
    loghash and type; type and similarity hits of the snapshot add their fingerprint; loghash hits and rows beyond the
    cap add nothing. in_run is a decision, or 'not-needed' where no ticket is due.

    exact: rows are shuffled and sorted and folded as a stream: a task holds the sets of one run, never its rows. A run of
    over rows_a_task rows is split (see _resolve_by_components). Otherwise windows over (run, error_type), which agree as
    long as a loghash has one error type.
    """
    if not exact:
        return _resolve_by_windows(cands, dry_run)
    narrow = cands.select(
        "cand_id", "run_id", "seq", F.coalesce("cap", F.lit(0)).alias("cap"), "fingerprint", "loghash", F.coalesce("error_type", F.lit("unknown")).alias("error_type"),
        F.coalesce("create_ticket", F.lit(False)).alias("create_ticket"), F.col("decision").alias("found"), F.col("strategy_name").alias("strategy"), F.lit(0).cast("long").alias("part"), F.lit(True).alias("open"),
    )
    large = settled(narrow.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") > rows_a_task).select("run_id"))
    if large.isEmpty():
        return _folded(narrow, dry_run)
    own = F.col("n.run_id").eqNullSafe(F.col("l.run_id"))
    few = narrow.alias("n").join(large.alias("l"), own, "left_anti")
    many = narrow.alias("n").join(large.alias("l"), own, "left_semi")
    return _folded(few, dry_run).unionByName(_resolve_by_components(cut_table(many), dry_run))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with each (run, part) in one partition, in order of seq."""
    return rows.repartition("run_id", "part").sortWithinPartitions("run_id", "part", "seq", "cand_id")


def _folded(rows: DataFrame, dry_run: bool) -> DataFrame:
    return _fold(_dealt(rows), dry_run)


def _fold(dealt: DataFrame, dry_run: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """The fold over each (run, part) of dealt rows; where `open` is false, nothing is created any more. keep: columns that go on."""
    schema = ", ".join([RESOLVED, *[f"{c} {dealt.schema[c].dataType.simpleString()}" for c in keep]])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, prints, hashes, types, made = None, set(), set(), set(), 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if (r.run_id, r.part) != own:
                    own, prints, hashes, types, made = (r.run_id, r.part), set(), set(), set(), 0
                if not r.create_ticket:
                    said = "not-needed"
                elif r.found == "duplicate-fingerprint" or r.fingerprint in prints:
                    said = "duplicate-fingerprint"
                elif r.strategy == "loghash" or r.loghash and r.loghash in hashes:
                    said = "duplicate-jira"
                elif r.strategy == "error_type" or r.error_type in types:
                    said = "duplicate-error-type"
                    prints.add(r.fingerprint)
                elif r.found is not None:
                    said = r.found
                    prints.add(r.fingerprint)
                elif dry_run:
                    said = "simulated"
                elif not r.open or r.cap and made >= r.cap:
                    said = "cap-reached"
                else:
                    said = "created"
                    made += 1
                    prints.add(r.fingerprint)
                    hashes.add(r.loghash)
                    if r.error_type not in ("", "unknown"):
                        types.add(r.error_type)
                out.append((r.cand_id, said))
            yield pd.DataFrame(out, columns=["cand_id", "in_run"]).assign(**{c: frame[c].to_numpy() for c in keep})

    return dealt.mapInPandas(fold, schema)


def _resolve_by_components(rows: DataFrame, dry_run: bool) -> DataFrame:
    """The fold of large runs, in parts that don't influence each other. rows: a table of cut_table, removed once it is dealt.

    Rows meet through a fingerprint, a loghash or a known error type; the connected components of these are the parts of a
    run. Only the cap joins parts: it lets the first rows be created, by seq, that would be so without a cap. So parts are
    folded without it, the created rows of a run are numbered across its parts, and if they are more than the cap, parts are
    folded once more with nothing created beyond the place where it is reached. Rows are dealt and sorted once: the checkpoint
    keeps their partitions and order, and both folds read it in place.
    """
    key = lambda kind, c: F.xxhash64(F.lit(kind), "run_id", c)
    prints = key("f", "fingerprint")
    others = F.array_compact(F.array(F.when(F.col("loghash") != "", key("h", "loghash")), F.when(~F.col("error_type").isin("", "unknown"), key("t", "error_type"))))
    edges = rows.where("create_ticket").select(prints.alias("a"), F.explode(others).alias("b"))
    parts = components(edges)
    named = rows.drop("part").withColumn("_print", prints).join(parts.select(F.col("node").alias("_print"), F.col("root").alias("part")), "_print", "left")
    dealt = settled(_dealt(named.withColumn("part", F.coalesce("part", "_print")).drop("_print")))
    drop_tables(parts, rows)
    free = cut_table(_fold(dealt.withColumns({"limit": F.col("cap"), "cap": F.lit(0)}), dry_run, ("run_id", "seq", "limit")))
    made = free.where("in_run = 'created' and limit > 0").select("run_id", "seq", "cand_id", F.col("limit").alias("cap"))
    last = settled(numbered(made, ["run_id"], [F.col("seq"), F.col("cand_id")]).where("place = cap").select("run_id", F.struct("seq", "cand_id").alias("_last")))
    if last.isEmpty():
        return free.select("cand_id", "in_run")
    drop_tables(free)
    # A row for each large run at most. The join must not deal the rows anew.
    cut = dealt.alias("n").join(F.broadcast(last).alias("l"), F.col("n.run_id").eqNullSafe(F.col("l.run_id")), "left").select("n.*", "_last")
    until = cut.withColumn("open", F.coalesce(F.struct("seq", "cand_id") <= F.col("_last"), F.lit(True))).withColumn("cap", F.lit(0)).drop("_last")
    return _fold(until, dry_run)


def _resolve_by_windows(cands: DataFrame, dry_run: bool) -> DataFrame:
    due = F.col("create_ticket") & F.col("decision").isNull()
    by_type = Window.partitionBy("run_id", "error_type")
    by_hash = Window.partitionBy("run_id", "loghash")
    known = ~F.coalesce("error_type", F.lit("unknown")).isin("", "unknown")
    c = cands.withColumn("_first", F.when(known, F.min(F.when(due, F.col("seq"))).over(by_type))).withColumn("_hash", F.min(F.when(due, F.col("seq"))).over(by_hash))
    c = c.withColumn("_opens", due & (F.coalesce("_first", "_hash") == F.col("seq")) & (F.col("_hash") == F.col("seq")))
    nth = F.sum(F.col("_opens").cast("int")).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("_within", (F.coalesce("cap", F.lit(0)) == 0) | (nth <= F.col("cap")))
    c = c.withColumn("_made", F.min(F.when(F.col("_opens") & F.col("_within"), F.col("seq"))).over(by_type)).withColumn("_made_hash", F.min(F.when(F.col("_opens") & F.col("_within"), F.col("seq"))).over(by_hash))
    said = (
        F.when(~F.col("create_ticket"), "not-needed")
        .when(F.col("decision").isNotNull(), F.col("decision"))
        .when(F.lit(dry_run), "simulated")
        .when(F.col("_opens") & F.col("_within"), "created")
        .when(F.col("_made_hash") < F.col("seq"), "duplicate-fingerprint")
        .when(known & (F.col("_made") < F.col("seq")), "duplicate-error-type")
        .otherwise("cap-reached")
    )
    return c.select("cand_id", said.alias("in_run"))


def apply_cap(cands: DataFrame, dry_run: bool = False, rows_a_slice: int = 20_000) -> DataFrame:
    """Adds decision: the first `cap` rows (by seq) of a run are created, the rest cap-reached; 0 is no cap.

    A row's place in its run is found in two steps, so that no run is one task: rows are counted by slices of seq, of about
    rows_a_slice each if seq is dealt evenly, and numbered inside their slice.
    """
    if dry_run:
        return cands.withColumn("decision", F.lit("simulated"))
    spans = cands.groupBy("run_id").agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi"), F.ceil(F.count("*") / rows_a_slice).alias("_n"))
    part = F.floor((F.col("seq") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * F.col("_n"))
    sliced = cands.alias("s").join(spans.alias("r"), F.col("s.run_id").eqNullSafe(F.col("r.run_id"))).select("s.*", part.alias("_slice"))
    counts = sliced.groupBy("run_id", "_slice").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("run_id").orderBy("_slice")) - F.col("_rows")
    counts = counts.select("run_id", "_slice", before.alias("_before"))
    rows = sliced.alias("s").join(counts.alias("c"), [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("run_id", "_slice")]).select("s.*", "_before")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("run_id", "_slice").orderBy("seq"))
    free = (F.col("cap") == 0) | (place <= F.col("cap"))
    return rows.withColumn("decision", F.when(free, "created").otherwise("cap-reached")).select(*cands.columns, "decision")


def merge_ticket_labels(tickets: DataFrame, dup_hits: DataFrame) -> DataFrame:
    """Tickets with the loghash labels of the duplicates (ticket_key, loghash) found for them."""
    new = once(dup_hits, loghash=F.col("loghash")).where("loghash <> ''").groupBy(F.col("ticket_key").alias("key")).agg(F.array_sort(F.collect_set(F.concat(F.lit("loghash-"), "loghash"))).alias("_new"))
    return tickets.join(new, "key", "left").withColumn("labels", F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>")))).drop("_new").select(tickets.columns)


#: Different times of a ticket's hits that one task folds. Tickets with more are followed by links.
TIMES_A_TASK = 100_000


def comment_cooldown(hits: DataFrame, minutes: int, last: DataFrame | None = None, times_a_task: int = TIMES_A_TASK) -> DataFrame:
    """Adds allowed: a comment on a ticket is allowed once `minutes` have passed since the last allowed one.

    hits: team_id, ticket_key, ts. last: (team_id, ticket_key, last_ts string) of earlier runs; what can't be read as a
    time allows. Of hits at one time one is allowed at most; a hit without a time never is. Greedy in order of ts: a fold over
    sorted partitions that holds one time a task. Tickets with hits at over times_a_task different times don't go through it
    (see _cooled_by_links).
    """
    if minutes <= 0:
        return hits.withColumn("allowed", F.lit(True))
    by = ["team_id", "ticket_key"]
    rows = hits.withColumn("_n", F.monotonically_increasing_id())
    if last is not None:
        known = last.groupBy(*by).agg(F.max(F.try_to_timestamp("last_ts")).alias("_last"))
        rows = rows.alias("r").join(known.alias("k"), same("r", "k", by), "left").select("r.*", "_last")
    else:
        rows = rows.withColumn("_last", F.lit(None).cast("timestamp"))
    hot = settled(hits.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > times_a_task).select(*by))
    if hot.isEmpty():
        return _cooled_by_fold(rows, minutes, hits)
    few = rows.alias("r").join(hot.alias("h"), same("r", "h", by), "left_anti")
    many = settled(rows.alias("r").join(hot.alias("h"), same("r", "h", by), "left_semi"))
    return _cooled_by_fold(few, minutes, hits).unionByName(_cooled_by_links(many, minutes).select(*hits.columns, "allowed"))


def _cooled_by_fold(rows: DataFrame, minutes: int, hits: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in hits.columns) + ", allowed boolean"
    gap, columns = pd.Timedelta(minutes=minutes), list(hits.columns)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, before = None, None
        for frame in frames:
            allowed = []
            for team, ticket, ts, start in zip(frame["team_id"], frame["ticket_key"], frame["ts"], frame["_last"], strict=True):
                if (team, ticket) != key:
                    key, before = (team, ticket), None if pd.isna(start) else start
                ok = not pd.isna(ts) and (before is None or ts - before >= gap)
                before = ts if ok else before
                allowed.append(ok)
            yield frame[columns].assign(allowed=allowed)

    return rows.repartition("team_id", "ticket_key").sortWithinPartitions("team_id", "ticket_key", "ts", "_n").mapInPandas(fold, schema)


def _cooled_by_links(rows: DataFrame, minutes: int) -> DataFrame:
    """The fold of tickets with very many hits, by pointer doubling.

    Every time of a ticket links to the first time that is at least the gap after it, found by an as-of join. What is allowed
    is what can be reached from the first allowed time; each round doubles how far links and the times reached go, so a chain
    of n comments takes log n rounds of joins on (ticket, time), none of which has a hot key.
    """
    by, gap = ["team_id", "ticket_key"], minutes * 60_000_000
    at = F.unix_micros("ts")
    times = settled(rows.where("ts is not null").groupBy(*by, at.alias("at")).agg(F.min("_n").alias("_first"), F.max(F.unix_micros("_last")).alias("_last")))
    # Times run backwards, so that the last one before is the first one after.
    events = times.select(*by, (-F.col("at")).alias("back"), F.col("at").alias("to"))
    after = lambda t: (-(F.col(t) + gap)).alias("back")
    links = last_before(times.select(*by, after("at")), events, by, "back", "to").select(*by, (-F.col("back") - gap).alias("at"), "to")
    starts = times.groupBy(*by).agg(F.min("at").alias("least"), F.max("_last").alias("_last"))
    waiting = last_before(starts.where("_last is not null").select(*by, after("_last")), events, by, "back", "to").select(*by, F.col("to").alias("at"))
    reached = settled(starts.where("_last is null").select(*by, F.col("least").alias("at")).unionByName(waiting))
    links = settled(links)
    while True:
        farther = reached.alias("r").join(links.alias("l"), same("r", "l", [*by, "at"])).select(*[F.col(f"r.{c}") for c in by], F.col("l.to").alias("at"))
        farther = settled(farther)
        if farther.isEmpty():
            break
        reached = settled(reached.unionByName(farther))
        onward = links.select(*by, F.col("at").alias("to"), F.col("to").alias("next"))
        links = settled(links.alias("a").join(onward.alias("b"), same("a", "b", [*by, "to"])).select(*[F.col(f"a.{c}") for c in [*by, "at"]], F.col("b.next").alias("to")))
    first = times.alias("t").join(reached.alias("r"), same("t", "r", [*by, "at"]), "left_semi").select("_first").withColumn("_allowed", F.lit(True))
    marked = rows.join(first, rows["_n"] == first["_first"], "left")
    return marked.withColumn("allowed", F.coalesce("_allowed", F.lit(False)))


def dedup_stats(logs: DataFrame, approximate: bool = False) -> DataFrame:
    unique: Column = F.approx_count_distinct("log_key") if approximate else F.count_distinct("log_key")
    return logs.agg(F.count("*").alias("total_checked"), unique.alias("unique_logs")).withColumn("duplicates_found", F.col("total_checked") - F.col("unique_logs"))
