"""Predicates over logs, audit rows and tickets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import extract_entities, normalize_text
from faultline.sources.io import settled

# The canned searches (any of the phrases, in rows with status error).
TEMPLATES = {
    "null_pointer": ("NullPointerException", "null", "undefined"),
    "timeout": ("timeout", "timed out", "deadline exceeded"),
    "connection": ("connection refused", "connection reset", "ECONNREFUSED"),
    "authentication": ("authentication", "unauthorized", "401", "403"),
    "database": ("database", "SQL", "query failed", "connection pool"),
}
# States of a ticket that count as closed in a search.
CLOSED = ("Done", "Closed", "Resolved", "Tested", "Won't Do")


def says(column: str, term: str) -> Column:
    return F.contains(F.lower(F.col(column)), F.lit(term.lower()))


def words_of(csv: str | None) -> list[str]:
    return [w.strip() for w in (csv or "").split(",") if w.strip()]


def log_predicate(service: str, env: str, statuses: str = "error", extra: str | None = None, mode: str = "AND", hours_back: int | None = None, now=None) -> Column:
    terms = words_of(extra)
    found = (F.col("service") == service) & (F.col("env") == env) & F.col("status").isin(*(words_of(statuses) or ["error"]))
    if terms:
        found &= reduce((lambda a, b: a | b) if mode.upper() == "OR" else (lambda a, b: a & b), [says("message", t) for t in terms])
    if hours_back is not None:
        at = F.lit(now).cast("timestamp")
        found &= F.col("ts").between(at - F.expr(f"INTERVAL {int(hours_back)} HOURS"), at)
    return found


def filter_logs(logs: DataFrame, service: str, env: str, statuses: str = "error", extra: str | None = None, mode: str = "AND", hours_back: int | None = None, now=None) -> DataFrame:
    return logs.where(log_predicate(service, env, statuses, extra, mode, hours_back, now))


def cap_pages(logs: DataFrame, limit: int, max_pages: int) -> DataFrame:
    """At most limit * max_pages rows of a service, the earliest."""
    order = Window.partitionBy("service").orderBy("ts", "seq")
    return logs.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit * max_pages).drop("_n")


def probe_without_extra(logs: DataFrame, env: str, statuses: str, extra: str, mode: str = "AND") -> DataFrame:
    """(service, hits, relaxed_hits): relaxed_hits counts service and env alone where the full search has no hit."""
    full = reduce((lambda a, b: a | b) if mode.upper() == "OR" else (lambda a, b: a & b), [says("message", t) for t in words_of(extra)])
    full = F.coalesce(full & F.col("status").isin(*words_of(statuses)), F.lit(False))
    both = logs.where(F.col("env") == env).groupBy("service").agg(F.count_if(full).alias("hits"), F.count("*").alias("base"))
    return both.select("service", "hits", F.when(F.col("hits") == 0, F.col("base")).otherwise(0).alias("relaxed_hits"))


def template_filter(logs: DataFrame, name: str) -> DataFrame:
    if name.lower() not in TEMPLATES:
        raise ValueError(f"no such template: {name}")
    return logs.where((F.col("status") == "error") & reduce(lambda a, b: a | b, [says("message", t) for t in TEMPLATES[name.lower()]]))


#: Questions that one automaton is built for, and that the driver holds at a time.
QUESTIONS = 50_000


class Searched:
    """A block of questions, for finding which of them a log answers.

    questions: (env, service, all_status, terms) by place. One Aho-Corasick automaton finds the terms of all of them in a
    message in one pass. A question is looked at where its pivot stands, the one of its terms that fewest questions have.
    """

    def __init__(self, questions: list[tuple[str | None, str | None, bool, tuple[str, ...]]]):
        import ahocorasick

        self.questions = questions
        asked = Counter(t for q in questions for t in set(q[3]))
        self.number = {t: i for i, t in enumerate(asked)}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.number.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.needs = [frozenset(self.number[t] for t in q[3]) for q in questions]
        self.by_pivot: dict[tuple, list[int]] = {}
        self.bare: dict[tuple, list[int]] = {}
        for k, (env, service, all_status, terms) in enumerate(questions):
            if env is None:
                continue
            if terms:
                pivot = min(set(terms), key=lambda t: (asked[t], t))
                self.by_pivot.setdefault((self.number[pivot], env, service), []).append(k)
            else:
                self.bare.setdefault((env, service), []).append(k)
        self.all_status = [q[2] for q in questions]

    def answered_by(self, low: str | None, env: str | None, service: str | None, error: bool) -> list[int]:
        """The questions that a log with this lower-case message answers. A question without a service is one for all."""
        places = {(env, service), (env, None)}
        found = [k for place in places for k in self.bare.get(place, ())]
        if low is not None and self.number:
            held = {i for _, i in self.automaton.iter(low)}
            found += [k for i in held for place in places for k in self.by_pivot.get((i, *place), ()) if self.needs[k] <= held]
        return [k for k in found if error or self.all_status[k]]


def asked_terms(questions: DataFrame) -> DataFrame:
    """(question_id, env, service, all_status, terms) of questions: the first two ids and five keywords are what logs must say.

    service: the given one, or else the first service-looking word of the query, or null.
    """
    e = extract_entities("query")
    service = F.coalesce("service", F.try_element_at(F.col("e.services"), F.lit(1)))
    terms = F.concat(F.transform(F.slice("e.uuids", 1, 2), F.lower), F.slice("e.keywords", 1, 5))
    all_status = F.coalesce("all_status", F.lit(False)).alias("all_status")
    return questions.withColumn("e", e).select("question_id", "env", service.alias("service"), all_status, terms.alias("terms"))


def rule_query_filter(logs: DataFrame, questions: DataFrame, block: int = QUESTIONS) -> DataFrame:
    """(question_id, log columns): logs of the question's env and service that say all of its terms (see asked_terms).

    A log says a term if its message contains it, also inside a longer word. Without a service logs of all services match,
    and without terms all logs of the env and service, as is asked for. Logs that are not errors count if all_status is set.

    Logs are scanned once for each block of questions (50,000 of them), with the block's automaton on every task; nothing
    is joined or shuffled. Logs of an env, service or status that no question of the block asks for are left out by the scan's
    filter. A block is at most 350,000 short terms. Null messages say nothing; a question with a null env has no answer.
    """
    spark = logs.sparkSession
    asked = settled(asked_terms(questions))
    blocks = max(1, -(-asked.count() // block))
    dealt = F.pmod(F.xxhash64("question_id", "terms"), F.lit(blocks))
    kinds = {f.name: f.dataType.simpleString() for f in logs.schema.fields}
    name = "question_id" if "question_id" not in kinds else "_question_id"
    schema = f"`{name}` {asked.schema['question_id'].dataType.simpleString()}, " + ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    out = []
    for k in range(blocks):
        rows = asked.where(dealt == k).toArrow()
        own = spark.sparkContext.broadcast((rows.column("question_id").combine_chunks(), [(r["env"], r["service"], r["all_status"], tuple(r["terms"])) for r in rows.drop_columns("question_id").to_pylist()]))
        out.append(_wanted(logs, own.value[1]).withColumn("_low", F.lower("message")).mapInArrow(_answers(own, list(kinds), name), schema))
    found = reduce(DataFrame.unionByName, out)
    return found.select(F.col(name).alias("question_id"), *[c for c in logs.columns if c != "question_id"])


def _wanted(logs: DataFrame, questions: list[tuple]) -> DataFrame:
    """logs without those whose env, service or status no question can match; a filter of at most 1,000 names reaches the scan."""
    envs, services = {q[0] for q in questions if q[0] is not None}, {q[1] for q in questions}
    if len(envs) <= 1000:
        logs = logs.where(F.col("env").isin(*envs))
    if None not in services and len(services) <= 1000:
        logs = logs.where(F.col("service").isin(*services))
    return logs if any(q[2] for q in questions) else logs.where("status = 'error'")


def _answers(own: Broadcast, columns: list[str], name: str):
    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, questions = own.value
        searched = Searched(questions)
        for batch in batches:
            said = zip(*[batch.column(c).to_pylist() for c in ("_low", "env", "service", "status")], strict=True)
            found = [searched.answered_by(low, env, service, status == "error") for low, env, service, status in said]
            rows = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            asked = ids.take(pa.array([k for own in found for k in own], pa.int64()))
            yield pa.RecordBatch.from_arrays([asked, *[batch.column(c).take(rows) for c in columns]], [name, *columns])

    return answers


def filter_audit(rows: DataFrame, service: str | None = None, severity: str | None = None, error_type: str | None = None, decision: str | None = None) -> DataFrame:
    for column, value, exact in (("team_service", service, True), ("severity", severity, False), ("error_type", error_type, True), ("decision", decision, False)):
        if value:
            rows = rows.where(F.col(column) == value if exact else F.lower(column) == value.lower())
    return rows


def filter_since(rows: DataFrame, hours: int, now) -> DataFrame:
    """Rows of the last hours; rows without a usable ts stay."""
    if hours <= 0:
        return rows
    return rows.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(hours)} HOURS")))


def status_matches(status: str | None) -> Column:
    if not status:
        return F.lit(True)
    if status.lower() == "open":
        return ~F.col("status").isin(*CLOSED)
    if status.lower() in ("closed", "done", "resolved"):
        return F.col("status").isin(*CLOSED)
    return F.col("status") == status


def ticket_tokens(tickets: DataFrame) -> DataFrame:
    """The inverted index (project, token, key, created) over summaries and descriptions."""
    words = F.split(F.concat_ws(" ", normalize_text("summary"), normalize_text("description")), " ")
    return tickets.select("project", "key", "created", F.explode(F.array_distinct(words)).alias("token")).where("token <> ''")


def newest(hits: DataFrame, by: tuple[str, ...], n: int) -> DataFrame:
    """The n newest tickets (key, created) of each group."""
    order = Window.partitionBy(*by).orderBy(F.desc("created"), "key")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def search_tickets(tickets: DataFrame, queries: DataFrame, status: str | None = None, most: int = 20) -> DataFrame:
    """(query_id, key, created): the newest tickets of the project that hold any of the first five words of 3 letters.

    The list of each word is cut to its newest tickets first: no others can be among the newest of a query. So a query
    meets at most five times `most` tickets, however common its words are.
    """
    words = F.filter(F.split(normalize_text("query"), " "), lambda w: F.char_length(w) >= 3)
    asked = queries.select("query_id", "project", F.explode(F.array_distinct(F.slice(words, 1, 5))).alias("token"))
    lists = newest(ticket_tokens(tickets.where(status_matches(status))), ("project", "token"), most)
    hits = asked.join(lists, ["project", "token"]).select("query_id", "key", "created").distinct()
    return newest(hits, ("query_id",), most)
