"""Classification by the rule table: type, confidence, severity, title, description, and whether a ticket is due.

All of it is column expressions on rows that are already unique; nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import UNICODE, mask_pii_basic, parse_model_answer
from faultline.operators.rules import ACTIONS, CAUSES, CRITICAL_LOGGERS, GENERIC, HIGH_WORDS, MEDIUM_WORDS, RULES, Rule


def _any(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words])


def may_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text holds all the plain parts of any of the patterns, which is much cheaper to see than a match."""
    plain = lambda p: [w for w in p.split(".*") if w.replace(" ", "").isalnum()]
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in plain(p)], F.lit(True)) for p in patterns])


def confidence(text: Column, rule: Rule) -> Column:
    """0.8 for any pattern or 0.6 times the share of keywords, the greater; 0.1 more for several keywords, 1 at most."""
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in rule.keywords])
    pattern = may_match(text, rule.patterns) & text.rlike(UNICODE + "(?:" + "|".join(rule.patterns) + ")")
    score = F.greatest(F.when(pattern, F.lit(0.8)).otherwise(F.lit(0.0)), hits / F.lit(len(rule.keywords)) * F.lit(0.6))
    return F.when(hits > 1, F.least(F.lit(1.0), score + F.lit(0.1))).otherwise(score)


def with_text(df: DataFrame) -> DataFrame:
    detail = F.coalesce(F.col("detail"), F.lit("")) if "detail" in df.columns else F.lit("")
    return df.withColumn("_text", F.lower(F.concat(F.coalesce("message", F.lit("")), F.lit(" "), detail)))


def match_error_type(df: DataFrame) -> DataFrame:
    """Adds error_type and confidence. The greatest confidence wins, ties go to the first type of the table."""
    text = F.col("_text")
    scored = F.array(*[F.struct(confidence(text, r).alias("score"), F.lit(-i).alias("first"), F.lit(r.error_type).alias("type")) for i, r in enumerate(RULES)])
    df = with_text(df).withColumn("_best", F.array_max(scored)).withColumn("_generic", confidence(text, GENERIC))
    none = F.col("_best.score") <= 0
    generic = (F.col("_best.score") < 0.3) & (F.col("_generic") > 0)
    return df.withColumn("error_type", F.when(generic | none, F.lit("unknown")).otherwise(F.col("_best.type"))).withColumn(
        "confidence", F.when(generic, F.col("_generic")).otherwise(F.col("_best.score"))
    ).drop("_best", "_generic", "_text")


def classify_severity(df: DataFrame) -> DataFrame:
    """Adds severity from error_type, the text and the logger."""
    text, logger = F.col("_text"), F.lower(F.coalesce("logger", F.lit("")))
    base = reduce(lambda c, r: c.when(F.col("error_type") == r.error_type, r.severity), RULES, F.when(F.lit(False), "")).otherwise(GENERIC.severity)
    said = F.when(_any(text, HIGH_WORDS), "high").when((base == "low") & _any(text, MEDIUM_WORDS), "medium").otherwise(base)
    lifted = F.when(_any(logger, CRITICAL_LOGGERS), F.when(said == "low", "medium").when(said == "medium", "high").otherwise(said)).otherwise(said)
    prod = F.contains(logger, F.lit("prod")) | F.contains(text, F.lit("production"))
    return with_text(df).withColumn("severity", F.when(prod & (lifted == "low"), "medium").otherwise(lifted)).drop("_text")


def rule_title(df: DataFrame) -> DataFrame:
    """Adds ticket_title."""
    message, logger = F.lower(F.coalesce("message", F.lit(""))), F.coalesce("logger", F.lit(""))
    code = lambda d: F.regexp_extract(message, UNICODE + rf"\b({d}\d{{2}})\b", 1)
    kind = F.col("error_type")
    title = F.when(kind == "database-connection", F.when(F.contains(message, F.lit("timeout")), "Database Connection Timeout").otherwise("Database Connection Failed"))
    for name, digit in (("http-client-error", 4), ("http-server-error", 5)):
        title = title.when((kind == name) & (code(digit) != ""), F.concat(F.lit("HTTP "), code(digit), F.lit(" Error")))
    title = reduce(lambda c, r: c.when(kind == r.error_type, r.title), RULES, title).otherwise(GENERIC.title)
    named = (logger != "") & ~F.contains(logger, F.lit("unknown"))
    title = F.when(named, F.concat(title, F.lit(" in "), F.substring_index(logger, ".", -1))).otherwise(title)
    return df.withColumn("ticket_title", F.left(title, F.lit(120)))


def _lines(table: dict[str, tuple[str, ...]]) -> Column:
    text = lambda words: "\n" + "\n".join("- " + w for w in words)
    found = F.when(F.lit(False), "")
    for kind, words in table.items():
        if kind:
            found = found.when(F.col("error_type") == kind, text(words))
    return found.otherwise(text(table[""]))


def rule_description(df: DataFrame) -> DataFrame:
    """Adds ticket_description, in markdown."""
    field = lambda c, default="": F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    parts = [
        F.lit("**Problem Summary**\n"), mask_pii_basic(field("message")),
        F.lit("\n\n**Analysis Details**\n- **Error Type**: "), F.col("error_type"),
        F.lit("\n- **Analysis Method**: Rule-based fallback (LLM unavailable)\n- **Confidence**: "), F.format_string("%.2f", F.col("confidence")),
        F.lit("\n- **Logger**: "), field("logger", "unknown"), F.lit("\n- **Thread**: "), field("thread", "unknown"),
        F.lit("\n- **Timestamp**: "), field("timestamp"),
        F.lit("\n\n**Possible Causes**\n"), _lines(CAUSES), F.lit("\n\n**Suggested Actions**\n"), _lines(ACTIONS),
        F.lit("\n\n**Additional Context**\n"), F.coalesce(F.nullif(field("detail"), F.lit("")), F.lit("No additional details available")),
        F.lit("\n\n---\n*This ticket was created using fallback analysis due to LLM service unavailability.*\n"),
    ]
    return df.withColumn("ticket_description", F.concat(*parts))


def should_create(df: DataFrame) -> DataFrame:
    """Adds create_ticket from severity and confidence."""
    sev, conf = F.col("severity"), F.col("confidence")
    return df.withColumn("create_ticket", (conf >= 0.2) & ((sev == "high") | ((sev == "medium") & (conf >= 0.4)) | ((sev == "low") & (conf >= 0.7))))


def classify(df: DataFrame) -> DataFrame:
    """All steps of the rule classifier on (message, logger[, detail, thread, timestamp])."""
    return should_create(rule_description(rule_title(classify_severity(match_error_type(df)))))


# What a row is where the model's answer is unusable and the rules are off.
UNUSABLE = {"error_type": "analysis-error", "ticket_title": "LLM analysis error", "ticket_description": "The model's answer could not be parsed.", "severity": "low"}


def analyse(df: DataFrame, answer: str = "answer", fallback: bool = True) -> DataFrame:
    """The model's answer where it is usable, else the rules (or, without fallback, a fixed error row)."""
    ruled = classify(df) if fallback else df
    got = parse_model_answer(answer)
    ruled = ruled.withColumn("_got", got)
    for c in ("error_type", "ticket_title", "ticket_description", "severity"):
        ruled = ruled.withColumn(c, F.coalesce(F.col("_got")[c], F.col(c) if fallback else F.lit(UNUSABLE[c])))
    ruled = ruled.withColumn("create_ticket", F.coalesce(F.col("_got.create_ticket"), F.col("create_ticket") if fallback else F.lit(False)))
    return ruled.withColumn("fallback_analysis", F.col("_got").isNull()).drop("_got")


def classification_stats(df: DataFrame) -> DataFrame:
    total = F.count("*")
    share = lambda c: F.when(total > 0, F.round(F.count_if(c) / total * 100, 4)).otherwise(F.lit(0.0))
    return df.agg(
        total.alias("total_analyses"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_severity_count") for s in ("high", "medium", "low")],
        share(F.col("error_type") != "unknown").alias("pattern_match_rate"),
        share(F.col("error_type") == "unknown").alias("unknown_error_rate"),
    )
