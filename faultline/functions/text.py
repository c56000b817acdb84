"""Column functions over log messages: normalising, masking, hashing and parsing. All built in, no Python at run time."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java needs (?U) for word boundaries, digits and spaces beyond ASCII and (?d) so that only \n ends a line.
UNICODE = "(?Ud)"

# The ordered masks of the message normaliser (pattern, replacement). The text is lower case by then.
MESSAGE_MASKS = (
    (r"(failed to get file size by name)\s+[^,]+", "$1 <blob>"),
    (r"\b[a-z0-9._-]+\.dpplan\b", " <file>"),
    (r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", " <email> "),
    (r"\bhttps?://[^\s]+", " <url> "),
    (r"\b[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", " <token> "),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", " "),
    (r"\b[0-9a-f]{24}\b", " "),
    (r"\b\d{4}-\d{2}-\d{2}[tT ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\b", " "),
    (r"\[?\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[,\.]\d+)?\]?", " "),
    (r"\b\d{5,}\b", " "),
    (r"\b[a-f0-9]{10,}\b", " "),
    (r"(duplicate entry\s+).*?(for key)", "$1$2"),
    (r"\\x[0-9a-f]{2}", " "),
)
# Masks that keep a message readable, in order.
READABLE_MASKS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\bhttps?://[^\s]+", "<url>"),
    (r"\b[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\b", "<token>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b[0-9a-fA-F]{24,}\b", "<hex>"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<ip>"),
)
# The masks of rule-made descriptions, in order.
BASIC_MASKS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "<EMAIL>"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "<IP_ADDRESS>"),
    (r"\b[A-Za-z0-9]{20,}\b", "<TOKEN>"),
)
# The masks of secrets in anything that is logged, in order.
SECRET_MASKS = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "<email>"),
    (r"sk-[a-zA-Z0-9]{10,}", "<api-key>"),
    (r"ghp_[a-zA-Z0-9]{36}", "<github-token>"),
    (r"\b[a-zA-Z0-9]{32,}\b", "<token>"),
    (r"https?://[^\s]+", "<url>"),
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"(?i)\b[0-9a-f]{24,}\b", "<hash>"),
)
# What a text has to hold (a string, or a pattern in a list) for a mask to find anything in it. Most texts hold
# little of it, and looking for it is much cheaper than the masks; neighbours with one hint are skipped together.
_HEX_OR_DIGITS, _HEX, _DOTTED_DIGITS = [r"[0-9a-f]{8}|\d{4}"], [r"[0-9a-fA-F]{8}"], [r"\d\.\d"]
HINTS: dict[tuple[str, str], str | list[str]] = dict(
    zip(
        MESSAGE_MASKS,
        ("failed to get file size by name", ".dpplan", "@", "://", [r"\.[A-Za-z0-9_-]+\."], *[_HEX_OR_DIGITS] * 6, "duplicate entry", "\\x"),
        strict=True,
    )
)
HINTS |= dict(zip(READABLE_MASKS, ("@", "://", [r"\.[A-Za-z0-9_-]{20,}\."], _HEX, _HEX, _DOTTED_DIGITS), strict=True))
HINTS |= dict(zip(BASIC_MASKS[:2], ("@", _DOTTED_DIGITS), strict=True))
HINTS |= dict(zip(SECRET_MASKS[:3] + SECRET_MASKS[4:], ("@", "sk-", "ghp_", "://", _HEX, _HEX), strict=True))
# File and line in stack traces; the first pattern that matches wins.
FRAME_PATTERNS = (
    r"at\s+[\w.$]+\(([\w]+\.java):(\d+)\)",
    r"\((\w+\.java):(\d+)\)",
    r"File\s+\"([^\"]+\.py)\",\s+line\s+(\d+)",
    r"at\s+\w+\s+\(([^:]+\.(?:js|ts|tsx)):(\d+):\d+\)",
    r"\b([\w./\\-]+\.(?:java|py|ts|tsx|js|go|kt|scala)):(\d+)\b",
    r"\((\w+\.kt):(\d+)\)",
    r"\b(\w+\.go):(\d+)\b",
)
# Where sources of a logger may be.
SOURCE_DIRS = ("src/main/java", "src/main/kotlin", "src/main/scala", "src", "app/src/main/java", "app/src/main/kotlin")
SOURCE_ENDINGS = (".java", ".kt", ".scala", ".groovy")
# Words that say nothing about an error.
STOP_WORDS = (
    "that", "this", "with", "from", "have", "been", "were", "what", "when", "where", "which", "while", "about", "after", "before",
    "error", "errors", "logs", "find", "search", "show", "investigate",
)


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def let(column: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.transform(F.array(column), f)[0]


#: What SQL trims: Unicode's spaces, but no tabs or line breaks.
SQL_SPACES = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: A word's begin or end where only ASCII letters, digits and _ are words (Java's own \\b differs between its versions).
ASCII_BOUND = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_OF_WORDS = r"(?:\\d|[a-z]|\[(?:\w-\w)+\])"


def _of_ascii(pattern: str) -> str:
    """A mask with the words, digits and spaces of ASCII. One that begins or ends with a letter or digit has half a bound there, which is cheaper."""
    pattern = re.sub(rf"^\\b(?={_OF_WORDS})", lambda _: "(?<![0-9A-Za-z_])", pattern)
    pattern = re.sub(rf"(?<!\\)({_OF_WORDS}(?:\{{[\d,]+\}}|\+)?)\\b$", lambda m: m[1] + "(?![0-9A-Za-z_])", pattern)
    return "(?d)" + pattern.replace(r"\b", ASCII_BOUND).replace(r"[^\s]", r"[^\t\n\f\r ]").replace(r"\s", r"[\t\n\f\r ]")



def masked(column: Column, masks: tuple[tuple[str, str], ...], ascii_only: bool = False) -> Column:
    """ascii_only: word boundaries, digits and spaces are those of ASCII, as in SQL; else those of Unicode, as in Python."""

    def replaced(text: Column, some: list[tuple[str, str]]) -> Column:
        for pattern, to in some:
            text = F.regexp_replace(text, _of_ascii(pattern) if ascii_only else UNICODE + pattern, to)
        return text

    def where(hint: str | list[str], some: list[tuple[str, str]]) -> Callable[[Column], Column]:
        held = lambda text: F.contains(text, F.lit(hint)) if isinstance(hint, str) else text.rlike(UNICODE + hint[0])
        return lambda text: F.when(held(text), replaced(text, some)).otherwise(text)

    for hint, some in groupby(masks, HINTS.get):
        column = replaced(column, list(some)) if hint is None else let(column, where(hint, list(some)))
    return column


def _plain_words(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"[^a-z0-9]+", " "))


def normalize_text(column: Column | str) -> Column:
    """Lower case words of a-z and 0-9, parted by one space; null gives ''."""
    low = F.lower(F.coalesce(_c(column), F.lit("")))
    for form in ("pre persist", "prepersist"):
        low = F.replace(low, F.lit(form), F.lit("pre-persist"))
    return _plain_words(low)


def normalize_log_message(column: Column | str, ascii_only: bool = False) -> Column:
    """What two messages share when variable parts (files, addresses, ids, times, numbers) differ; null gives ''.

    ascii_only: see masked; a capital I with a dot is a plain i in lower case, as in SQL, and not an i with a dot above it.
    """
    text = F.coalesce(_c(column), F.lit(""))
    text = F.replace(text, F.lit("\u0130"), F.lit("i")) if ascii_only else text
    return _plain_words(masked(F.lower(text), MESSAGE_MASKS, ascii_only))


def mask_pii(column: Column | str, ascii_only: bool = False) -> Column:
    """Readable text with personal data masked; null gives ''."""
    return masked(F.coalesce(_c(column), F.lit("")), READABLE_MASKS, ascii_only)


def mask_pii_basic(column: Column | str, ascii_only: bool = False) -> Column:
    return masked(F.coalesce(_c(column), F.lit("")), BASIC_MASKS, ascii_only)


def mask_secrets(column: Column | str, ascii_only: bool = False) -> Column:
    """Null stays null."""
    return masked(_c(column), SECRET_MASKS, ascii_only)


def short_sha(column: Column) -> Column:
    """The first twelve hex digits of a text's SHA-1."""
    return F.left(F.sha1(column), F.lit(12))


def loghash_of(norm: Column | str) -> Column:
    """The hash of an already normalised message; '' if that is ''."""
    return let(_c(norm), lambda n: F.when(n == "", F.lit("")).otherwise(short_sha(n)))


def loghash(message: Column | str) -> Column:
    return loghash_of(normalize_log_message(message))


def _key(prefix: Column, norm: Column, raw: Column) -> Column:
    return F.concat(prefix, F.lit("|"), let(norm, lambda n: F.coalesce(F.when(n != "", n), raw, F.lit(""))))


def fingerprint(error_type: Column | str, message: Column | str, norm: Column | str | None = None) -> Column:
    """Twelve hex digits for an error type and normalised message (the raw one if nothing is left of it).

    norm: the normalised message where it is a column already, so that it is computed once.
    """
    own = _c(norm) if norm is not None else normalize_log_message(message)
    return short_sha(_key(F.coalesce(_c(error_type), F.lit("unknown")), own, _c(message)))


def logger_fingerprint(logger: Column | str, message: Column | str, norm: Column | str | None = None) -> Column:
    """The older key, by logger instead of error type."""
    own = _c(norm) if norm is not None else normalize_log_message(message)
    return short_sha(_key(F.coalesce(_c(logger), F.lit("")), own, _c(message)))


def log_key(logger: Column | str, message: Column | str, norm: Column | str | None = None) -> Column:
    """By this key repeats inside a run are found."""
    raw = F.coalesce(_c(message), F.lit("<no message>"))
    own = F.coalesce(_c(norm), F.lit("")) if norm is not None else normalize_log_message(raw)
    return _key(F.coalesce(_c(logger), F.lit("unknown")), own, raw)


def extract_entities(column: Column | str) -> Column:
    """emails, uuids, services and at most ten keywords of a question, each in the order seen."""
    text = F.coalesce(_c(column), F.lit(""))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(0))
    words = F.transform(every(r"\b[a-zA-Z]{4,}\b"), F.lower)
    keywords = F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))), 1, 10)
    return F.struct(
        every(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}").alias("emails"),
        every(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}").alias("uuids"),
        every(r"(?i)\b[a-z]+-(?:service|api|gateway|worker|processor)\b").alias("services"),
        keywords.alias("keywords"),
    )


ADF = "struct<content: array<struct<content: array<struct<text: string>>>>>"


def ticket_description_text(column: Column | str) -> Column:
    """Plain descriptions as they are; document trees as their texts, a line each, at most 4000 characters; null gives ''."""
    raw = F.coalesce(_c(column), F.lit(""))
    tree = F.from_json(raw, ADF)
    texts = F.flatten(F.transform(F.filter(tree["content"], lambda b: b["content"].isNotNull()), lambda b: b["content"]["text"]))
    said = F.left(F.array_join(F.filter(texts, lambda t: t != ""), "\n"), F.lit(4000))
    return F.when(F.ltrim(raw).startswith("{") & tree["content"].isNotNull(), said).otherwise(raw)


#: What a quoted message follows in a description.
QUOTED = "Original Log:"


def original_log_of(description: Column | str, ascii_only: bool = False) -> Column:
    """The normalised message that a ticket's description quotes last (all of it if it quotes none).

    ascii_only: see normalize_log_message; spaces at its ends are those that SQL trims.
    """
    said = F.substring_index(_c(description), QUOTED, -1)
    return normalize_log_message(F.trim(said, F.lit(SQL_SPACES)) if ascii_only else F.trim(said), ascii_only)


def priority_name(severity: Column | str) -> Column:
    s = F.lower(F.trim(F.coalesce(_c(severity), F.lit("low"))))
    return F.when(s == "high", "High").when(s == "medium", "Medium").otherwise("Low")


def stack_frame(column: Column | str) -> Column:
    """file and line of the first frame pattern that matches, or nulls."""
    text = F.coalesce(F.trim(_c(column)), F.lit(""))
    group = lambda p, g: F.nullif(F.regexp_extract(text, UNICODE + p, g), F.lit(""))
    found = [F.when(group(p, 1).isNotNull(), F.struct(group(p, 1).alias("file"), group(p, 2).try_cast("int").alias("line"))) for p in FRAME_PATTERNS]
    return F.coalesce(*found)


def logger_source_path(column: Column | str) -> Column:
    """Where the source of a logger may be: each source folder with each ending; an empty array for no logger."""
    clean = F.regexp_replace(_c(column), UNICODE + r"[:\.][\w]+\(\)$", "")
    path = F.replace(F.trim(F.regexp_replace(clean, UNICODE + r":\d+$", "")), F.lit("."), F.lit("/"))
    places = F.array(*[F.concat(F.lit(d + "/"), path, F.lit(e)) for d in SOURCE_DIRS for e in SOURCE_ENDINGS])
    return F.when(F.coalesce(_c(column), F.lit("")) == "", F.array().cast("array<string>")).otherwise(places)


def parse_ts(column: Column | str) -> Column:
    """ISO with Z (with or without a fraction) or 'yyyy-MM-dd HH:mm:ss', in UTC; anything else is null."""
    return F.coalesce(
        F.try_to_timestamp(_c(column), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]'Z'")),
        F.try_to_timestamp(_c(column), F.lit("yyyy-MM-dd HH:mm:ss")),
    )


ANSWER = "struct<error_type: string, create_ticket: boolean, ticket_title: string, ticket_description: string, severity: string>"


def parse_model_answer(column: Column | str) -> Column:
    """The analysis in a model's answer, fenced or not, or null unless it is an object with a title and a description.

    Raw control characters inside strings are accepted. severity defaults to low, error_type to unknown, create_ticket
    to false. Rows with null go on to the rules (see faultline.operators.classify.analyse).
    """
    raw = F.coalesce(_c(column), F.lit(""))
    fenced = F.regexp_extract(raw, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    body = F.trim(F.when(fenced != "", fenced).otherwise(raw))
    got = F.from_json(body, ANSWER, {"allowUnquotedControlChars": "true"})
    filled = F.struct(
        F.coalesce(got["error_type"], F.lit("unknown")).alias("error_type"),
        F.coalesce(got["create_ticket"], F.lit(False)).alias("create_ticket"),
        got["ticket_title"].alias("ticket_title"),
        got["ticket_description"].alias("ticket_description"),
        F.lower(F.coalesce(got["severity"], F.lit("low"))).alias("severity"),
    )
    full = (F.trim(F.coalesce(got["ticket_title"], F.lit(""))) != "") & (F.trim(F.coalesce(got["ticket_description"], F.lit(""))) != "")
    return F.when(full, filled)
