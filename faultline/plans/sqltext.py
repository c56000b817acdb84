"""SQL texts of the column functions, for the oracle queries."""

from __future__ import annotations

from faultline.functions import text as t
from faultline.operators.rules import CRITICAL_LOGGERS, GENERIC, HIGH_WORDS, MEDIUM_WORDS, RULES, Rule


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def masked(x: str, masks) -> str:
    for pattern, to in masks:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    return x


def plain(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"


def norm_text(x: str) -> str:
    return plain(f"replace(replace(lower(coalesce({x}, '')), 'pre persist', 'pre-persist'), 'prepersist', 'pre-persist')")


def norm_message(x: str) -> str:
    return plain(masked(f"lower(coalesce({x}, ''))", t.MESSAGE_MASKS))


def short(x: str) -> str:
    return f"left(sha1({x}), 12)"


def key(prefix: str, norm: str, raw: str) -> str:
    return f"({prefix} || '|' || coalesce(nullif({norm}, ''), {raw}, ''))"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def confidence(x: str, r: Rule) -> str:
    hits = "(" + " + ".join(f"CAST(contains({x}, {quoted(k)}) AS INT)" for k in r.keywords) + ")"
    score = f"greatest(CASE WHEN regexp_matches({x}, {quoted('|'.join(r.patterns))}) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END, {hits}::DOUBLE / {len(r.keywords)}::DOUBLE * 0.6::DOUBLE)"
    return f"(CASE WHEN {hits} > 1 THEN least(1.0::DOUBLE, {score} + 0.1::DOUBLE) ELSE {score} END)"


def classified(source: str, message: str = "message", logger: str = "logger") -> str:
    """A chain of common tables that ends in `classified`: source with text, error_type, confidence and severity."""
    scores = ", ".join(f"{confidence('text', r)} AS s{i}" for i, r in enumerate(RULES))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(RULES))) + ")"
    kind = "CASE " + " ".join(f"WHEN s{i} = best THEN {quoted(r.error_type)}" for i, r in enumerate(RULES)) + " END"
    base = "CASE error_type " + " ".join(f"WHEN {quoted(r.error_type)} THEN {quoted(r.severity)}" for r in RULES) + f" ELSE {quoted(GENERIC.severity)} END"
    return f"""c0 AS (SELECT *, lower(coalesce({message}, '') || ' ' || coalesce(detail, '')) AS text FROM {source}),
c1 AS (SELECT *, {scores}, {confidence("text", GENERIC)} AS sg FROM c0), c2 AS (SELECT *, {best} AS best FROM c1),
c3 AS (SELECT * EXCLUDE ({", ".join(f"s{i}" for i in range(len(RULES)))}), CASE WHEN best <= 0 OR (best < 0.3 AND sg > 0) THEN 'unknown' ELSE {kind} END AS error_type,
  CASE WHEN best < 0.3 AND sg > 0 THEN sg ELSE best END AS confidence FROM c2),
c4 AS (SELECT *, {base} AS base FROM c3),
c5 AS (SELECT *, CASE WHEN {any_of("text", HIGH_WORDS)} THEN 'high' WHEN base = 'low' AND {any_of("text", MEDIUM_WORDS)} THEN 'medium' ELSE base END AS said FROM c4),
c6 AS (SELECT *, CASE WHEN {any_of(f"lower({logger})", CRITICAL_LOGGERS)} THEN CASE said WHEN 'low' THEN 'medium' WHEN 'medium' THEN 'high' ELSE said END ELSE said END AS lifted FROM c5),
classified AS (SELECT *, CASE WHEN lifted = 'low' AND (contains(lower({logger}), 'prod') OR contains(text, 'production')) THEN 'medium' ELSE lifted END AS severity FROM c6)"""
