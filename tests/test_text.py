"""Column functions on literal cases, and against plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import text as t


def run(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalize_text(spark):
    cases = {
        "Error: Database connection failed! (Timeout: 30s)": "error database connection failed timeout 30s",
        "Erro de conexão: Falha na conexão com o banco de dados": "erro de conex o falha na conex o com o banco de dados",
        "A" * 10_000: "a" * 10_000,
        "!!! ---": "",
        None: "",
        "PrePersist and pre persist": "pre persist and pre persist",
    }
    assert run(spark, t.normalize_text, *cases) == list(cases.values())


MESSAGES = {
    "[2025-12-09 10:30:00] Database connection failed": "database connection failed",
    "Request 123e4567-e89b-12d3-a456-426614174000 failed": "request failed",
    "User john.doe@example.com not found": "user email not found",
    "Failed to connect to https://api.example.com/v1/users": "failed to connect to url",
    "Authentication failed for token sk-1234567890abcdef": "authentication failed for token sk",
    "Error 2024-01-01T12:00:00Z end": "error 2024 01 01t12 00 00z end",
    "failed to get file size by name x_1.dpplan, cause: 404": "failed to get file size by name blob cause 404",
    "": "",
    None: "",
}


def test_normalize_log_message(spark):
    assert run(spark, t.normalize_log_message, *MESSAGES) == list(MESSAGES.values())


def python_normal(text):
    s = text.lower()
    for pattern, to in t.MESSAGE_MASKS:
        s = re.sub(pattern, to.replace("$1", r"\g<1>").replace("$2", r"\g<2>"), s)
    return re.sub(r"[^a-z0-9]+", " ", s).strip()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aAé0123456789abcdef-_.@:/ \\x[]'\n\u2028", max_size=60), min_size=30, max_size=60))
def test_normalizer_against_python(spark, texts):
    assert run(spark, t.normalize_log_message, *texts) == [python_normal(x) for x in texts]


def test_masks(spark):
    [said] = run(spark, t.mask_pii, "User admin@corp.com at 10.0.0.1 token 507f1f77bcf86cd799439011")
    assert said == "User <email> at <ip> token <hex>"
    [said] = run(spark, t.mask_secrets, "key sk-abcdefghij1234 at https://x.y/z and ghp_" + "a" * 36)
    assert said == "key <api-key> at <url> and <github-token>"
    assert run(spark, t.mask_pii_basic, "a@b.co from 1.2.3.4 " + "Z" * 20) == ["<EMAIL> from <IP_ADDRESS> <TOKEN>"]


def test_hashes(spark):
    assert run(spark, t.loghash, "Database connection failed: connection timeout", "", None) == ["ba2bba309e95", "", ""]
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()[:12]
    assert run(spark, lambda c: t.fingerprint(F.lit("timeout"), c), "Read timed out", "!!!") == [sha("timeout|read timed out"), sha("timeout|!!!")]
    assert run(spark, lambda c: t.log_key(F.lit(None).cast("string"), c), None, "A b") == ["unknown|no message", "unknown|a b"]


def test_entities(spark):
    [e] = run(spark, t.extract_entities, "timeout in user-service and api-gateway for a@b.com id 123E4567-e89b-12d3-a456-426614174000 timeout error")
    assert e.services == ["user-service", "api-gateway"] and e.emails == ["a@b.com"] and e.uuids == ["123E4567-e89b-12d3-a456-426614174000"]
    assert e.keywords[:4] == ["timeout", "user", "service", "gateway"] and "error" not in e.keywords


def test_descriptions(spark):
    tree = '{"content": [{"content": [{"text": "one"}, {"type": "x"}, {"text": "two"}]}, {"content": null}, {}]}'
    assert run(spark, t.ticket_description_text, "plain {x}", tree, None) == ["plain {x}", "one\ntwo", ""]
    assert run(spark, t.original_log_of, "x\nOriginal Log: A\nOriginal Log: Read FAILED!", "none") == ["read failed", "none"]


def test_priority(spark):
    assert run(spark, t.priority_name, "high", "medium", "low", "critical", None, "") == ["High", "Medium", "Low", "Low", "Low", "Low"]


def test_answers(spark):
    full = '{"error_type": "timeout", "create_ticket": true, "ticket_title": "T", "ticket_description": "a\nb\tc", "severity": "HIGH"}'
    got = run(spark, t.parse_model_answer, full, "Sure\n```json\n" + full + "\n```", "[1]", "garbage", '{"ticket_title": "T"}', None)
    assert got[0].ticket_description == "a\nb\tc" and got[0].severity == "high" and got[1] == got[0]
    assert got[2:] == [None] * 4


def test_frames(spark):
    got = run(spark, t.stack_frame, "at com.a.B.c(B.java:12)", 'File "/x/y.py", line 7', "at run (/a/b.js:3:9)", "boom main.go:44", "nothing", None)
    assert [(g.file, g.line) if g else None for g in got] == [("B.java", 12), ("/x/y.py", 7), ("/a/b.js", 3), ("main.go", 44), None, None]
    [paths, none] = run(spark, t.logger_source_path, "com.a.Cart:12", "")
    assert paths[0] == "src/main/java/com/a/Cart.java" and len(paths) == 24 and none == []


def test_times(spark):
    got = run(spark, t.parse_ts, "2024-01-02T03:04:05.5Z", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "02/01/2024", "", None)
    assert [g.isoformat() if g else None for g in got] == ["2024-01-02T03:04:05.500000", "2024-01-02T03:04:05", "2024-01-02T03:04:05", None, None, None]


@pytest.mark.parametrize("name", ["normalize_log_message", "mask_pii", "mask_secrets"])
def test_no_python_in_plans(spark, name):
    plan = spark.range(1).select(getattr(t, name)(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
