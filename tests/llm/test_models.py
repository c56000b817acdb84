"""The classifiers' parts against brute force, and tables of odd rows through models and stages."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import embeddings, quality, toxicity

TEXTS = ["The cat sat, the cat SAT!!", "", None, "one", "A  b\tc 12 34 d?\nline two line two", "é Ünï 日本 x", "!!! ???", " ".join(f"w{k % 50} Q" for k in range(900)), "one"]


def rows_of(texts, bits):
    off, col, value = quality.hashed_ngrams(pa.array(texts, pa.string()).fill_null(""), bits)
    return [list(zip(col[a:b].tolist(), value[a:b].tolist(), strict=True)) for a, b in zip(off, off[1:], strict=False)]


@pytest.mark.parametrize("bits", [4, 10, 30])
def test_ngrams_of_a_text_do_not_depend_on_its_batch(bits):
    whole = rows_of(TEXTS, bits)
    assert len(whole) == len(TEXTS) and whole[1] == whole[2] == [] and whole[3] == whole[8]
    for text, row in zip(TEXTS, whole, strict=True):
        alone = rows_of([text], bits)[0]
        assert [c for c, _ in alone] == [c for c, _ in row] and np.allclose([v for _, v in alone], [v for _, v in row])
        assert len({c for c, _ in row}) == len(row)  # a column stands once, however many n-grams share it
    if bits == 30:  # no two share a column: n-grams have length 1, the eight words about the whole text .35 each
        assert all(abs(sum(v * v for _, v in row) - 1 - 8 * 0.35**2) < 1e-9 for row in whole if row)


def brute_ftrl(rows, labels, epochs, alpha=0.3, beta=1.0, l1=0.02, l2=0.02):
    z, n = {}, {}

    def weight(c):
        at = z.get(c, 0.0)
        return 0.0 if abs(at) <= l1 else -(at - math.copysign(l1, at)) / ((beta + math.sqrt(n.get(c, 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            p = 1 / (1 + math.exp(-sum(weight(c) * v for c, v in rows[i])))
            for c, v in rows[i]:
                g, old = (p - labels[i]) * v, n.get(c, 0.0)
                z[c], n[c] = z.get(c, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * weight(c), old + g * g
    return weight


@pytest.mark.parametrize("bits", [4, 12])
def test_ftrl_against_brute_force(bits):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "calm", "BAD", "x!", "77", "words"], int(rng.integers(0, 30)))) for _ in range(80)]
    labels = np.array([float("BAD" not in t) for t in texts])
    weight = brute_ftrl([[*row, (1 << bits, 0.5)] for row in rows_of(texts, bits)], labels, 3)
    got = quality.ftrl(texts, labels, bits, 3)
    assert np.allclose(got, [weight(c) for c in range((1 << bits) + 1)], atol=1e-9) and np.abs(got).max() > 0.1


def test_scores_are_dot_products(spark):
    weights = np.random.default_rng(3).standard_normal((1 << 10) + 1).astype(np.float32)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("score", "label", "w", "x")})
    got = dict(quality.score(docs, weights).collect())
    for i, row in enumerate(rows_of(TEXTS, 10)):
        total = sum(float(weights[c]) * v for c, v in row) + 0.5 * float(weights[-1])
        assert abs(got[i] - 1 / (1 + math.exp(-total))) < 1e-6
    assert quality.score(docs.limit(0), weights).collect() == []


def brute_features(text, lexicon):
    words = text.split()
    n = len(words)
    plain = [toxicity.plain(w) for w in words]
    weight = [max((lexicon.get(f, 0.0) for f in toxicity.stems(w)), default=0.0) if w else 0.0 for w in plain]
    hit = [x > 0 or w in toxicity.SEED_LEXICON for x, w in zip(weight, plain, strict=True)]
    you = [w in toxicity.SECOND_PERSON for w in plain]
    near = sum(sum(you[max(0, i - 5) : i + 6] if n >= 11 else you) for i in range(n) if hit[i])
    return {
        "log_words": math.log1p(n), "seed_density": sum(w in toxicity.SEED_LEXICON for w in plain) / n, "learned_density": sum(hit) / n, "learned_hits": min(50, sum(hit)),
        "learned_weight": sum(weight) / n, "strongest": max(weight), "near_second_person": near / n, "second_person": sum(you) / n,
        "capitals": sum("A" <= c <= "Z" for c in text) / len(text), "exclamations": text.count("!") / len(text), "digits": sum("0" <= c <= "9" for c in text) / len(text),
    }


def test_features_against_brute_force():
    lexicon = {"=grell": 2.0, "grel": 1.0, "=idiot": 3.0}
    features = toxicity.Features(lexicon)
    texts = ["You absolute 1d10t, grell grellig GRELS!", "you " * 4 + "calm words " * 20 + "idiot your dir grell", "nothing here", "12 !! ??", "idiot " * 70, "é ü you"]
    for text in texts:
        got = dict(zip(toxicity.FEATURES, features.of(text), strict=True))
        for name, value in brute_features(text, lexicon).items():
            assert abs(got[name] - value) < 1e-12, (text, name)
    assert features.of("") == features.of(" \n") == [0.0] * len(toxicity.FEATURES)


def test_calibration_is_linear_between_knots(spark):
    knots = [(0.1, 0.0), (0.4, 0.0), (0.5, 0.75), (0.9, 1.0)]
    p = np.array([0.0, 0.1, 0.25, 0.4, 0.45, 0.5, 0.7, 0.9, 1.0])
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in p], "p double").coalesce(1).select(toxicity.calibrated(F.col("p"), knots)).collect()]
    assert np.allclose(got, np.clip(np.interp(p, *zip(*knots, strict=True)) * 0.999 + p * 0.001, 0, 1))
    assert got == sorted(got)


def test_models_take_odd_tables(spark, docs, no_docs, corpus):
    labels = spark.createDataFrame([(r[0], i % 2, i % 2) for i, r in enumerate(corpus)] + [(None, 1, 1), (5, None, None), (77777, 1, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("mine"))
    model = toxicity.train(docs, labels, trees=2)
    weights = quality.train(docs, labels, bits=10, epochs=1)
    assert np.array_equal(weights, quality.train(docs.repartition(3), labels, bits=10, epochs=1))
    for scored in (model.score(docs, ("doc_id",)), quality.score(docs, weights)):
        rows = scored.collect()
        assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == corpus[13][0]}) == 1  # a repeated row
    assert model.score(no_docs, ("doc_id",)).collect() == quality.score(no_docs, weights).collect() == []
    nothing = toxicity.train(no_docs, labels)
    assert {r.score for r in nothing.score(docs, ("doc_id",)).collect()} == {0.0} and toxicity.drop_toxic(no_docs, labels).collect() == []
    assert not quality.train(no_docs, labels, bits=10).any()


def test_vectors_of_any_length_are_compared(spark):
    v = np.random.default_rng(4).standard_normal(16)
    rows = [(i, (v * s).tolist()) for i, s in enumerate([1.0, 1e200, 1e-200, 3e307 / np.abs(v).max(), 1e-300])] + [(9, (-v * 1e200).tolist())]
    got = embeddings.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 4, 0) for i in range(5)} | {(9, 0, 9)}
    plain = np.random.default_rng(5).standard_normal((50, 64))
    assert np.array_equal(embeddings.unit_vectors(plain * 2.0**40), embeddings.unit_vectors(plain))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_stages_take_odd_tables(spark, docs, no_docs, corpus, tmp_path):
    from faultline.llm.pipeline_stages import COLUMNS, STAGES

    for label, at in (("odd", docs), ("none", no_docs)):
        for k, (name, stage) in enumerate(STAGES):
            before = {r.doc_id for r in at.select("doc_id").collect()}
            stage(spark, at, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{label}{k}")
            at = spark.read.parquet(f"{tmp_path}/{label}{k}")
            ids = [r.doc_id for r in at.select("doc_id").collect()]
            assert set(ids) <= before and (label == "none") == (not ids), name
            if k < len(STAGES) - 1:
                assert at.columns == list(COLUMNS)
            if k:
                assert len(ids) == len(set(ids))  # copies and repeated rows went with the second stage
