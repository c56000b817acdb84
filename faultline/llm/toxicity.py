"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textscan as ts
from faultline.llm.labelled import sample

#: Insults to begin with; what the labelled rows show is added to it.
SEED_LEXICON = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "disgusting", "worthless", "clown")
#: Second person, in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
)
#: Letters that digits and signs stand for in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
PREFIXES = (4, 5, 6)
FEATURES = (
    "log_words", "seed_density", "learned_density", "learned_hits", "learned_weight", "strongest", "near_second_person", "second_person",
    "capitals", "shouted", "punctuation", "exclamations", "disguised", "masked", "digits", "stretched",
)
_WORD = re.compile(r"\S+")
_STRETCH = re.compile(r"(\w)\1\1")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def plain(word: str) -> str:
    """A word in lower case without punctuation around it, and undisguised if it mixes letters with digits or signs."""
    w = word.strip(_EDGES).lower()
    if w.isalpha():
        return w
    if any(c.isalpha() for c in w):
        w = w.translate(DISGUISE)
        w = "".join(c for c in w if c.isalpha())
    return w


def stems(word: str) -> list[str]:
    """The forms by which a word is looked up: itself and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class Features:
    """Turns texts into dense features. lexicon: form (see stems) to weight."""

    lexicon: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.known: dict[str, tuple[str, float, bool]] = {}

    def look_up(self, raw: str) -> tuple[float, int]:
        """Weight of a raw word, and flags: seed 1, second person 2, disguised 4, masked 8, shouted 16."""
        w = plain(raw)
        weight = max((self.lexicon.get(s, 0.0) for s in stems(w)), default=0.0) if w else 0.0
        core = raw.strip(_EDGES)
        mixed = not core.isalpha() and any(c.isalpha() for c in core) and any(c.isdigit() or c in "@$!*" for c in core)
        flags = (w in SEED_LEXICON) + 2 * (w in SECOND_PERSON) + 4 * mixed + 8 * ("*" in core) + 16 * (len(core) > 2 and core.isupper())
        return weight, flags

    def of(self, text: str) -> list[float]:
        raw = _WORD.findall(text)
        n = len(raw)
        if not n:
            return [0.0] * len(FEATURES)
        known = self.known
        if len(known) > 50_000:
            known.clear()
        for w in set(raw).difference(known):
            known[w] = self.look_up(w)
        got = np.array([known[w] for w in raw], np.float64)
        weight, flags = got[:, 0], got[:, 1].astype(np.int64)
        hit, you = (weight > 0) | (flags & 1 > 0), flags & 2 > 0
        near = np.convolve(you, np.ones(11), "same")[:n] if n >= 11 else np.full(n, you.sum())
        chars = len(text)
        raw_bytes = np.frombuffer(text.encode(), np.uint8)
        kinds = np.bincount(raw_bytes, minlength=256)
        capitals, digits = kinds[65:91].sum(), kinds[48:58].sum()
        signs = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
        return [
            float(np.log1p(n)), float((flags & 1).sum() / n), float(hit.sum() / n), float(min(hit.sum(), 50)), float(weight.sum() / n), float(weight.max()),
            float((near * hit).sum() / n), float(you.sum() / n), float(capitals / chars), float((flags & 16 > 0).sum() / n), float(signs / chars), float(kinds[33] / chars),
            float((flags & 4 > 0).sum() / n), float((flags & 8 > 0).sum() / n), float(digits / chars), float(len(_STRETCH.findall(text)) / n),
        ]


def learn_lexicon(rows: DataFrame, least_docs: int = 4, precision: float = 0.8, size: int = 2000) -> dict[str, float]:
    """Word forms that mark label 1 in (text, label): counted by Spark over all rows given, the strongest `size` kept."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            bad, good = Counter(), Counter()
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                words = {plain(w) for w in set(_WORD.findall(text))}
                (bad if label else good).update({s for w in words if w for s in stems(w)})
            forms = [*bad] + [f for f in good if f not in bad]
            yield pa.RecordBatch.from_arrays(
                [pa.array(forms, pa.string()), pa.array([bad[f] for f in forms], pa.int64()), pa.array([good[f] for f in forms], pa.int64())], ["form", "bad", "good"]
            )

    counts = rows.mapInArrow(count, "form string, bad long, good long").groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = rows.agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).first()
    bad_share = F.col("bad") / F.lit(max(total["bad"] or 0, 1))
    good_share = (F.col("good") + 0.5) / F.lit(max(total["good"] or 0, 1))
    share = bad_share / (bad_share + good_share)
    best = counts.where(F.col("bad") >= least_docs).withColumn("share", share).where(F.col("share") >= precision)
    best = best.where(F.col("bad") >= F.col("good") * 2).withColumn("weight", F.log(bad_share / good_share))
    return {r["form"]: float(r["weight"]) for r in best.orderBy((F.col("weight") * F.sqrt("bad")).desc(), "form").limit(size).collect()}


def with_features(docs: DataFrame, features: Features, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and `x`, an array of features of the column text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    sent = docs.sparkSession.sparkContext.broadcast(features)  # at most the lexicon's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "text"):
            x = pa.array([sent.value.of(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), x], [*keep, "x"])

    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", x array<double>")


@dataclass
class ToxicityModel:
    features: Features
    trees: GBTClassificationModel | None
    knots: list[tuple[float, float]]
    base_rate: float

    def score(self, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """The kept columns of docs and score, from 0 to 1. A narrow job.

        Null texts are scored as empty, long ones as a whole; equal texts get equal scores; an empty table gives no rows.
        Other columns are not read; kept ones must not be named x, features, p, score or as the trees' outputs: pack rows
        with such columns in a struct, as drop_toxic does.
        """
        if self.trees is None:
            return docs.select(*keep).withColumn("score", F.lit(self.base_rate))
        x = with_features(docs, self.features, keep).withColumn("features", array_to_vector("x"))
        raw = self.trees.transform(x).withColumn("p", vector_to_array("probability")[1])
        return raw.select(*keep, calibrated(F.col("p"), self.knots).alias("score"))


def calibrated(p, knots: list[tuple[float, float]]):
    """Linear between the knots of the isotonic fit, plus a slope too small to matter that keeps the trees' order."""
    xs = F.array(*[F.lit(x) for x, _ in knots])
    ys = F.array(*[F.lit(y) for _, y in knots])
    n = len(knots)
    i = F.size(F.filter(xs, lambda x: x <= p))
    at = lambda a, k: F.element_at(a, k)
    x0, x1, y0, y1 = at(xs, i), at(xs, i + 1), at(ys, i), at(ys, i + 1)
    line = F.when(i == 0, F.lit(knots[0][1])).when(i >= n, F.lit(knots[-1][1])).otherwise(y0 + (y1 - y0) * (p - x0) / (x1 - x0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), line * 0.999 + p * 0.001))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Learns from at most about max_rows labelled rows that are not held out.

    Half of them teach the lexicon, a third the trees and the rest the calibration, so that none is judged on the rows
    it has learnt from. Without rows of both labels every score is the share of label 1, and 0 if a table is empty.
    Null texts are learnt from as empty; rows that repeat an id are all learnt from, with the id's label; columns other
    than the id, the text and the label are not read.
    """
    rows = sample(docs, labels, label, max_rows)
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(12))
    rows = rows.withColumn("part", part).repartition(8, "doc_id").persist()
    try:
        seen = rows.agg(F.count("*").alias("n"), F.avg("label").alias("rate"), F.min(F.when(F.col("part").between(6, 9), F.col("label"))).alias("least"), F.max(F.when(F.col("part").between(6, 9), F.col("label"))).alias("most")).first()
        if not seen["n"] or seen["least"] == seen["most"]:
            return ToxicityModel(Features(), None, [], float(seen["rate"] or 0.0))
        lexicon = learn_lexicon(rows.where("part < 6").select("text", "label"))
        lexicon.update({"=" + w: max(lexicon.get("=" + w, 0.0), 3.0) for w in SEED_LEXICON})
        features = Features(lexicon)
        x = with_features(rows.where("part >= 6"), features, ("doc_id", "label", "part")).withColumn("features", array_to_vector("x")).select("label", "part", "features").persist()
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=1, minInstancesPerNode=5).fit(x.where("part < 10"))
        raw = model.transform(x).select("label", "part", vector_to_array("probability")[1].alias("p"))
        fit = IsotonicRegression(featuresCol="p", labelCol="label").fit(raw.where("part >= 10") if not raw.where("part >= 10").isEmpty() else raw)
        knots: list[tuple[float, float]] = []
        for a, b in zip(fit.boundaries.toArray().tolist(), fit.predictions.toArray().tolist(), strict=True):
            if not knots or a > knots[-1][0]:
                knots.append((a, b))
        x.unpersist()
        return ToxicityModel(features, model, knots, float(seen["rate"]))
    finally:
        rows.unpersist()


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """docs without the rows whose score reaches the threshold. Rows with null or empty texts are scored like any other."""
    model = train(docs, labels, **options)
    whole = docs.select("text", F.struct(*docs.columns).alias("row"))
    return model.score(whole, ("row",)).where(F.col("score") < threshold).select("row.*")
