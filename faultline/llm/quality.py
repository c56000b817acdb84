"""Quality: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textscan as ts
from faultline.llm.labelled import sample

#: Kinds of bytes: 0 white space and controls, 1 lower case and beyond ASCII, 2 capitals, 3 digits, 4 other signs.
KIND = np.full(256, 4, np.uint8)
KIND[:33] = 0
KIND[97:123] = 1
KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3
LETTER = np.isin(KIND, (1, 2))
SIGN = KIND == 4
DIGIT = KIND == 3


def hashed_ngrams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of texts as a sparse matrix: offsets of the texts' rows, columns, values (rows have length 1).

    Words, numbers and runs of signs are tokens; letters and signs that stand together are parted. Uni- and bigrams of
    tokens in lower case, and uni- to trigrams of their shapes (how a word is capitalised, the signs themselves, how
    long a line or word is, whether the word was there before) are hashed to 2**bits columns.
    """
    data, off = ts.buffer(texts)
    n = len(off) - 1
    empty = (np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not len(data):
        return empty
    low = ts.LOWER[data]
    found = [ts.words(data, off, mask) for mask in (LETTER, SIGN, DIGIT)]
    starts, ends = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    if not len(starts):
        return empty
    kind = np.repeat(np.arange(3), [len(f[0]) for f in found])
    order = np.argsort(starts)
    starts, ends, kind = starts[order], ends[order], kind[order]
    doc = np.searchsorted(off, starts, "right") - 1
    roll = ts.Rolling(ts.BYTE_VALUES[low])
    token = roll.of(starts, ends)
    token[kind == 2] = np.uint64(5)
    caps = np.concatenate(([0], np.cumsum(KIND[data] == 2)))
    n_caps, size = caps[ends] - caps[starts], ends - starts
    shape = np.where(kind == 0, np.where(n_caps == 0, 1, np.where((n_caps == size) & (size > 1), 2, np.where(n_caps == 1, 3, 4))) + 8 * np.minimum(size // 4, 4), 0).astype(np.uint64)
    shape = np.where(kind == 1, token, ts.mix(shape + np.uint64(77)))
    # Words that the text already has.
    both = np.lexsort((token, doc))
    again = np.zeros(len(token), bool)
    same = (token[both][1:] == token[both][:-1]) & (doc[both][1:] == doc[both][:-1])
    again[both[1:][same]] = True
    cols, rows = [], []

    def add(values: np.ndarray, at: np.ndarray, salt: int) -> None:
        cols.append(ts.mix(values + np.array([salt], np.uint64) * ts.BASE) >> np.uint64(64 - bits))
        rows.append(at)

    add(token, doc, 1)
    add(shape, doc, 2)
    next_doc = doc[1:] == doc[:-1]
    add((token[:-1] * ts.BASE + token[1:])[next_doc], doc[:-1][next_doc], 3)
    add((shape[:-1] * ts.BASE + shape[1:])[next_doc], doc[:-1][next_doc], 4)
    three = next_doc[1:] & next_doc[:-1] if len(doc) > 2 else np.zeros(0, bool)
    if len(three):
        add(((shape[:-2] * ts.BASE + shape[1:-1]) * ts.BASE + shape[2:])[three], doc[:-2][three], 5)
    # A few words about the whole text: how much of it repeats, its length, its share of signs and capitals.
    tokens = np.bincount(doc, minlength=n)
    safe = np.maximum(tokens, 1)
    pair = np.zeros(len(doc), np.uint64)
    pair[:-1] = token[:-1] * ts.BASE + token[1:]
    by = np.lexsort((pair, doc))
    rep = np.bincount(doc[by][1:][(pair[by][1:] == pair[by][:-1]) & (doc[by][1:] == doc[by][:-1])], minlength=n) / safe
    lines = np.bincount(np.searchsorted(off, np.flatnonzero(data == 10), "right") - 1, minlength=n)[:n]
    whole = [
        np.minimum(rep * 20, 19).astype(int),
        np.log2(safe).astype(int),
        (np.bincount(doc, kind == 1, n) / safe * 20).astype(int),
        (np.bincount(doc, (n_caps > 0) & (n_caps == size) & (kind == 0), n) / safe * 20).astype(int),
        (np.bincount(doc, kind == 2, n) / safe * 20).astype(int),
        np.log2(1 + lines / safe * 100).astype(int),
        (np.bincount(doc, again, n) / safe * 20).astype(int),
        (np.bincount(doc, size * (kind == 0), n) / np.maximum(np.bincount(doc, kind == 0, n), 1)).astype(int),
    ]
    has = np.flatnonzero(tokens)
    extra = [ts.mix(np.asarray(w)[has].astype(np.uint64) + np.uint64(100 + 1000 * k)) >> np.uint64(64 - bits) for k, w in enumerate(whole)]
    col, row = np.concatenate(cols).astype(np.int64), np.concatenate(rows)
    key = row * (1 << bits) + col
    key, count = np.unique(key, return_counts=True)
    row, col = key >> bits, key & ((1 << bits) - 1)
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value = value / norm[row]
    row = np.concatenate([row, *[has] * len(extra)])
    col = np.concatenate([col, *(e.astype(np.int64) for e in extra)])
    value = np.concatenate([value, np.full(len(has) * len(extra), 0.35)])
    # An n-gram and a word about the whole text may share a column: their values add up, so each column stands once in a row.
    order = np.argsort(row << bits | col, kind="stable")
    row, col, value = row[order], col[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (col[1:] != col[:-1]))))
    return np.searchsorted(row[first], np.arange(n + 1)), col[first], np.add.reduceat(value, first)


def ftrl(texts: list[str], labels: np.ndarray, bits: int, epochs: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights after FTRL-proximal updates over the rows in a fixed pseudo-random order; the last weight is the bias."""
    z, g2 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    blocks = []
    for k in range(0, len(texts), 500):
        off, col, value = hashed_ngrams(pa.array(texts[k : k + 500], pa.string()), bits)
        blocks += [(np.append(col[a:b], 1 << bits), np.append(value[a:b], 0.5)) for a, b in zip(off, off[1:], strict=False)]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(blocks)):
            col, value = blocks[i]
            zi, gi = z[col], g2[col]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(gi)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ value, -30, 30)))
            g = (p - labels[i]) * value
            z[col] = zi + g - (np.sqrt(gi + g * g) - np.sqrt(gi)) / alpha * w
            g2[col] = gi + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 16_000, bits: int = 18, epochs: int = 4, learners: int = 4) -> np.ndarray:
    """Weights from about max_rows labelled rows at most, none of them held out.

    The rows are dealt to `learners` tasks, each of which runs FTRL over its share (max_rows bounds it); the mean of
    their weights is the model. Without labelled rows all weights are 0 and every score is one half, as with an empty
    table of either. Null texts are learnt from as empty; rows that repeat an id are all learnt from, with the id's label;
    columns other than the id, the text and the label are not read. Equal ids go by text, so reruns agree.
    """
    rows = sample(docs, labels, label, max_rows).withColumn("learner", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(learners)))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"])
        w = ftrl(group["text"].tolist(), group["label"].to_numpy(), bits, epochs)
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "n": [len(group)]})

    learnt = rows.groupBy("learner").applyInPandas(learn, "w binary, n long").collect()
    if not learnt:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.average([np.frombuffer(r["w"], np.float32) for r in learnt], axis=0, weights=[r["n"] for r in learnt]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score, from 0 to 1: sparse dot products, in a narrow job.

    Null texts are scored as empty, long ones as a whole; equal texts get equal scores; an empty table gives no rows;
    columns that are not kept are not read, whatever their names.
    """
    bits = int(len(weights) - 1).bit_length() - 1
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes * 2**bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for part in ts.slices(batches, "text", 2 << 20):
            off, col, value = hashed_ngrams(part.column("text").fill_null(""), bits)
            n = len(off) - 1  # each text is summed by itself, so that equal texts get equal scores in any batch
            total = np.bincount(np.repeat(np.arange(n), np.diff(off)), w[col] * value, n) + 0.5 * w[-1]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], [*keep, "score"])

    picked = docs.select(*keep, *([] if "text" in keep else [docs["text"].cast("string").alias("text")]))
    return picked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double")
