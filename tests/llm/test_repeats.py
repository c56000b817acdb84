"""Repeated byte strings and passages against brute force."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import passages, substrings
from faultline.llm.fmindex import Bits, CompressedBits, FMIndex, WaveletMatrix, suffix_array


def brute_bytes(rows, length):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha)}; equal rows count once."""
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        b = text.encode()
        hit = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                hit[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        out[i, text] = (len(b), int(hit.sum()), spans, sha256(bytes(np.frombuffer(b, np.uint8)[~hit])).hexdigest())
    return out


def test_bytes(docs, corpus):
    got = substrings.remove_repeats(docs, length=100).withColumn("sha", F.sha2("kept", 256)).collect()
    want = brute_bytes([(r[0], r[1]) for r in corpus], 100)
    assert len(got) == len(corpus)
    by_id = {i: v for (i, _), v in want.items()}
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == {(i, *v) for i, v in by_id.items()}
    assert sum(r.n_removed for r in got) > 1000


def test_bytes_empty(no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []


def test_nulls_in_ids(spark):
    t = "abcdefghij" * 15
    df = spark.createDataFrame([(None, t), (3, t), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect()} == {(None, 150), (3, 140), (None, 0)}


def brute_words(rows, window):
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        hit = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                hit[s : s + window] = [True] * window
        out.append((i, len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h).decode()))
    return out


def test_passages(docs, corpus):
    got = passages.remove_passages(docs, window=50)
    assert got.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed", "kept_words"]
    rows = got.collect()
    want = brute_words([(r[0], r[1]) for r in corpus], 50)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in rows) == sorted(want)
    assert sum(r.n_removed for r in rows) > 300
    assert all(r.text == t for r in rows if not r.n_removed for i, t in [(x[0], x[1]) for x in corpus] if i == r.doc_id)
    assert {r.runs for r in rows} == {"mine"}


def test_passages_of_a_heavy_anchor(docs, corpus, monkeypatch):
    """The same with every anchor dealt window by window."""
    from faultline.llm import repeats

    monkeypatch.setattr(repeats, "heavy_anchors", lambda d, unit, window, gram, other: np.unique([r.h for r in repeats.scan(d, unit, window, gram, other).collect()]))
    got = passages.remove_passages(docs, window=50).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_words) for r in got) == sorted(brute_words([(r[0], r[1]) for r in corpus], 50))


def test_bytes_of_a_heavy_anchor(docs, corpus, monkeypatch):
    from faultline.llm import repeats

    monkeypatch.setattr(repeats, "heavy_anchors", lambda d, unit, window, gram, other: np.unique([r.h for r in repeats.scan(d, unit, window, gram, other).collect()]))
    got = substrings.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    want = {i: v for (i, _), v in brute_bytes([(r[0], r[1]) for r in corpus], 100).items()}
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == {(i, *v) for i, v in want.items()}


def test_match_shard():
    """Segments of windows around shared gram: copies, edges of repeats, one document twice, one window each."""
    rng = np.random.default_rng(5)
    for window, most in ((10, 6), (10, 1), (4, 3)):
        stock = rng.integers(0, 4, 60).astype(np.uint64) * np.uint64(7) + np.uint64(3)
        shard, n, key_id = [], [], []
        for _ in range(80):
            k = int(rng.integers(1, most + 1))
            at = int(rng.integers(0, 60 - k - window + 2))
            words = stock[at : at + k + window - 1].copy()
            if rng.random() < 0.5:
                words[rng.integers(0, len(words))] = rng.integers(10**6)
            shard.append(words), n.append(k), key_id.append(int(rng.integers(0, 30)))
        first = {}
        for words, k, i in zip(shard, n, key_id):
            for p in range(k):
                w = words[p : p + window].tobytes()
                first[w] = min(first.get(w, i), i)
        want = {(j, p) for j, words in enumerate(shard) for p in range(n[j]) if first[words[p : p + window].tobytes()] < key_id[j]}
        seg, place = passages.match_shard(shard, np.array(key_id), np.array(n), window)
        assert len(seg) == len(want) and set(zip(seg.tolist(), place.tolist())) == want and want


def test_index_decides(docs):
    """Between slices, no run is settled before it meets the index."""
    from faultline.llm import repeats
    from faultline.llm.tables import doc_key

    keyed = doc_key(docs.select("doc_id", "text"))
    spread = keyed.repartition(keyed.count(), "key_id")
    runs = passages.repeated_passages(spread, 50, 25)
    assert runs.count() > 0
    apart = repeats.scan(spread, "words", 50, 25, True).withColumn("c", F.xxhash64("key_id", "key_text"))
    met = repeats.settle(apart, True)
    within = {(r.key_id, r.lo) for r in repeats.scan(spread, "words", 50, 25, True).where("known").collect()}
    assert {(r.key_id, r.lo) for r in met.where("known").collect()} == within


def test_passages_empty(no_docs):
    assert passages.remove_passages(no_docs).collect() == []


def test_compressed_bits():
    rng = np.random.default_rng(4)
    for n in (0, 1, 14, 15, 16, 239, 240, 241, 5000):
        for share in (0, 0.01, 0.5, 0.97, 1):
            bits = rng.random(n) < share
            packed, at = CompressedBits(bits), np.arange(n + 1)
            assert packed.rank(at).tolist() == [0, *np.cumsum(bits).tolist()]
            assert packed.get(at[:-1]).tolist() == bits.tolist()
            assert (packed.rank(np.stack([at, at])) == Bits(bits).rank(at)).all()
    rare = CompressedBits(rng.random(100_000) < 0.01)
    assert rare.nbytes() * 8 < 0.7 * 100_000


@pytest.mark.parametrize("compressed", [False, True])
def test_fm_index(compressed):
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5, 800)
    assert suffix_array(text).tolist() == sorted(range(800), key=lambda i: text[i:].tolist())
    tree = WaveletMatrix(text, 5, CompressedBits if compressed else Bits)
    for c in range(5):
        assert tree.rank(np.full(801, c), np.arange(801)).tolist() == [0, *np.cumsum(text == c).tolist()]
    index = FMIndex(text, 5, compressed=compressed)
    patterns = np.array([text[i : i + 4] for i in range(0, 790, 7)] + [[1, 1, 1, 1], [4, 3, 2, 1]])
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi):
        want = [i for i in range(797) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block", [(1 << 15) - 1, 0b1111111, 0b11111111, 0b101010101010101, 0])
def test_words_of_one_class_fill_their_counters(block):
    """Sixteen equal blocks have the most ones, or the most bits of offsets, that a word's counters have to hold."""
    bits = np.tile((block >> np.arange(15)) & 1, 16 * 40).astype(bool)
    at = np.arange(len(bits) + 1).reshape(1, -1)
    packed = CompressedBits(bits)
    assert (packed.rank(at)[0] == np.append(0, np.cumsum(bits))).all() and (packed.get(at[:, :-1])[0] == bits).all() and packed.heads.dtype == np.uint64


def test_suffixes_of_many_symbols():
    rng = np.random.default_rng(3)
    for top in (3, 65_536, 65_537, 200_000):
        text = np.append(rng.integers(0, top, 300), [top - 1, 0])
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
