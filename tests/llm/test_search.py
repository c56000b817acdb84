"""Decontamination, SimHash, embeddings and components against brute force."""

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from faultline.llm import decontaminate, embeddings, queries, simhash
from faultline.llm import textscan as ts
from faultline.operators.components import components

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def items_of(corpus):
    t = [r[1] or "" for r in corpus]
    return [(1, " ".join(t[1].split()[:25])), (2, t[7].upper()), (3, "the of"), (4, None), (5, "..."), (6, "zzz " * 12), (None, " ".join(t[8].split()[:30])), (10, t[2])]


def brute_phrases(rows, items, window):
    words = lambda t: WORD.findall((t or "").encode().translate(UP))
    found = []
    for i, text in rows:
        w, hit, names = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            n = min(window, len(p))
            for k in range(len(p) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == p[k : k + n]:
                        hit.update(range(s, s + n))
                        names.add("" if item is None else str(item))
        found.append((i, len(w), len(hit), sorted(names)))
    return found


def test_phrases(spark, docs, corpus):
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_phrases([(r[0], r[1]) for r in corpus], items, 10))
    assert sum(w[2] for w in want) > 50
    for block in (2_000_000, 40):
        got = decontaminate.phrase_hits(docs, bench, window=10, block_words=block).collect()
        assert sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in got) == want
    whole = decontaminate.decontaminate(docs, bench)
    assert whole.count() == len(corpus) and {r.runs for r in whole.collect()} == {"mine"}
    left = decontaminate.remove_phrases(docs, bench)
    assert left.columns == docs.columns
    by_id = {w[0]: w for w in want}
    assert all(len(WORD.findall((r.text or "").encode().translate(UP))) == by_id[r.doc_id][1] - by_id[r.doc_id][2] for r in left.collect())


def test_phrases_empty(spark, docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.spans for r in decontaminate.phrase_hits(docs, bench).collect())
    assert decontaminate.phrase_hits(no_docs, bench).collect() == []


def brute_simhash(text, n):
    w = (text or "").encode().translate(UP).split()
    if not w:
        return 0
    grams = [w[i : i + n] for i in range(len(w) - n + 1)] or [w]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, linked):
    root = list(range(len(ids)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for v in range(len(ids)):
        least[find(v)] = min(least.get(find(v), ids[v]), ids[v])
    return [least[find(v)] for v in range(len(ids))]


def test_simhash(docs, corpus):
    prints = [brute_simhash(r[1], 3) for r in corpus]
    for bits in (1, 2, 3):
        comp = brute_components([r[0] for r in corpus], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= bits)
        got = simhash.simhash_classes(docs, shingle=3, bits=bits).collect()
        assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted(zip([r[0] for r in corpus], prints, comp))


def test_simhash_empty(no_docs):
    assert simhash.simhash_classes(no_docs).collect() == []
    assert simhash.near_duplicates_dropped(no_docs).collect() == []


def test_near_duplicates_dropped(docs, corpus):
    kept = simhash.near_duplicates_dropped(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    least = {}
    for r in corpus:
        least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    gone = {r[0] for r in corpus} - set(ids)
    assert {r[0] for r in corpus if least[r[1] or ""] != r[0]} <= gone
    assert 2000 in ids and 2001 in ids


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    for last in (10, 1 << 16):
        roots = {r.node: r.root for r in components(edges, last=last).collect()}
        assert len({roots[i] for i in range(201)}) == 1 and roots[500] == roots[501] != roots[0]
    assert components(edges.limit(0)).collect() == []


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 64)).astype("float32")
    rows = [v for v in base] + [base[i % 8] + 0.03 * rng.standard_normal(64).astype("float32") for i in range(60)] + [base[3]] * 5 + [base[5] * 2, np.zeros(64, "float32")]
    bad = [None, [1.0] * 63 + [float("nan")], [1.0] * 63 + [None], [float("inf")] * 64]
    data = [(i * 3, [float(x) for x in v], 1) for i, v in enumerate(rows)] + [(900 + i, v, None) for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "node")
    fine = np.array(rows[:-1], float)
    unit = fine / np.sqrt((fine * fine).sum(1))[:, None]
    near = unit @ unit.T >= 0.95
    ids = [i * 3 for i in range(len(fine))]
    comp = brute_components(ids, lambda a, b: near[a, b])
    want = {(i, int(near[k].sum()) - 1, comp[k]) for k, i in enumerate(ids)} | {((len(rows) - 1) * 3, 0, (len(rows) - 1) * 3)} | {(900 + i, 0, 900 + i) for i in range(4)}
    assert {(r.vec_id, r.n_links, r.component_id) for r in embeddings.embedding_classes(df).collect()} == want
    split = embeddings.meet(embeddings.spread(embeddings.distinct_vectors(df, "vec_id", "embedding").withColumnRenamed("least", "node"), 0.95, 8, 3), 0.95, 8, tile=7, most=3)
    total = {}
    for r in split.where("b is null").collect():
        total[r.a] = total.get(r.a, 0) + r.n
    whole = {}
    for r in embeddings.meet(embeddings.spread(embeddings.distinct_vectors(df, "vec_id", "embedding").withColumnRenamed("least", "node"), 0.95, 8, 3), 0.95, 8).where("b is null").collect():
        whole[r.a] = whole.get(r.a, 0) + r.n
    assert total == whole
    assert embeddings.embedding_classes(df.limit(0)).collect() == []


def test_registered(spark, docs):
    sf = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(sf):
        return
    got = queries.op4_benchmark_decontamination(spark, sf).toPandas()
    assert got["doc_id"].is_unique and (got["contaminated"] == (got["n_hit"] > 0)).all()
    none = sha256(b"").hexdigest()
    assert (got.loc[got["n_items"] == 0, "items_sha256"] == none).all()
    prints = queries.op5_simhash(spark, sf).toPandas()
    assert prints["fingerprint"].str.fullmatch("[0-9a-f]{16}").all()


def like_texts(seed=3, n=240, template=260):
    """Texts with one long passage in common, many of them edited copies of each other; some of few words."""
    rng = np.random.default_rng(seed)
    shared, out = [f"t{k}" for k in range(template)], []
    for i in range(n):
        if i % 3 and i > 3:
            w = out[int(rng.integers(max(0, i - 40), i))].split()
            for k in rng.integers(0, len(w), int(rng.integers(1, 9))):
                w[k] = f"e{i}x{k}"
        elif i % 24 == 0:
            w = [f"s{i}x{k}" for k in range(int(rng.integers(4, 14)))]
        else:
            w = shared + [f"o{i}x{k}" for k in range(int(rng.integers(40, 110)))]
        out.append(" ".join(w))
    return out


def shingle_set(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def meet(p, q):
    return any(bin((x ^ y) >> shift & 0xFFFFFFFF).count("1") <= 2 for x, y in zip(p, q, strict=True) for shift in (0, 32))


def prints_of(texts):
    codes, of = simhash.shingle_sets(pa.array(texts, pa.string()), 5)
    return simhash.long_fingerprints(codes, of, 12).tolist()


def brute_print(text, lanes=12):
    """The same bits one by one."""
    codes, _ = simhash.shingle_sets(pa.array([text], pa.string()), 5)
    out = []
    for lane in range(lanes):
        h = [int(x) for x in ts.mix(codes + np.array([lane], np.uint64) * ts.BASE)]
        bits = [sum(x >> (8 * k + 7 - j) & 1 for x in h) * 2 > len(h) for k in range(8) for j in range(8)]
        v = sum(1 << (63 - i) for i, on in enumerate(bits) if on)
        out.append(v - 2**64 if v >= 2**63 else v)
    return out


def test_long_fingerprints():
    texts = ["", None, "one", "a b c d e f", "w " * 400, " ".join(f"q{k}" for k in range(40_000)), "A b  c\td E f", " ".join(f"r{k % 97}x{k % 89}" for k in range(700))]
    codes, of = simhash.shingle_sets(pa.array(texts, pa.string()), 5)
    assert np.diff(of).tolist() == [len(shingle_set(t or "")) for t in texts]
    assert codes[of[3] : of[4]].tolist() == codes[of[6] : of[7]].tolist()
    got, names = simhash.long_fingerprints(codes, of, 12).tolist(), simhash.set_names(codes, of)
    assert got == [brute_print(t or "") for t in texts] and len(set(names.tolist())) == 6


def test_classes_are_those_of_exact_similarity(spark):
    """Every pair that meets, and no other, is linked; what meets is nine tenths at least of what is similar."""
    texts = like_texts() + ["w " * 400, "w " * 200 + " ".join(f"q{k}" for k in range(60)), None, ""]
    texts += [texts[5].upper(), texts[5], texts[5]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, fps = [shingle_set(t or "") for t in texts], prints_of(texts)
    jaccard = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    similar = [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] == sets[j] or jaccard(i, j) >= 0.8]
    root = list(range(len(texts)))
    for i, j in similar:
        if sets[i] == sets[j] or meet(fps[i], fps[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert sum(meet(fps[i], fps[j]) for i, j in similar) / len(similar) > 0.9 and len(similar) > 150
    got = dict(simhash.similar_classes(rows, tile=7, lot=100).collect())
    assert [got[i] for i in range(len(texts))] == root
    near = [(i, j) for i, j in similar if 0.8 <= jaccard(i, j) < 0.85]
    assert sum(got[i] == got[j] for i, j in near) / len(near) >= 0.9 and len(near) > 20


def test_items_that_stand_twice_are_named_once(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three"), (7, "four five six"), (None, "two three four"), (None, "three four five")], "item_id long, text string")
    for block in (2_000_000, 3):
        assert [r["items"] for r in decontaminate.phrase_hits(docs, bench, window=3, block_words=block).collect()] == [["", "7"]]


def test_first_pairs_are_taken_once(spark, monkeypatch):
    """Later blocks find nearly all of them in one class: they are all met across classes."""
    calls, few = [], simhash.few_pairs
    monkeypatch.setattr(simhash, "few_pairs", lambda *a: calls.append(1) or few(*a))
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"x{i}"] + words[30:])) for i in range(3)] + [(9, "something else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(simhash.similar_classes(docs).collect())
    assert len(calls) == 1 and got[9] == 9 and len(got) == 4


def test_pair_counts_in_its_first_block(spark):
    """Texts that meet in many blocks are one row, of the first of these; blocks of a later call give nothing for them."""
    rng = np.random.default_rng(3)
    a, b, near, far = 5, 7, [int(x) for x in rng.integers(0, 2**62, 12)], [int(x) for x in rng.integers(0, 2**62, 12)]
    late = far[:6] + near[6:]  # meets both, but in later blocks only
    nodes = spark.createDataFrame([(a, 100, near, None), (b, 100, [x ^ 1 for x in near], None), (9, 100, late, None)], "node long, n long, fp array<long>, codes array<int>").withColumn("few", F.col("codes"))
    classes = nodes.select("node", F.col("node").alias("root"))
    got = []
    for start in (0, 12):
        blocks = simhash.block_codes(nodes, start, 12)
        crowd = simhash.ball_groups(blocks.groupBy("code").agg(F.min("node").alias("rep")))
        got.append(sorted((r.a, r.b) for r in simhash.open_pairs(blocks.join(classes, "node"), crowd, nodes, F.lit(True), 2000).collect()))
    assert got == [[(5, 7)], [(5, 9), (7, 9)]]


def test_small_sets_are_decided_at_once(spark):
    rows = [(10, 10, list(range(10)), [*range(9), 77]), (10, 10, list(range(10)), [*range(8), 77, 78]), (31, 38, list(range(31)), list(range(38)))]
    pairs = spark.createDataFrame([(n, m, [0], [-1], x, y) for n, m, x, y in rows], "n_a long, n_b long, fp_a array<long>, fp_b array<long>, few_a array<int>, few_b array<int>")
    assert [r[0] for r in pairs.select(simhash.alike_in_bits(0.8, 64)).collect()] == [True, False, True]
