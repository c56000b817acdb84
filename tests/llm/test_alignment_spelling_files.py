"""Token alignment, spelling variants and token files against brute force, the tokenizers' libraries and exact round trips."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import grammar, queries
from faultline.llm.alignment import align, lockstep
from faultline.llm.encoders import ByteEncoder, PieceEncoder, byte_encoder, piece_encoder
from faultline.llm.spelling import near_words, spelling_groups, word_counts

P = pytest.importorskip("public_tokenizers")
A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))
ODD = ["", " ", "  ", " a", "a ", "a  b", "foo\n bar", "foo \nbar", "x<|endoftext|> y <|endoftext|>", "▁a ▁ b▁", "a b 　c", "日本 語 🙂 x", "don't 's 12 3.5%%", "\x1c \x1d", "é ́", "<s> </s> <0x41>", "ab" * 3000, "w " * 2000]


@pytest.fixture
def odd_docs(spark, corpus):
    """The corpus, odd texts and null ids, with columns named as the operators name theirs."""
    rows = [(r[0], r[1]) for r in corpus] + [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "The quick question"), (None, None), (None, "The quick question")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, df.withColumns({c: F.lit("mine") for c in ("key", "id", "a", "b", "pair", "n", "word", "root", "form", "k", "part", "ids", "start", "m", "x", "y", "n_best")})


def test_encoders_equal_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(1)
    bits = ["a", "b ", " ", "\n", "\t", "é", "é ", "the ", "1", "!", "▁", "<|endoftext|>", "́", "日", "'s", " ", "᠎"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    plain = Tokenizer.from_file(A)
    for special in (True, False):
        plain.encode_special_tokens = not special
        own = ByteEncoder(A, special, words=300)
        for k in range(0, len(texts), 100):
            part = texts[k : k + 100]
            ids, of = own.encode(part)
            assert [ids[x:y].tolist() for x, y in zip(of, of[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in part]
            ids, of = own.encode(part, space_first=True)
            want = [plain.encode(" " + t, add_special_tokens=False).ids if t else [] for t in part]
            assert [ids[x:y].tolist() if t else [] for t, x, y in zip(part, of, of[1:])] == want
    library = sentencepiece.SentencePieceProcessor(model_file=B)
    ids, of = PieceEncoder(B, letters=1000).encode(texts, space_first=True)
    assert [ids[x:y].tolist() for x, y in zip(of, of[1:])] == [library.encode(t) for t in texts]


def linked(rows):
    """The tokens, groups and links of each text one after the other."""
    one, other = byte_encoder(A, False), piece_encoder(B)
    found, counts = [], Counter()
    for i, text in rows:
        a = b = ()
        if text:
            (a, _), (b, _) = one.encode([text], True), other.encode([text], True)
            if any(b"".join(t.table[x] for x in ids) != (" " + text).encode() for t, ids in ((one, a), (other, b))):
                a = b = ()
        spans = [np.append(0, np.cumsum([len(t.table[x]) for x in ids])).astype(int).tolist() for t, ids in ((one, a), (other, b))]
        links = [(p, q) for p in range(len(a)) for q in range(max(0, np.searchsorted(spans[1], spans[0][p]) - 1), len(b)) if spans[1][q] < spans[0][p + 1] and spans[1][q + 1] > spans[0][p]] if len(a) < 3000 else None
        if links is None:  # long texts: only near tokens can overlap
            links, q = [], 0
            for p in range(len(a)):
                while spans[1][q + 1] <= spans[0][p]:
                    q += 1
                r = q
                while r < len(b) and spans[1][r] < spans[0][p + 1]:
                    links.append((p, r))
                    r += 1
        cuts = sorted(set(spans[0][1:]) & set(spans[1][1:]))
        group = ";".join(",".join(str(a[p]) for p in range(len(a)) if lo < spans[0][p + 1] <= hi) + "|" + ",".join(str(b[q]) for q in range(len(b)) if lo < spans[1][q + 1] <= hi) for lo, hi in zip([0, *cuts], cuts)) if len(cuts) < 500 else None
        counts.update((int(a[p]), int(b[q])) for p, q in links)
        found.append((i, [(int(a[p]), int(b[q])) for p, q in links], len(a), len(b), len(cuts), group))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(i, na, nb, nc, len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), g) for i, x, na, nb, nc, g in found]


def test_alignment(spark, odd_docs):
    rows, df = odd_docs
    want = sorted(linked(rows), key=str)
    for frequent in (1 << 21, 100, 0):  # the rarer pairs come by a join
        found = align(df, A, B, frequent=frequent)
        assert (found.rest is None) == (frequent == 1 << 21)
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
        got = sorted(((*map(lambda c: r[c], names),) for r in found.with_rest(found.texts).collect()), key=str)
        assert len(got) == len(want)
        assert Counter(g[:7] for g in got) == Counter(w[:7] for w in want)
        groups = Counter((g[0], g[7]) for g in got)
        assert all(groups[w[0], w[7]] for w in want if w[7] is not None)
    empty = align(df.limit(0), A, B)
    assert empty.with_rest(empty.texts).collect() == [] and empty.pairs.collect() == []


def test_lanes_of_long_texts():
    rng = np.random.default_rng(3)
    for lane in (1, 3, 1000):
        sizes = [rng.integers(1, 5, rng.integers(0, 40)) for _ in range(20)]
        a_end, a_of = np.cumsum(np.concatenate(sizes)), np.append(0, np.cumsum([len(s) for s in sizes]))
        b_sizes = [rng.multinomial(s.sum() - m, np.ones(m) / m) + 1 for s in sizes if s.sum() for m in [int(rng.integers(1, s.sum() + 1))]]
        b_end = np.cumsum(np.concatenate(b_sizes))
        i, j, p, q = lockstep(a_end, b_end, a_of, lane)
        a, b = np.append(0, a_end), np.append(0, b_end)
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(len(a_end)) for y in range(len(b_end)) if a[x] < b[y + 1] and b[y] < a[x + 1]}
        assert len(i) == len(set(zip(i.tolist(), j.tolist())))
        assert sorted(zip(p.tolist(), q.tolist())) == [(x, y) for x in range(len(a_end)) for y in range(len(b_end)) if a[x + 1] == b[y + 1]]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return found


def apart(a, b):
    """Whether two words are one edit apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]


def grouped(found, least_length, least_count, factor):
    words = {w: n for w, n in found.items() if n >= least_count and len(w) >= least_length}
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= factor * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out)


def test_spelling(spark, odd_docs):
    rows, df = odd_docs
    rows = rows + [(7000 + i, "Straße strasse STRASSE Strase étable étables établés ÉTABLE × a÷b " * (3 if i % 2 else 1)) for i in range(30)]
    df = df.select("doc_id", "text", "word", "n").unionByName(spark.createDataFrame([(*r, "mine", "mine") for r in rows[-30:]], "doc_id long, text string, word string, n string"))
    assert {r.word: r.n for r in word_counts(df, 1, 7).collect()} == {w: n for w, n in counted(rows, 7).items() if w}
    for least_length, least_count, every, factor in ((6, 5, 199, 5), (1, 1, 3, 2), (2, 2, 0, 1)):
        if factor == 1:  # equal counts would make circles
            continue
        want = grouped(counted(rows, every), least_length, least_count, factor)
        for most in (20_000, 4):
            got = spelling_groups(df, least_length, least_count, every, factor, most).select("word", "form", "root", "n", "n_near", "form_n").collect()
            assert sorted(map(tuple, got)) == want and len(want) > 5
    assert spelling_groups(df.limit(0)).collect() == []


def test_near_words_of_crowded_lists(spark):
    """Words that share almost all of their letters, so that lists are parted down to single places."""
    rng = random.Random(5)
    words = {"stem" + "".join(rng.choice("ab") for _ in range(rng.randint(3, 8))) + "ending" for _ in range(150)} | {"".join(rng.choice("aé") for _ in range(rng.randint(1, 9))) for _ in range(150)} | {"z" * n for n in (300, 301, 303)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = sorted(tuple(sorted(p)) for p in {frozenset((a, b)) for a in words for b in words if apart(a, b)})
    for most in (20_000, 10, 1):
        assert sorted(tuple(sorted((r.word, r.other))) for r in near_words(df, most).collect()) == want


def test_grammar_round_trips():
    rng = np.random.default_rng(1)
    for trial in range(120):
        n = (rng.integers(0, 60, rng.integers(0, 12)) * (rng.random() > 0.1)).astype(int)
        ids, ends = rng.integers(0, rng.integers(1, 6), n.sum()), np.cumsum(n)
        own = grammar.Shard(grammar.pack(ids, ends, 10, least=2, most=[None, 0, 3, 1 << 17][trial % 4]))
        assert own.ids().tolist() == ids.tolist() and len(own) == len(n) and own.part(0, len(ids)).tolist() == ids.tolist()
        for _ in range(5):
            lo, hi = sorted(rng.integers(0, len(ids) + 1, 2))
            assert own.part(lo, hi).tolist() == ids[lo:hi].tolist()
        for k in range(len(n)):
            assert own.document(k).tolist() == ids[ends[k] - n[k] : ends[k]].tolist()
        assert own.lengths.tolist() == [len(own.expanded(np.array([10 + k]))) for k in range(len(own.lengths))]
    many = np.tile(np.arange(50), 400)
    data = grammar.pack(many, np.array([len(many)]), 50257)
    assert len(data) < len(many) / 8 and grammar.Shard(data).ids().tolist() == many.tolist()
    big = np.arange(100_000).repeat(2)
    assert grammar.Shard(grammar.pack(big, np.array([5, len(big)]), 100_000)).width == 4
    with pytest.raises(ValueError):
        grammar.Shard(b"something else, long enough to be read")


def test_token_files(spark, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    rows, df = odd_docs
    plain = Tokenizer.from_file(A)
    path = str(tmp_path / "ids")
    grammar.write_ids(df, path, A, end_id=2, shard=500)
    shards = spark.read.parquet(path)
    assert shards.count() > 8 and shards.agg(F.sum("n_ids")).first()[0] == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in grammar.read_ids(spark, path).collect()))
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert Counter((i, tuple(x)) for _, i, x, _ in got) == want
    assert [i for _, i, _, _ in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, i))
    at = 0
    for start, _, ids, n in got:
        assert start == at and n == len(ids)
        at += n
    empty = str(tmp_path / "none")
    grammar.write_ids(df.limit(0), empty, A)
    assert grammar.read_ids(spark, empty).collect() == []


def test_queries_of_given_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = linked(rows)
    got = {r.doc_id: r for r in queries.op11_token_alignment(spark, d).collect()}
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    assert sorted(tuple(r[c] for c in names) for r in got.values()) == sorted(w[:7] for w in want)
    from hashlib import sha256

    assert all(got[w[0]].groups_sha256 == (sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want if w[7] is not None)
    assert sorted(map(tuple, queries.op12_spelling_variants(spark, d).collect())) == grouped(counted(rows, 199), 6, 5, 5)
    at = 0
    plain = byte_encoder(A)
    for r, (i, text) in zip(sorted(queries.op13_token_files(spark, d).collect()), sorted(rows), strict=True):
        ids = plain.encode([text or ""])[0].tolist() + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_words_are_learnt_in_one_step_whatever_they_hold():
    """Fresh words that stand in one batch with odd ones get the ids of their own place; what fails leaves nothing known."""
    own = ByteEncoder(A)
    texts = [" ".join(f"w{k}x" if k % 7 else ("a▁b", "é,\nIs", "<|endoftext|>", "x\t\ty")[k % 4] for k in range(j, j + 450)) for j in (0, 100, 100)]
    ids, of = own.encode(texts)
    assert [ids[x:y].tolist() for x, y in zip(of, of[1:])] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.at.base is None and own.n <= len(own.at) and sorted([*own.known.values(), *own.known_first.values()])[2:] == list(range(1, own.n))
    joined, own.encode_joined = own.encode_joined, None
    with pytest.raises(TypeError):
        own.encode(["some fresh words"])
    own.encode_joined = joined
    ids, _ = own.encode(["some fresh words"])
    assert ids.tolist() == own.library.encode("some fresh words", add_special_tokens=False).ids


def test_pairs_of_two_byte_symbols_take_four_bytes():
    """Ids near the limit of two bytes, where a pair is the largest number of 32 bits but a few, and pairs across documents."""
    rng = np.random.default_rng(2)
    for base in (50_001, 65_530, 65_536, 70_000):
        ids = base - 1 - rng.integers(0, 3, 30_000)
        ends = np.sort(rng.integers(0, 30_000, 500))
        ends[-1] = 30_000
        own = grammar.Shard(grammar.pack(ids, ends, base))
        assert own.ids().tolist() == ids.tolist() and own.width == (2 if base < 65_536 or not len(own.rules) and base == 65_536 else 4)
        assert all(own.document(k).tolist() == ids[ends[k - 1] if k else 0 : ends[k]].tolist() for k in range(len(ends)))
