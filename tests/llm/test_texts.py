"""Tokens, mixing, extraction, scoring and the pipeline."""

import os
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import html, mixing, quality, queries, toxicity
from faultline.llm.tokens import RankMerger, token_counts

P = pytest.importorskip("public_tokenizers")


def test_tokens(spark, docs, corpus, no_docs):
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    tok = Tokenizer.from_file(path)
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    got = token_counts(docs, path).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted((r[0], len((r[1] or "").encode()), count(r[1])) for r in corpus)
    odd = ["aaaa aaaaaaaaa", "a<|endoftext|>b <|startoftext|>", "ΣΑΣ ς İ ŉ", "don't we'll x's 12 3.5%%% !!", "\x1c\x1d\x85 q z", "ﬁ é ́e", "日本語 한국어 🙂🙂", "B" * 4000]
    assert RankMerger(path).count_texts(odd).tolist() == [count(t) for t in odd]
    assert token_counts(no_docs, path).collect() == []


def targets(sizes, weights, most):
    """Weights of sources in order; what is above a cap is shared out again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return got | share
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free -= over
    return got


def fair_queue(corpus, weights, most):
    """A queue in Python: every source's copies in the order of their draws, merged by finish time until the budget is reached."""
    rows = [(r[0], r[1], r[3], len((r[1] or "").encode().split())) for r in corpus]
    sizes = {}
    for _, _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes, weights, most)
    draw = lambda i, t: md5("|".join(str(x) for x in (i, t) if x is not None).encode()).hexdigest()[:15]
    copies = []
    for s in sizes:
        own, at = sorted((draw(i, t), i, n) for i, t, x, n in rows if x == s), 0
        for turn in range(most):
            for _, i, n in own:
                if at < want[s]:
                    copies.append(((at + n) / want[s], s is None, s or "", i, turn, n))
                at += n
    taken, sent, budget = {}, 0, sum(want.values())
    for _, _, s, i, _, n in sorted(copies):
        if sent + n / 2 <= budget:
            taken[i] = taken.get(i, 0) + n
        sent += n
    return taken


def test_mixing(docs, corpus, no_docs):
    docs = docs.withColumns({c: F.lit("mine") for c in ("slice", "slices", "draw", "through", "size", "target", "turn", "finish", "time", "row", "taken")})
    rows = mixing.mix_taken(docs).collect()
    assert len(rows) == len(corpus)
    sizes, taken, own = {}, {}, {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want = targets(sizes, (5, 2, 1), 3)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        own[r.doc_id] = own.get(r.doc_id, 0) + r.taken
    largest = {s: max(r.size for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    queue = fair_queue(corpus, (5, 2, 1), 3)
    assert own == {i: queue.get(i, 0) for i in own}
    for n in (20_000, 5):
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_taken(docs, rows_a_slice=n).collect()), key=str)
        plan = mixing.mix_schedule(docs, rows_a_slice=n).collect()
        assert [r.finish for r in plan] == sorted(r.finish for r in plan)
        sent = {}
        for r in plan:
            sent[r.doc_id] = sent.get(r.doc_id, 0) + r.size
        assert {i: n for i, n in sent.items() if n} == {i: n for i, n in own.items() if n}
    assert mixing.mix_taken(no_docs).collect() == [] and mixing.mix_schedule(no_docs).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><header><p>Site</p></header><div class="ad banner">Buy</div><!-- <p>no</p> -->
<article class="post"><h1>A   title&nbsp;&lt;1&gt;</h1><p><b>One</b> tw<i>o</i><br>three<p>Four &copy; five<div class="cookie-notice"><p>We use</p></div>
<aside><p>Side</p></aside><form><p>Mail</p></form><ul><li>item</li><li>second</li></ul><section id="comments"><article><p>I say</p></article></section>
<p hidden>secret</p><p>last</p></article><footer>&copy; me</footer>"""


def test_extraction(spark):
    menu = "<div>Home News About us Contact Imprint Privacy Terms and conditions of use here</div>"
    rows = [(1, "https://a.example.com/x", PAGE), (2, None, None), (3, "http://a.example.com:80/y", ""), (4, "x", "<article><p>only</p>"), (5, "x", "plain text &eacute;"), (5, "x", "plain text &eacute;")]
    rows += [(10 + i, f"http://b.example.com/{i}", f"<html><body>{menu}<div>own words of page number {i} are kept</div></body></html>") for i in range(4)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))).collect()}
    assert got[1].text == "A title <1> One two three Four © five item second last"
    assert got[2].text == "" and got[3].text == "" and got[4].text == "only" and got[5].text == "plain text é"
    assert [got[10 + i].text for i in range(4)] == [f"own words of page number {i} are kept" for i in range(4)]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

def test_a_host_in_shares_gives_what_it_gives_as_a_whole(spark):
    rng = np.random.default_rng(8)
    w = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    menu, rare = w(30), [w(15) for _ in range(30)]
    rows = []
    for i in range(60):
        own = [w(int(rng.integers(8, 40))), rare[i // 2]]  # each rare block is on two pages
        mark = f"<article><p>{w(12)}</p></article>" if i % 6 == 0 else ""
        rows.append((i, f"http://{'big' if i < 55 else 'small'}.example.com/{i}", f"<body><div>{menu}</div>{mark}{''.join(f'<div>{x}</div>' for x in own)}</body>"))
    pages = spark.createDataFrame(rows + [rows[3], rows[3]], "page_id long, url string, html string")
    result = lambda n: sorted(map(tuple, html.extract(pages, host_pages=n).collect()))
    whole = result(2000)
    assert sum(r[3] > 30 for r in whole) > 40
    assert result(20) == whole and result(4) == whole and result(1) == whole

def test_main_text_is_marked_by_elements_only():
    body = "<main><p>the text</p><section class='comments'><article class='comment'>a reader</article></section></main><p>rest</p>"
    assert html.Page(body).article == ["the text"]
    assert html.Page("<main><p>the text</p><article class='comment'>a reader</article></main>").article is not None
    assert "the text" in html.Page("<main><p>the text</p><article class='comment'>a reader</article></main>").article
    assert html.Page("<script>x = '<article>'</script><div role=main>the text</div>").article == ["the text"]
    for unmarked in ("<!-- <article> --><p>the text</p>", "<article> </article><main></main><p>the text</p>", "<script>'<main>'</script><p>the text</p>"):
        page = html.Page(unmarked)
        assert page.article is None and page.kept == ["the text"]
    both = html.Page("<main><p>around</p><article>the text</article></main>")
    assert both.article == ["the text"] and both.other == ["around"]


def test_attributes_by_the_rules_of_html():
    assert html.Page("<article><p title=it's>Hello world</p><p>it's fine</p></article>").article == ["Hello world", "it's fine"]
    assert html.Page("<article><p title=\"a > b\" class = x>one<p data-x='</article>'>two</article>").article == ["one", "two"]
    assert html.Page("<article><img alt=\"5\" tall\"/><a href=/x/>y</a> z<p class=\"open>t</p></article>").article[0] == "y z"
    assert html.Page("<article><div title='class=ad'>kept</div><div CLASS=Ad>gone</div><p hidden>gone</p><p style='Display: none'>gone</p></article>").article == ["kept"]
    assert html.attributes_of(" a=1 a=2 B='x y' c d= e") == {"a": "1", "b": "x y", "c": "", "d": "e"}
    assert html.Page("<article>" + "<p a='" * 3000 + "x</article>") is not None  # in time that grows with the page only


def test_one_word_of_a_class_only_makes_suspect(spark):
    page = html.Page("<article><div class='social-history'>of towns</div><p class=search-results>we found</p><div class='share-bar'>share</div><div class='site-footer'>foot</div></article>")
    assert page.article == ["of towns", "we found"] and page.suspect == [0, 1]
    told = "follow us on all of the usual networks and tell your friends about it today"
    rows = [(i, f"http://h.example.com/{i}", f"<article><p>text {i} own words</p><div class='social-history'><p>{told}</p></div><div class='social-history'>{i} is told only here and by no other page of all these</div></article>") for i in range(4)]
    rows.append((9, "http://other.example.com/9", rows[0][2]))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i} own words {i} is told only here and by no other page of all these" for i in range(4))
    assert told in got[9]


def test_rows_that_repeat_are_one_page(spark):
    """A page that stands twice gives what it gives alone: neither does its menu come back, nor does a suspect block go."""
    menu = "<div>Home News About us Contact Imprint Privacy Terms and conditions of use here</div>"
    rows = [(i, f"http://b.example.com/{i}", f"<body>{menu}<div>own words of page number {i} are kept, all of them that are here</div></body>") for i in range(4)]
    rows.append((7, "http://c.example.com/7", "<article><p>the text</p><div class='social-history'>it is told only here and by no other page of all these</div></article>"))
    schema = "page_id long, url string, html string"
    alone = sorted(map(tuple, html.extract(spark.createDataFrame(rows, schema)).collect()))
    assert alone[0][2] == "own words of page number 0 are kept, all of them that are here" and alone[4][2].endswith("of all these")
    for host_pages in (2000, 3, 1):
        again = html.extract(spark.createDataFrame(rows + [rows[0], rows[4], rows[0]], schema), host_pages=host_pages).collect()
        assert sorted(map(tuple, again)) == sorted(alone + [alone[0], alone[0], alone[4]])


def test_sections_that_articles_have_too():
    for kept in ("<section class='discussion'><h2>Discussion</h2><p>We find that</p></section>", "<section class=related><p>Related work in the <a href=x>field</a></p></section>", "<div class='search'>hits of the search</div>"):
        page = html.Page(f"<article><p>one</p>{kept}<p>two</p></article>")
        assert len(page.article) > 2 and page.suspect and {page.article[0], page.article[-1]} == {"one", "two"}
    for gone in (
        "<section class='discussion'><div><span class=author>A</span><p>I say</p></div><div><span class=author>B</span><p>no</p></div></section>", "<div class=related><ul><li><a href=a>More of this</a><li><a href=b>And that</a></ul></div>",
        "<div class='comments'><p>I say</p></div>", "<aside>x</aside>", "<div class=ad>buy</div>", "<div class=search><form>x <input></form></div>",
    ):
        assert html.Page(f"<article><p>one</p>{gone}<p>two</p></article>").article == ["one", "two"]


def test_repeated_tokens_against_brute_force():
    rng = np.random.default_rng(6)
    shared = [rng.integers(0, 50, 14).tolist() for _ in range(4)]
    streams = []
    for i in range(25):
        w = rng.integers(0, 8 if i % 5 == 0 else 5000, int(rng.integers(0, 60))).tolist()
        for k in rng.integers(0, 4, int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = shared[k][: int(rng.integers(8, 15))]
        streams.append(" ".join(f"é{x}" for x in w))
    streams += [streams[3], "", " ".join(f"x{k % 7}" for k in range(200))]
    words = [s.split() for s in streams]
    where = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 9):
            where.setdefault(tuple(w[k : k + 10]), set()).add(i)
    want = []
    for w in words:
        hit = [False] * len(w)
        for k in range(len(w) - 9):
            if len(where[tuple(w[k : k + 10])]) > 1:
                hit[k : k + 10] = [True] * 10
        want.append(hit)
    assert [c.tolist() for c in html.repeated_tokens(streams, 10)] == want and any(map(any, want))


def test_long_and_like_pages(spark):
    long = "".join(f"<p>word{k} and more</p>" for k in range(20_000))
    rows = [(1, "http://h.example.com/1", f"<body><nav>menu</nav><article>{long}</article></body>")] + [(k, "http://h.example.com/2", "<body><nav>menu</nav><div>the very same words on every one of these pages here</div></body>") for k in (2, 3, 4)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got[1].split()) == 60_000
    assert {got[k] for k in (2, 3, 4)} == {"the very same words on every one of these pages here"}  # nothing else would remain


def labelled(spark, n=900):
    rng = np.random.default_rng(0)
    calm = "the of and tion ing stea rend ouat erth anly blea haon shre wher ndea".split()
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(calm, rng.integers(30, 80)).tolist()
        toxic, bad = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(4):
                w.insert(int(rng.integers(0, len(w))), str(rng.choice(["idiot", "gruvelok", "gruvelast", "m0ron"])))
        if bad:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, "word " * 30000), (None, "the of")]
    labels += [(n, 1, 0), (5, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, cut):
    both = scored.join(labels, "doc_id").where(f"{label} is not null").select("doc_id", "score", label).toPandas()
    return ((both["score"] >= cut) == (both[label] == 1)).mean()


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, trees=5)
    scored = model.score(docs, ("doc_id",))
    got = scored.toPandas()
    assert len(got) == 904 and got["score"].between(0, 1).all()
    from faultline.llm.labelled import held_out

    assert accuracy(scored.where(held_out()), labels, "toxic", 0.7) > 0.97
    left = toxicity.drop_toxic(docs.withColumn("features", F.lit(1)), labels, trees=5)
    assert left.columns == ["doc_id", "text", "features"] and 550 < left.count() < 750
    none = toxicity.train(docs, labels.where("toxic = 5"))
    assert {r.score for r in none.score(docs, ("doc_id",)).collect()} == {0.0}


def test_quality(spark):
    docs, labels = labelled(spark)
    scored = quality.score(docs, quality.train(docs, labels, bits=14))
    got = scored.toPandas()
    assert len(got) == 904 and got["score"].between(0, 1).all()
    from faultline.llm.labelled import held_out

    assert accuracy(scored.where(held_out()), labels, "quality", 0.5) > 0.97
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert 0 < len(out) < docs.count() and set(out["doc_id"]) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert (out["taken"] <= 3 * out["size"]).all()
    assert {"op" + str(n) for n in range(1, 11)} == {k.split("_")[0] for k in queries.QUERIES if k.startswith("op")}
