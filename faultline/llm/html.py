"""Main text of web pages: structure first, and a suffix array for each host over what the structure leaves open."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import textscan as ts
from faultline.llm.fmindex import suffix_array
from faultline.llm.tables import cut_table

_NAME, _VALUE = r"[^\s/>][^\s/>=]*", r"\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|{_NAME}(?:\s*=\s*(?:{_VALUE})?+)?+)*+)>", re.S)
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*=\s*({_VALUE})?+)?+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
RAW = frozenset(("script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "math", "object", "head", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
APART = frozenset(("nav", "footer", "aside", "form", "menu", "button", "select", "dialog", "datalist", "fieldset", "audio", "video", "canvas"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Words that mark what is no article: a class, id or role of only these, or of these and words of PLACES, rules an element out.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar complementary widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond responses "
    "discussion footer contentinfo masthead copyright pagination pager toolbar search teaser teasers".split()
)
#: Words of HINTS that an article's own sections go by as well: they rule out only what is built as its name says (see built_apart).
AMBIGUOUS = frozenset("discussion related search recommended recommendations respond responses social promotion subscription teaser teasers".split())
PLACES = frozenset("area articles bar block bottom box button buttons col column container content form group header hero icons inner item items link links list main media outer page panel post posts primary row secondary section site slot stories text thread title top unit wrap wrapper".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
_ANY_MAIN = re.compile(r"<(article|main)\b|role\s*=\s*[\"']?main\b|articleBody", re.I)


def attributes_of(tag: str) -> dict[str, str]:
    """The attributes of a tag by HTML's rules: quotes count only where a value begins, of repeated names the first."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def names_of(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each class, id and role."""
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split()
    return [[w.lower() for w in _PARTS.findall(n)] for n in names] + [[w.lower() for w in _PARTS.findall(attributes.get("aria-label", ""))]]


def ruled_out(names: list[list[str]]) -> bool:
    return any(HINTS.intersection(n) and HINTS.union(PLACES).issuperset(n) for n in names)


_LINK = re.compile(r"<a\b[^>]*>(.*?)(?:</a\s*>|\Z)", re.S | re.I)
_SIGNED = re.compile(r"<time\b|(?:class|itemprop|rel)\s*=\s*[\"']?[^\"'>]*\b(?:author|byline|avatar|comment|date|reply|username)\b", re.I)
_ANY_TAG = re.compile(r"<[^>]*>")


def element_at(html: str, at: int, tag: str) -> str:
    """What an element of this tag holds that opens before `at`: up to its end tag, or to the end of the page."""
    depth = 1
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])", html[at:], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return html[at : at + m.start()]
    return html[at:]


def built_apart(inner: str) -> bool:
    """Whether an element is a list of links (half of its text or more), or of entries with author or date marks (two or more)."""
    size = lambda x: len("".join(_ANY_TAG.sub(" ", x).split()))
    links = sum(size(x) for x in _LINK.findall(inner))
    return links > 0 and 2 * links >= size(inner) or len(_SIGNED.findall(inner)) > 1


class Page:
    """Parts a page into blocks. article: the blocks of the main text, or None if no element marks any; other: the rest.

    An article is looked for first, then a main element. What only a comment, a script or a section of readers' comments
    holds, or what is empty, marks nothing: the next is tried.

    A class or id rules an element out if all its words do so (comments, site-footer). Where only one of its words would
    (social-history), or where articles have sections of that name too (discussion, related), blocks of the article in it are
    suspect: they go if other pages of the host repeat them. An element of such a name goes as a whole if it is built so: see built_apart.
    """

    def __init__(self, html: str):
        marks = {m[1].lower() if m[1] else "main" for m in _ANY_MAIN.finditer(html)}
        for wanted in [w for w in ("article", "main") if w in marks] + [None]:
            self.read(html, wanted)
            if self.article:
                break

    def read(self, html: str, wanted: str | None) -> None:
        self.wanted = wanted
        self.article: list[str] | None = [] if self.wanted else None
        self.suspect: list[int] = []  # places of blocks in the article
        self.other: list[str] = []
        self.kept: list[str] = []  # without a marked article: blocks that no element or hint rules out
        self.parts: list[str] = []
        inside, skip, depth, end = 0, "", 0, 0
        main_tag, self.doubt, doubts = "", "", 0
        at, size = 0, len(html)
        lower = None
        while at < size:
            m = _TAG.search(html, at)
            stop = m.start() if m else size
            if stop > at:
                self.parts.append(html[at:stop])
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                if m[3].endswith("/"):
                    continue
                lower = lower or html.lower()
                end = lower.find(f"</{tag}", at)
                if tag == "head":  # a head that is not closed ends where the body begins
                    body = lower.find("<body", at)
                    end = body if end < 0 or 0 <= body < end else end
                    if end < 0:
                        continue
                at = size if end < 0 else end
                continue
            attributes = attributes_of(m[3]) if m[3] and not closing else {}
            if tag in INLINE and tag != skip and not attributes.keys() & {"class", "id", "role", "aria-label"}:
                continue
            if tag not in INLINE:
                self.close(inside > 0, bool(skip))
            if closing:
                if skip:
                    if tag == skip:
                        depth -= 1
                        if not depth:
                            self.close(inside > 0, True)
                            skip = ""
                    elif skip in ("p", "li") and tag not in INLINE:
                        skip = ""
                if not skip and inside and tag == main_tag:
                    inside -= 1
                if not skip and tag == self.doubt:
                    doubts -= 1
                    self.doubt = self.doubt if doubts else ""
                continue
            if skip and (skip in ("p",) and tag not in INLINE or skip == "li" and tag == "li"):
                skip = ""
            if skip and tag in ("article", "main") and skip in ("nav", "header", "menu"):
                skip = ""
            if skip:
                depth += tag == skip
                continue
            if tag in VOID or m[3].endswith("/"):
                continue
            names = names_of(attributes)
            marks = {w for n in names for w in n}
            is_main = tag == self.wanted or self.wanted == "main" and ("main" in attributes.get("role", "").lower().split() or "articleBody" in m[3])
            if is_main and not marks & READERS:
                if not inside:
                    main_tag = tag
                inside += 1
                continue
            if inside and tag == main_tag:
                inside += 1
            hidden = attributes.get("hidden", "false").lower() != "false" or attributes.get("aria-hidden", "").lower() == "true" or _NONE.search(attributes.get("style", ""))
            out = tag in APART or tag == "header" and not inside or ruled_out(names) and tag not in ("html", "body", "main") or bool(hidden)
            if out and inside and tag not in APART and not hidden and all(AMBIGUOUS & set(n) for n in names if ruled_out([n])):
                out = built_apart(element_at(html, at, tag))
            if "header" in marks and not inside and tag not in ("html", "body"):
                out = True
            if out:
                if tag in INLINE:
                    self.close(inside > 0, False)
                if inside and tag == main_tag:
                    inside -= 1
                skip, depth = tag, 1
            elif self.doubt:
                doubts += tag == self.doubt
            elif inside and marks & HINTS and tag not in INLINE:
                self.doubt, doubts = tag, 1
        self.close(inside > 0, bool(skip))

    def text(self) -> str:
        raw = "".join(self.parts)
        return " ".join((unescape(raw) if "&" in raw else raw).split())

    def close(self, inside: bool, skipped: bool) -> None:
        if not self.parts:
            return
        text = self.text()
        self.parts = []
        if not text:
            return
        if self.wanted and inside and not skipped:
            if self.doubt:
                self.suspect.append(len(self.article))
            self.article.append(text)
        else:
            self.other.append(text)
            if not self.wanted and not skipped:
                self.kept.append(text)


#: Hosts with over host_pages up to which their numbers (a name and an int each) are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 50_000

PARSED = "page_id {id}, url {url}, host string, salt int, draw long, marked boolean, suspect array<int>, text string, stream string"


def parse(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html, host, draw and shares, into how many the host's pages are dealt (null: not at all).

    Pages alike in stream and article share a salt, so that they meet as one page.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "html"):
            marked, suspect, text, stream = [], [], [], []
            for html in part.column("html").to_pylist():
                page = Page(html or "")
                marked.append(page.article is not None)
                suspect.append(page.suspect)
                text.append("\n".join(page.article or ()))
                stream.append("\n".join(page.other + [page.article[i] for i in page.suspect] if page.article is not None else page.kept))
            salt = [crc32(f"{x}\0{y}".encode()) % n if n else -1 for x, y, n in zip(stream, text, part.column("shares").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("page_id", "url", "host")), pa.array(salt, pa.int32()), part.column("draw"), pa.array(marked), pa.array(suspect, pa.list_(pa.int32())), pa.array(text, pa.string()), pa.array(stream, pa.string())],
                ["page_id", "url", "host", "salt", "draw", "marked", "suspect", "text", "stream"],
            )

    return pages.mapInArrow(run, PARSED.format(id=kinds["page_id"], url=kinds["url"]))


def repeated_tokens(streams: list[str], run_tokens: int) -> list[np.ndarray]:
    """For each stream, which of its tokens are covered by run_tokens consecutive ones that another stream holds too.

    The streams are concatenated with a separator of its own after each; a suffix array sorts all suffixes, those that
    share their first run_tokens tokens stand together, and groups with suffixes of several streams are repeated.
    """
    data, off = ts.buffer(pa.array(streams, pa.string()))
    starts, ends, of = ts.words(data, off, ~ts.SPACES)
    n = np.diff(of)
    covered = [np.zeros(k, bool) for k in n.tolist()]
    if not len(starts) or n.max() < run_tokens:
        return covered
    h = ts.hashes(data, starts, ends)
    _, number = np.unique(h, return_inverse=True)
    page = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(page)) - np.repeat(of[:-1] + np.arange(len(n)), n + 1)
    token = place < n[page]
    text = np.empty(len(page), np.int64)
    text[token] = number
    text[~token] = number.max() + 1 + np.arange(len(n))
    order = suffix_array(text)
    order = order[place[order] + run_tokens <= n[page[order]]]
    if not len(order):
        return covered
    names = ts.Rolling(text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    name = names.of(order, order + run_tokens)
    first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    size = np.diff(np.append(first, len(order)))
    pages = page[order]
    several = np.repeat(np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first), size)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, order[several], 1)
    np.add.at(change, order[several] + run_tokens, -1)
    hit = np.cumsum(change)[:-1] > 0
    at = np.concatenate(([0], np.cumsum(n + 1)))
    return [hit[at[i] : at[i] + k] for i, k in enumerate(n.tolist())]


def windows(streams: list[str], run_tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all windows of run_tokens tokens, their first tokens, and where each stream's tokens start."""
    data, off = ts.buffer(pa.array(streams, pa.string()))
    starts, ends, of = ts.words(data, off, ~ts.SPACES)
    stream = np.repeat(np.arange(len(streams)), np.diff(of))
    at = np.flatnonzero(np.arange(len(stream)) + run_tokens <= np.asarray(of)[1:][stream])
    if not len(at):
        return np.zeros(0, np.int64), at, of
    roll = ts.Rolling(ts.hashes(data, starts, ends) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return roll.of(at, at + run_tokens).view(np.int64), at, of


def named_tokens(streams: list[str], run_tokens: int, names: np.ndarray) -> list[np.ndarray]:
    """For each stream, which of its tokens are covered by windows of these names."""
    name, at, of = windows(streams, run_tokens)
    at = at[np.isin(name, names)]
    change = np.zeros(of[-1] + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + run_tokens, -1)
    return np.split(np.cumsum(change)[:-1] > 0, of[1:-1])


def shared_windows(parsed: DataFrame, run_tokens: int) -> DataFrame:
    """(host, salt, name): the windows of each share of a host that another share of it holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in ts.slices(batches, "stream"):
            host, salt, streams = (part.column(c).to_pylist() for c in ("host", "salt", "stream"))
            shares: dict[tuple[str, int], list[str]] = {}
            for h, k, x in zip(host, salt, streams, strict=True):
                shares.setdefault((h, k), []).append(x)
            for (h, k), some in shares.items():
                names = np.unique(windows(some, run_tokens)[0])
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(names), pa.string()), pa.array([k] * len(names), pa.int32()), pa.array(names)], ["host", "salt", "name"])

    held = parsed.select("host", "salt", "stream").mapInArrow(run, "host string, salt int, name long").distinct()
    return held.withColumn("shares", F.count("*").over(Window.partitionBy("host", "name"))).where("shares > 1").drop("shares")


def extract(pages: DataFrame, run_tokens: int = 10, host_pages: int = 2000, id_column: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_boilerplate) for each row of pages (page_id, url, html).

    Each page is parted into blocks. If an <article> (or else <main>, role=main or articleBody) marks the main text, its
    blocks are the text, without menus, forms, adverts, notices, comments and so on inside it. Passages of an article that
    other pages hold too stay; only of its suspect blocks (see Page) go those that are repeated as a whole. Otherwise the text is what remains of all other
    blocks when those are removed whose words are all inside runs of at least run_tokens words that other pages of the
    host hold as well; a page of which nothing would remain is left whole.

    The runs come from suffix arrays over the token streams of a host's pages. Pages are shuffled by host; those of hosts
    with over host_pages are dealt by page as well, to shares of about host_pages. Runs that pages of different shares
    hold are found by the hashes of all windows of run_tokens words and sent to the shares that hold them, so the result
    doesn't depend on how pages are dealt. n_boilerplate counts the covered words (for marked pages, among the words outside the article).

    Rows that repeat, and pages of a host that are alike in all their words, count as one page, so that their words aren't
    repeated for that. Null html gives an empty text, null urls are one host; an empty table gives no rows. Other columns are not read.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col("url").cast("string")), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), "url", F.col("html").cast("string").alias("html"), host.alias("host"), F.pmod(F.xxhash64(id_column, "url", "html"), F.lit(1 << 40)).alias("draw"))
    counts = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > host_pages)
    large = cut_table(counts.select("host", F.ceil(F.col("n") / host_pages).cast("int").alias("shares")))
    hot = large.count()
    parsed = parse(rows.join(F.broadcast(large) if hot <= BROADCAST_HOSTS else large, "host", "left"))
    every = parsed.withColumn("name", F.lit(None).cast("long"))
    if hot:  # a host has over host_pages; pages are parsed again for the names: a second read takes less than the disk of a parsed copy
        every = every.unionByName(shared_windows(parsed.where("salt >= 0"), run_tokens), allowMissingColumns=True)
    ordered = every.repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("name").desc_nulls_last(), "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        names: list[np.ndarray] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            host, salt = batch.column("host").to_pylist(), np.asarray(batch.column("salt"))
            cuts = [0, *(i for i in range(1, len(host)) if host[i] != host[i - 1] or salt[i] != salt[i - 1]), len(host)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (host[a], salt[a]) != key:
                    if held:
                        yield finish(held, names)
                    key, held, names = (host[a], salt[a]), [], []
                piece = batch.slice(a, b - a)
                first = len(piece) - piece.column("name").null_count  # the names come before the pages
                if first:
                    names.append(piece.column("name").slice(0, first).to_numpy())
                if first < len(piece):
                    held.append(piece.slice(first))
        if held:
            yield finish(held, names)

    def finish(held: list[pa.RecordBatch], names: list[np.ndarray]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        streams = t.column("stream").to_pylist()
        whole = list(zip(streams, t.column("text").to_pylist(), strict=True))
        place = {x: k for k, x in enumerate(dict.fromkeys(whole))}  # rows that repeat, and like pages, are one page
        distinct = [x for x, _ in place]
        covered = repeated_tokens(distinct, run_tokens)
        if names:
            covered = [c | o for c, o in zip(covered, named_tokens(distinct, run_tokens, np.concatenate(names)), strict=True)]
        covered = [covered[place[x]] for x in whole]
        text = []
        for i, (marked, suspect, article) in enumerate(zip(*(t.column(c).to_pylist() for c in ("marked", "suspect", "text")), strict=True)):
            blocks = streams[i].split("\n")
            ends = np.cumsum([len(x.encode().split()) for x in blocks])
            hits = np.concatenate(([0], np.cumsum(covered[i])))
            unique = [hits[e] - hits[a] < e - a for a, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            if marked:  # the suspect blocks are the last ones of the stream
                gone = {k for k, own in zip(suspect, unique[len(unique) - len(suspect) :], strict=True) if not own}
                blocks = article.split("\n")
                unique = [k not in gone for k in range(len(blocks))]
            text.append(" ".join([x for x, own in zip(blocks, unique, strict=True) if own] or blocks))
        return pa.RecordBatch.from_arrays([t.column("page_id"), t.column("url"), pa.array(text, pa.string()), pa.array([int(c.sum()) for c in covered], pa.int64())], ["page_id", "url", "text", "n_boilerplate"])

    kinds = {f.name: f.dataType.simpleString() for f in parsed.schema.fields}
    return ordered.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_boilerplate long").withColumnRenamed("page_id", id_column)
