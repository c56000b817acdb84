"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from faultline.llm.textscan import slices

NO_RANK = np.iinfo(np.int64).max


class RankMerger:
    """Byte-pair encoding with word ends, over ragged arrays of symbols.

    tokenizer: the path of a tokenizer file of the `tokenizers` library with a BPE model, end-of-word suffix, byte-level
    alphabet, NFC and lower-casing normaliser. Only counts are kept.
    """

    def __init__(self, tokenizer: str, cache_words: int = 400_000):
        import regex

        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = len(vocab) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        slots = self.slot(self.keys)
        self.table = np.full(1 << 21, -1, np.int64)
        self.table[slots] = np.arange(len(slots))
        self.table[slots[np.bincount(slots, minlength=1 << 21)[slots] > 1]] = -2
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        letters = byte_letters()
        self.symbol = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        pieces = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pieces.replace("\\s", "\\p{White_Space}"))
        self.gaps = regex.compile("\\p{White_Space}+")
        self.separators = regex.compile("[\x1c-\x1f]").search
        self.cache: dict[str, int] = {"": 0}
        self.known: dict[str, int] = {}
        self.cache_words = cache_words

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """One look at a hash table; keys whose slot two pairs want are searched for."""
        key = left * self.base + right
        at = self.table[self.slot(key)]
        shared = np.flatnonzero(at == -2)
        if len(shared):
            at[shared] = np.minimum(np.searchsorted(self.keys, key[shared]), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count_words(self, pre_tokens: list[str]) -> np.ndarray:
        """The symbols that survive in each pre-token when each turn applies its lowest-rank pair everywhere in it."""
        raw = [w.encode() for w in pre_tokens]
        lens = np.array([len(w) for w in raw], np.int64)
        counts = np.ones(len(raw), np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.symbol[data]
        ends = np.cumsum(lens)
        ids[ends - 1] = self.last[data[ends - 1]]
        seq = np.repeat(np.arange(len(raw)), lens)
        while len(ids):  # a turn
            rank = np.full(len(ids), NO_RANK)  # of the pair that starts here
            same = np.flatnonzero(seq[1:] == seq[:-1])
            rank[same] = self.ranks_of(ids[same], ids[same + 1])
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            done = least == NO_RANK
            counts[seq[first[done]]] = size[done]
            least = np.repeat(least, size)
            hit = (rank == least) & (least != NO_RANK)
            at = np.flatnonzero(hit)
            if len(at):  # of pairs that overlap, as in aaa, every second one from the left
                run = np.flatnonzero(np.concatenate(([True], np.diff(at) != 1)))
                place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[place % 2 == 0]
            ids[at] = self.made[rank[at]]
            stay = least != NO_RANK
            stay[at + 1] = False
            ids, seq = ids[stay], seq[stay]
        return counts

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """The tokens of strings without white space."""
        from unicodedata import normalize

        find, known = self.pieces.findall, self.known
        found = [find(normalize("NFC", c).replace("Σ", "σ").lower()) for c in chunks]
        if len(known) > self.cache_words:
            known.clear()
        fresh = list(set(chain.from_iterable(found)).difference(known))
        known.update(zip(fresh, self.count_words(fresh).tolist(), strict=True))
        each = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64)
        sums = np.concatenate(([0], np.cumsum(each)))
        ends = np.cumsum([len(f) for f in found], dtype=np.int64)
        return np.diff(sums[np.concatenate(([0], ends))]).tolist()

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Pre-tokens never hold white space, so texts are counted by white-space chunk, each distinct one once."""
        totals, docs, found = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            if self.special and "<|" in text:
                parts = self.special.split(text)
                totals[i] = len(parts) - 1
                text = " ".join(parts)
            # str.split() also parts at U+001C to U+001F, which are no white space in Unicode.
            chunks = self.gaps.split(text) if self.separators(text) else text.split()
            docs.append(len(chunks))
            found.append(chunks)
        cache = self.cache
        if len(cache) > self.cache_words:
            cache.clear()
            cache[""] = 0
        fresh = list(set(chain.from_iterable(found)).difference(cache))
        for k in range(0, len(fresh), 50_000):
            block = fresh[k : k + 50_000]
            cache.update(zip(block, self.count_chunks(block), strict=True))
        each = np.fromiter(map(cache.__getitem__, chain.from_iterable(found)), np.int64, sum(docs))
        sums = np.concatenate(([0], np.cumsum(each)))
        ends = np.cumsum(docs, dtype=np.int64)
        return totals + sums[ends] - sums[ends - np.array(docs, np.int64)]


def byte_letters() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(2)
def merger(tokenizer: str) -> RankMerger:
    return RankMerger(tokenizer)


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts the tokens of every whole text: (id, n_bytes long, n_tokens long).

    tokenizer: the file's path, the same on every executor (it comes with an installed package); each Python worker
    reads it once. A narrow job: no shuffle. Null texts count as empty (0 bytes, 0 tokens); null and repeated ids pass
    through; other columns are not read; an empty table gives no rows. Very long texts are cut nowhere; one text is in
    memory at a time beside a slice of 2 MB.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(tokenizer)
        for part in slices(batches, "text", 2 << 20):
            texts = part.column("text").fill_null("")
            n = own.count_texts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    picked = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)
