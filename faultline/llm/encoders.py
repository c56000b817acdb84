"""Token ids of whole texts: each distinct word goes to the tokenizer's library once a worker, all else is array work."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: White space in any of the libraries, and the mark that stands for a space inside pieces.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u2581"
MARK = "\u2581"
GAP = re.compile(f"(?<=[^{BLANKS}]) (?=[^{BLANKS}])")
OTHER_BLANKS = BLANKS.replace(" ", "")
ASCII_BLANKS = "".join(b for b in OTHER_BLANKS if b.isascii())


def chunks(text: str) -> list[str]:
    """The text cut at single spaces between other characters than white space; the spaces themselves are left out.

    No token reaches across such a space from the left: byte-level pre-tokens begin with it, and pieces hold the space's
    mark only as their first characters. So chunks can be encoded one by one.
    """
    if text[:1] == " " or text[-1:] == " " or "  " in text:
        return GAP.split(text)
    for b in ASCII_BLANKS if text.isascii() else OTHER_BLANKS:
        if b in text and (b + " " in text or " " + b in text):
            return GAP.split(text)
    return text.split(" ")


class Numbers(dict[str, int]):
    """Numbers of chunks. A chunk that has none yet gets the next one when it is asked for, and is listed in `fresh`."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.next, self.fresh = 0, []

    def __missing__(self, chunk: str) -> int:
        own = self[chunk] = self.next + len(self.fresh)
        self.fresh.append(chunk)
        return own


class WordEncoder:
    """Encodes texts by their chunks. Subclasses call a library for the chunks that aren't known yet.

    sizes: the number of bytes of each id; starts: whether an id's bytes begin with a space; table: the bytes of each id.
    Known chunks are forgotten when there are over `words` of them, or `letters` characters in all.
    """

    table: list[bytes]

    def __init__(self, words: int = 1_000_000, letters: int = 16_000_000):
        self.sizes = np.array([len(b) for b in self.table], np.int64)
        self.starts = np.array([b[:1] == b" " for b in self.table], bool)
        self.words, self.letters = words, letters
        self.forget()

    def forget(self) -> None:
        self.known, self.known_first = Numbers(), Numbers()
        self.n, self.used, self.held = 1, 0, 0  # chunks, their ids, their characters
        self.at, self.count, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode_joined(self, words: list[str]) -> list[int]:
        """The ids of the words, each after a space."""
        raise NotImplementedError

    def encode_alone(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, fresh: list[str], spaced: bool) -> None:
        """Adds chunks, which get the next numbers; they stand after a space or (spaced=False) at the start of a text."""
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        places: list[int] = []
        left: list[int] = []
        for lo in range(0, len(fresh), 200):
            own = fresh[lo : lo + 200]
            where = range(lo, lo + len(own))
            if not spaced:
                left += where
                continue
            joined = " ".join(own)
            if joined.count(" ") >= len(own) or MARK in joined:
                odd = [" " in c or MARK in c for c in own]
                left += [k for k, o in zip(where, odd, strict=True) if o]
                where = [k for k, o in zip(where, odd, strict=True) if not o]
                own = [fresh[k] for k in where]
            if not own:
                continue
            ids = np.array(self.encode_joined(own), np.int32)
            begin = np.flatnonzero(self.starts[ids])
            if len(begin) == len(own) and not begin[0]:
                parts.append(ids)
                counts.append(np.diff(np.append(begin, len(ids))))
                places += where
            else:
                left += where
        if left:
            each = self.encode_alone([" " + fresh[k] for k in left] if spaced else [fresh[k] for k in left])
            parts += [np.array(e, np.int32) for e in each]
            counts.append(np.array([len(e) for e in each], np.int64))
            places += left
        n, ids = np.concatenate(counts), np.concatenate(parts)
        self.at, self.count, self.flat = grown(self.at, self.n + len(n)), grown(self.count, self.n + len(n)), grown(self.flat, self.used + len(ids))
        numbers = self.n + np.array(places)
        self.at[numbers], self.count[numbers] = self.used + np.cumsum(n) - n, n
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used, self.held = self.n + len(n), self.used + len(ids), self.held + sum(map(len, fresh))

    def looked_up(self, words: list[str], known: Numbers, spaced: bool) -> np.ndarray:
        """The number under which each chunk is known; those that aren't yet are learnt."""
        known.next, known.fresh = self.n, []
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.fresh:
            try:
                self.learn(known.fresh, spaced)
            except BaseException:
                self.forget()  # chunks have numbers already
                raise
            known.fresh = []
        return codes

    def encode(self, texts: list[str], space_first: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin. space_first: a space goes before each text."""
        if self.n > self.words or self.held > self.letters:
            self.forget()
        every = [chunks(t) for t in texts]
        n = np.fromiter(map(len, every), np.int64, len(every))
        first = np.cumsum(n) - n
        words = list(chain.from_iterable(every))
        heads: list[str] = []
        if not space_first:
            heads = [e[0] for e in every]
            for i in first.tolist():
                words[i] = ""
        codes = self.looked_up(words, self.known, spaced=True)
        if heads:
            codes[first] = self.looked_up(heads, self.known_first, spaced=False)
        size = self.count[codes]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate((np.zeros(1, np.int64), ends))[np.append(first, len(words))]


class ByteEncoder(WordEncoder):
    """A byte-level BPE file of the `tokenizers` library, without begin and end tokens.

    special: whether special tokens' strings inside a text become those tokens (the library's default) or plain text.
    """

    def __init__(self, path: str, special: bool = True, **limits: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        from faultline.llm.tokens import byte_letters

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        value = {c: b for b, c in enumerate(byte_letters())}
        added = self.library.get_added_tokens_decoder()
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        self.table = [added[i].content.encode() if i in added else bytes(value[c] for c in name) for i, name in enumerate(names)]
        super().__init__(**limits)

    def encode_joined(self, words: list[str]) -> list[int]:
        return self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids

    def encode_alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class PieceEncoder(WordEncoder):
    """A BPE model of `sentencepiece` that puts a space before a text, keeps white space and parts words at spaces.

    Only for space_first=True, as the library itself adds the space.
    """

    def __init__(self, path: str, **limits: int):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        own = self.library
        names = [own.id_to_piece(i) for i in range(own.vocab_size())]
        if any(MARK in p.lstrip(MARK) for p in names) or own.encode("") or own.encode("a  b") == own.encode("a b"):
            raise ValueError("pieces reach across spaces, or white space is not kept")
        self.table = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) or own.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        super().__init__(**limits)

    def encode_joined(self, words: list[str]) -> list[int]:
        return self.library.encode(" ".join(words), num_threads=1)

    def encode_alone(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1)


def grown(held: np.ndarray, size: int) -> np.ndarray:
    """held, with room for size numbers: at least doubled, so that each is copied a few times at most."""
    if size <= len(held):
        return held
    out = np.zeros(max(size, 2 * len(held)), held.dtype)
    out[: len(held)] = held
    return out


@lru_cache(4)
def byte_encoder(path: str, special: bool = True) -> ByteEncoder:
    return ByteEncoder(path, special)


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
