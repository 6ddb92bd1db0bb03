"""Token ids of whole columns of words: each distinct word of a batch is asked for once, and known by its own bytes."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

from shelfspark.llm._chars import UNASSIGNED, classes
from shelfspark.llm._text import ragged, spans

#: Words that a worker remembers, and the longest of them in bytes: its memory is bounded by both.
REMEMBERED, LONGEST = 400_000, 64


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_letters() -> dict[str, int]:
    """The byte of each letter in which byte-level vocabularies are written: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Ids of single words by the merges of the tokenizer's own model."""

    def __init__(self, path: str):
        self.model = tokenizer(path).model
        self.letters = {b: c for c, b in byte_letters().items()}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return self.spans(b"".join(words), np.append(0, ends[:-1])[: len(words)], ends)

    def spans(self, data: bytes, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        """The same of spans of bytes: one letter stands for each byte."""
        shown, merged = data.decode("latin-1").translate(self.letters), self.model.tokenize
        return [[t.id for t in merged(shown[a:b])] if b > a else [] for a, b in zip(start.tolist(), end.tolist())]


class Vocabulary:
    """What is known of words so far: their ids, found by a hash and confirmed by their bytes.

    Open addressing over numpy arrays, which are looked up for many words at once. It forgets all beyond ``most`` words.
    """

    def __init__(self, merges: Merges, most: int = REMEMBERED):
        self.merges, self.most = merges, most
        self.forget()

    def forget(self) -> None:
        self.size, self.n = 1 << 15, 0
        self.keys, self.at = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
        self.ids, self.text = _Pool(np.uint32), _Pool(np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the word of each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        open_, slot = np.arange(len(h)), (h & np.uint64(self.size - 1)).astype(np.int64)
        while len(open_):
            got = self.keys[slot]
            hit = got == h[open_]
            out[open_[hit]] = self.at[slot[hit]]
            more = ~hit & (got != 0)
            open_, slot = open_[more], (slot[more] + 1) & (self.size - 1)
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = (h & np.uint64(self.size - 1)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.at[slot[won]] = h[won], number[won]
            rest = np.ones(len(h), bool)
            rest[won] = False
            h, number, slot = h[rest], number[rest], slot[rest]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & (self.size - 1), slot)

    def _add(self, h: np.ndarray, text: np.ndarray, width: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Words by their hashes, new and distinct: their bytes and ids one after another, with how many each has."""
        first = self.n
        self.n += len(h)
        self.ids.extend(ids, length)
        self.text.extend(text, width)
        if 2 * self.n > self.size:
            full = self.keys != 0
            keys, at = self.keys[full], self.at[full]
            while 2 * self.n > self.size:
                self.size *= 2
            self.keys, self.at = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
            self._put(keys, at)
        self._put(h, np.arange(first, self.n, dtype=np.int32))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, spans of ``data`` in their order, one after another; and how many each has."""
        if self.n > self.most:
            self.forget()
        h = spans(data, start, end)
        h[h == 0] = 1
        number = self.find(h)
        known = np.flatnonzero(number >= 0)
        known = known[self.text.same(number[known], data, start[known], end[known])]
        new = np.ones(len(h), bool)
        new[known] = False
        new = np.flatnonzero(new)
        found = self.merges.spans(data.tobytes(), start[new], end[new]) if len(new) else []
        flat, length = self.ids.take(number[known])
        own = np.fromiter((x for ids in found for x in ids), np.uint32)
        n, at = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        n[known], at[known] = length, np.cumsum(length) - length
        n[new] = [len(x) for x in found]
        at[new] = len(flat) + np.cumsum(n[new]) - n[new]
        every, width = np.concatenate([flat, own]), end - start
        # long words, and those whose hash another word has, are not remembered
        _, one = np.unique(h[new], return_index=True)
        keep = new[one]
        keep = keep[(number[keep] < 0) & (width[keep] <= LONGEST)]
        self._add(h[keep], data[ragged(start[keep], width[keep])], width[keep], every[ragged(at[keep], n[keep])], n[keep])
        return every[ragged(at, n)], n


class _Pool:
    """Rows of values one after another, in an array that doubles."""

    def __init__(self, kind: type):
        self.values, self.first, self.n, self.used = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0, 0

    def extend(self, values: np.ndarray, length: np.ndarray) -> None:
        while self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while self.n + len(length) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.values[self.used : self.used + len(values)] = values
        self.first[self.n + 1 : self.n + len(length) + 1] = self.used + np.cumsum(length)
        self.n, self.used = self.n + len(length), self.used + len(values)

    def take(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.first[row + 1] - self.first[row]
        return self.values[ragged(self.first[row], n)], n

    def same(self, row: np.ndarray, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each row holds just the values of its span."""
        n = self.first[row + 1] - self.first[row]
        ok = n == end - start
        at = np.flatnonzero(ok)
        wrong = self.values[ragged(self.first[row[at]], n[at])] != values[ragged(start[at], n[at])]
        sums = np.zeros(len(wrong) + 1, np.int64)
        np.cumsum(wrong, out=sums[1:])
        ends = np.cumsum(n[at])
        ok[at] = sums[ends] == sums[ends - n[at]]
        return ok


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(Merges(path))


def distinct(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word, a span of ``data`` that begins where the one before it ends or later; the distinct words
    one after another, and where each begins (and the end)."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.stack([start, end], 1).ravel().astype(np.int64)
    # what is between words is an element of its own, between each two of them
    all_ = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    coded = all_.dictionary_encode()
    number = coded.indices.to_numpy()[0::2]
    used = np.zeros(len(coded.dictionary), bool)
    used[number] = True
    words = coded.dictionary.filter(pa.array(used))
    _, offs, raw = words.buffers()
    off = np.frombuffer(offs, np.int64, len(words) + 1, words.offset * 8)
    return (np.cumsum(used) - 1)[number], np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8), off - off[0]


def encoded(data: bytes, start: np.ndarray, end: np.ndarray, ids_of: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids one after another, and the number of ids of each. ids_of: the same of distinct words."""
    number, words, off = distinct(data, start, end)
    flat, length = ids_of(words, off[:-1], off[1:])
    first, n = (np.cumsum(length) - length)[number], length[number]
    return flat[ragged(first, n)], n


def byte_offsets(codes: np.ndarray) -> np.ndarray:
    """Where each code point (and the end) is in the text's UTF-8."""
    out = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), out=out[1:])
    return out


def beyond(texts: list[str | None], special: list[str]) -> list[int]:
    """The texts that only the tokenizer itself can split: with a special token's string or an unassigned code point."""

    def unassigned(t: str) -> bool:
        return bool((classes()[np.frombuffer(t.encode("utf-32-le"), np.uint32)] == UNASSIGNED).any())

    odd = unassigned("".join(t for t in texts if t and not t.isascii()))
    return [i for i, t in enumerate(texts) if t and (any(x in t for x in special) or (odd and unassigned(t)))]


def with_whole(ids: np.ndarray, of: np.ndarray, texts: list[str | None], whole: list[int], path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids and the rows' offsets, with the rows ``whole`` encoded by the tokenizer."""
    if not whole:
        return ids, of
    rows = [ids[a:b] for a, b in zip(of[:-1].tolist(), of[1:].tolist())]
    t = tokenizer(path)
    for i in whole:
        rows[i] = np.array(t.encode(texts[i], add_special_tokens=False).ids, np.uint32)
    of = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=of[1:])
    return np.concatenate(rows), of
