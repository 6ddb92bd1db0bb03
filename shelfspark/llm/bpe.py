"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are compiled, with their ids, into a minimal acyclic automaton: equal suffixes
are one path. Each edge adds a number; their sum along a word is the word's number, by which its ids are found. The
automaton is one file in the shared folder, which workers map into memory. It is asked for each distinct word of a
batch; words that it lacks are merged exactly, by the model's merges. Splitting, look-up and decoding work on whole
Arrow batches.

Cases: null and empty texts have no ids and decode to the empty text; texts with a special token's string, or with a
code point that Python's Unicode lacks, go through the tokenizer itself; repeated rows and columns other than doc_id and text don't matter; an empty table has an empty
lexicon and result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text, _vocab
from shelfspark.llm._chars import SPACE, classes
from shelfspark.llm.packing import contractions

WORDS = 30_000
#: So many distinct words a task counts at once.
TALLY = 100_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- the lexicon ---------------------------------------------------------------------------------------------------


class _State:
    __slots__ = ("edges", "final", "id", "words")

    def __init__(self) -> None:
        self.edges: dict[int, _State] = {}
        self.final, self.id, self.words = False, -1, 0


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct words as a file.

    Words are added in sorted order; what cannot change any more is replaced by an equal state if there is one.
    """
    ordered = sorted(words)
    root, known = _State(), {}
    path: list[tuple[_State, int, _State]] = []
    last = b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (child.final, tuple((b, s.id) for b, s in child.edges.items()))
            if (same := known.get(key)) is not None:
                parent.edges[byte] = same
            else:
                child.id = len(known) + 1
                child.words = child.final + sum(s.words for s in child.edges.values())
                known[key] = child

    for word, _ in ordered:
        common = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        settle(common)
        at = path[-1][2] if path else root
        for byte in word[common:]:
            at.edges[byte] = new = _State()
            path.append((at, byte, new))
            at = new
        at.final, last = True, word
    settle(0)
    root.id = 0
    states = [root, *known.values()]
    edges = []
    for state in states:
        passed = int(state.final)
        for byte in sorted(state.edges):
            child = state.edges[byte]
            edges.append((state.id << 8 | byte, child.id, passed))
            passed += child.words
    size = 1 << max(4, (2 * len(edges)).bit_length())
    key, target, add = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
    for k, t, a in edges:
        at = _slot(k, size)
        while key[at] >= 0:
            at = (at + 1) % size
        key[at], target[at], add[at] = k, t, a
    final = np.zeros(len(states), np.int32)
    final[[s.id for s in states]] = [s.final for s in states]
    start = np.zeros(len(ordered) + 1, np.int32)
    start[1:] = np.cumsum([len(i) for _, i in ordered])
    ids = np.array([x for _, i in ordered for x in i], np.int32)
    longest = max([0, *(len(w) for w, _ in ordered)])
    head = np.array([size, len(final), len(start), len(ids), longest], np.int64)
    return b"".join(x.tobytes() for x in (head, key, target, add, final, start, ids))


def _slot(k, size: int):
    return (k * 0x9E3779B1 >> 7) & (size - 1)


class Lexicon:
    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8)
        size, states, starts, n, self.longest = raw[:40].view(np.int64).tolist()
        at = 40
        views = []
        for count, kind in ((size, np.int64), (size, np.int32), (size, np.int32), (states, np.int32), (starts, np.int32), (n, np.int32)):
            to = at + count * np.dtype(kind).itemsize
            views.append(raw[at:to].view(kind))
            at = to
        self.key, self.target, self.add, self.final, self.start, self.ids = views
        self.size = size

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, or -1."""
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return self.numbers_of(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1])[: len(words)], ends)

    def numbers_of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same of spans of bytes; all words take their next edge together."""
        length = end - start
        out = np.full(len(start), -1, np.int64)
        live = np.flatnonzero(length <= self.longest)
        state, number = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for step in range(self.longest + 1):
            done = length[live] == step
            ok = done & (self.final[state] == 1)
            out[live[ok]] = number[ok]
            live, state, number = live[~done], state[~done], number[~done]
            if not len(live):
                break
            k = state << 8 | data[start[live] + step]
            at = _slot(k, self.size)
            while True:
                wrong = (self.key[at] != k) & (self.key[at] >= 0)
                if not wrong.any():
                    break
                at = np.where(wrong, (at + 1) & (self.size - 1), at)
            found = self.key[at] == k
            live, state, number = live[found], self.target[at[found]].astype(np.int64), number[found] + self.add[at[found]]
        return out


@lru_cache(2)
def _lexicon(uri: str) -> Lexicon:
    where, path = fs.FileSystem.from_uri(uri)
    if isinstance(where, fs.LocalFileSystem):
        return Lexicon(pa.memory_map(path).read_buffer())
    with where.open_input_file(path) as f:
        return Lexicon(f.read_buffer())


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words split at white space with their counts. A tally that grows large is handed on and begun anew."""

    def tally() -> pa.Table:
        return pa.concat_tables(parts).group_by("w").aggregate([("n", "sum")]).select(["w", "n_sum"]).rename_columns(["w", "n"])

    def handed_on(t: pa.Table) -> Iterator[pa.RecordBatch]:
        w = t["w"].combine_chunks().cast(pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([w, t["n"].combine_chunks()], ["w", "n"])

    parts: list[pa.Table] = []
    rows = 0
    for b in _text.pieces(batches, "text", 1 << 19):
        data, off = _text.utf8(b.column("text"))
        s, e, _ = _text.words(data, off)
        number, words, at = _vocab.distinct(data.tobytes(), s, e)
        short = pa.array(np.diff(at) <= _vocab.LONGEST)
        own = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(words.tobytes())])
        parts.append(pa.table({"w": own, "n": pa.array(np.bincount(number, minlength=len(at) - 1))}).filter(short))
        rows += len(parts[-1])
        if rows > 4 * TALLY:
            parts = [tally()]
            rows = len(parts[0])
            if rows > TALLY:
                yield from handed_on(parts.pop())
                rows = 0
    if parts:
        yield from handed_on(tally())


def frequent_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The words, split at white space, that occur most often in all texts: ``most`` of them at most, whole classes of like frequency."""
    counted = docs.select("text").mapInArrow(_counting, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counted = _io.saved(counted.where("n > 1"), "words")
    # how many words have each order of frequency (a bounded table) tells from which on they fit
    order = F.floor(F.log2("n") * 16)
    room, least = most, None
    for r in sorted(counted.groupBy(order.alias("o")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["o"]):
        room -= r["k"]
        if room < 0:
            break
        least = r["o"]
    return [] if least is None else sorted(r["w"] for r in counted.where(order >= least).collect())


def written_lexicon(docs: DataFrame, path: str, most: int = WORDS) -> str:
    """Compile the lexicon for docs and write it to the shared folder; its URI."""
    words: set[bytes] = set()
    for w in frequent_words(docs, most):
        text = f" {w} "
        for a, b in zip(*split(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.array([0, len(text)]))[:2]):
            words.add(text[a:b].encode())
    ordered = sorted(words)
    uri = _io.fresh(docs.sparkSession, "lexicon")
    uri = uri if "://" in uri else "file://" + uri
    where, name = fs.FileSystem.from_uri(uri)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as f:
        f.write(compile_lexicon(zip(ordered, _vocab.Merges(path).encode(ordered))))
    return uri


# ---- encoding and decoding -----------------------------------------------------------------------------------------


def split(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and the rows' first of the words of the byte-level pattern.

    Runs of letters, of numbers and of others take one space before them along; the rest of a run of white space, and
    white space at the end of a row, are words of their own. Every code point is in one word.
    """
    n = len(codes)
    kind = classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= edge[:n]
    space = kind == SPACE
    last = np.zeros(n, bool)  # the last of a run of white space that something follows
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    start |= last
    taken = np.flatnonzero(last & (codes == 32)) + 1
    start[taken] = False
    contractions_in_rows(codes, start, edge)
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n), np.searchsorted(s, off)


def contractions_in_rows(codes: np.ndarray, start: np.ndarray, edge: np.ndarray) -> None:
    """contractions(), of which none may run over the end of a row: rows with an apostrophe go through it one by one."""
    if not (codes == 39).any():
        return
    bounds = np.flatnonzero(edge)
    for i in np.unique(np.searchsorted(bounds, np.flatnonzero(codes == 39), "right") - 1):
        lo, hi = bounds[i], bounds[i + 1]
        own, flags = np.append(codes[lo:hi], [32, 32]).astype(np.uint32), np.append(start[lo:hi], [True, False])
        contractions(own, flags)
        start[lo:hi] = flags[: hi - lo]


@cache
def _decoder(path: str) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The bytes of all tokens one after another with their starts and lengths; each id in decimal with a comma, in 8 bytes."""
    t = _vocab.tokenizer(path)
    letters = _vocab.byte_letters()
    special = {i: x.content.encode() for i, x in t.get_added_tokens_decoder().items()}
    of = {i: bytes(letters[c] for c in x) for x, i in t.get_vocab(with_added_tokens=False).items() if i not in special} | special
    n = max(of, default=-1) + 1
    tokens = [of.get(i, b"") for i in range(n)]
    length = np.array([len(x) for x in tokens], np.int64)
    decimal = np.zeros((n, 8), np.uint8)
    for i in range(n):
        s = f"{i},".encode()
        decimal[i, : len(s)] = np.frombuffer(s, np.uint8)
    return (np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length), decimal.view(np.uint64).ravel()


def encode(texts: list[str | None], path: str, lexicon: Lexicon | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, and the rows' offsets. The lexicon is asked first, for each distinct word."""
    vocabulary = _vocab.vocabulary(path)
    whole = _vocab.beyond(texts, [t.content for t in _vocab.tokenizer(path).get_added_tokens_decoder().values()])
    skip = set(whole)
    plain = ["" if t is None or i in skip else t for i, t in enumerate(texts)]
    text = "".join(plain)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in plain], out=off[1:])
    none = np.zeros(0, np.int64)
    s, e, first = split(codes, off) if len(codes) else (none, none, np.zeros(len(texts) + 1, np.int64))

    def ids_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not lexicon:
            return vocabulary(data, start, end)
        number = lexicon.numbers_of(data, start, end)
        rest, known = np.flatnonzero(number < 0), number >= 0
        own, count = vocabulary(data, start[rest], end[rest])
        # the words' ids lie in the lexicon's, followed by those of the words it lacks
        at, length = lexicon.start[np.maximum(number, 0)].astype(np.int64), np.zeros(len(number), np.int64)
        length[known] = lexicon.start[number[known] + 1] - at[known]
        at[rest], length[rest] = len(lexicon.ids) + np.cumsum(count) - count, count
        return np.concatenate([lexicon.ids.astype(np.uint32), own])[_text.ragged(at, length)], length

    at = _vocab.byte_offsets(codes)
    ids, length = _vocab.encoded(text.encode(), at[s], at[e], ids_of)
    ends = np.zeros(len(s) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    return _vocab.with_whole(ids, ends[first], texts, whole, path)


def decode(ids: np.ndarray, of: np.ndarray, path: str) -> list[bytes]:
    """The text of each row of ids in UTF-8; bytes that are no UTF-8 become replacement characters."""
    data, start, length = _decoder(path)[0]
    n = length[ids]
    flat = data[_text.ragged(start[ids], n)].tobytes()
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    cut = ends[of].tolist()
    return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(cut[:-1], cut[1:])]


def decimals(ids: np.ndarray, of: np.ndarray, path: str) -> list[bytes]:
    """Each row's ids in decimal, joined by commas."""
    wide = _decoder(path)[1][ids].view(np.uint8)
    kept = wide != 0
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(kept.reshape(-1, 8).sum(1), out=ends[1:])
    flat = wide[kept].tobytes()
    cut = ends[of].tolist()
    return [flat[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:])]


def coded(docs: DataFrame, path: str | None = None, most: int = WORDS) -> DataFrame:
    """Digests of each text's ids, and of what they decode to."""
    _io.ship(docs.sparkSession)
    path = path or byte_tokenizer()
    uri = written_lexicon(docs, path, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(uri)
        for b in _text.pieces(batches, "text", 1 << 19):
            ids, of = encode(b.column("text").to_pylist(), path, lexicon)
            digest = lambda rows: [hashlib.sha256(x).hexdigest() for x in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(of)), pa.array(digest(decimals(ids, of, path)), pa.string()), pa.array(digest(decode(ids, of, path)), pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)
