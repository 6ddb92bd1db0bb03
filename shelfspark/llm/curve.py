"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's vector counts its words, hashed into FEATURES places with a sign each, damped by the logarithm and scaled
to length one. It is projected to DIMENSIONS values, whose cells have a place on a Hilbert curve. The projection is along
the directions in which vectors differ most, which are fitted on a bounded sample: the SAMPLE distinct texts of least
hash. It decides who are neighbours, and nothing else: every document is keyed by it and packed. Documents are range-sorted by that key; ties, such as copies, are told apart by a hash of id and text, so that a group of
copies of any size is dealt to many tasks. Each task then packs its stretch of the curve, document after document:
sequences of LENGTH ids without a gap, and what is left over at the end of a task in sequences whose lengths are powers
of two, so that nothing is padded. Only texts and keys are shuffled; they are tokenised where they are packed.

Cases: null and empty texts are the end id alone and lie at the curve's start; so do texts without a word, with their
ids; repeated rows are documents of their own; documents without a doc_id are packed too; a long text goes over as many
sequences as it takes; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text
from shelfspark.llm.bpe import byte_tokenizer, encode

LENGTH, END = 1024, 0
FEATURES, DIMENSIONS, BITS = 256, 4, 15
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one task have numbers below this.
PER_TASK = 1 << 40


#: Texts that the projection is fitted on.
SAMPLE = 2000


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The middle of vectors (rows), and DIMENSIONS orthonormal directions in which they differ most.

    Where they differ in fewer, fixed random directions follow.
    """
    middle = v.mean(0) if len(v) else np.zeros(FEATURES)
    _, size, along = np.linalg.svd(v - middle, full_matrices=False)
    more = np.random.default_rng(7).standard_normal((DIMENSIONS, FEATURES))
    q, r = np.linalg.qr(np.vstack([along[size > 1e-9], more]).T)
    return middle, q[:, :DIMENSIONS] * np.sign(np.diag(r))[:DIMENSIONS]


def vectors(col: pa.Array) -> np.ndarray:
    """The rows' hashed word vectors, of length one (or zero without a word)."""
    data, off = _text.utf8(col)
    data = _text.lower(data)
    s, e, first = _text.words(data, off)
    h = _text.spans(data, s, e)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    place = row * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64)
    sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    v = np.bincount(place, sign, (len(off) - 1) * FEATURES).reshape(-1, FEATURES)
    v = np.sign(v) * np.log1p(np.abs(v))
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(length > 0, length, 1)


def cells(v: np.ndarray, middle: np.ndarray, across: np.ndarray) -> np.ndarray:
    """(rows, DIMENSIONS) cells of projections. Values crowd around zero, where a tangent hyperbolic makes cells finer."""
    spread = np.tanh(3 * ((v - middle) @ across))
    return np.minimum(((spread + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places of cells (rows, dimensions) on the Hilbert curve, below 2 ** (bits * dimensions).

    From the highest bit down, what lies in each half is turned or mirrored as the curve passes it; the bits that
    remain, taken across dimensions, are the place in Gray code.
    """
    x = x.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            upper = (x[i] >> b & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def keys(col: pa.Array, middle: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Each text's place on the curve, from 1; 0 without a word."""
    v = vectors(col)
    return np.where(v.any(1), hilbert(cells(v, middle, across)) + 1, 0)


def _keyed(middle: np.ndarray, across: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(keys(b.column("text"), middle, across))], ["doc_id", "text", "place"])

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _text.pieces(batches, "text"):
        v = vectors(b.column("text")).astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([x.tobytes() for x in v], pa.binary())], ["h", "v"])


def fitted(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """directions() of the vectors of ``sample`` distinct texts, those of least hash."""
    rows = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    place = F.col("h").bitwiseAND((1 << 52) - 1)
    texts = rows.select(F.approx_count_distinct("h")).first()[0]
    # somewhat more than wanted, by an estimate of the distinct texts
    few = rows.where(place < int(min(1.0, 2 * sample / max(1, texts)) * (1 << 52))).groupBy("h").agg(F.min("text").alias("text"))
    found = few.mapInArrow(_vectors, "h long, v binary").orderBy(F.col("h").bitwiseAND((1 << 52) - 1), "h").limit(sample).collect()
    return directions(np.array([np.frombuffer(r["v"], np.float32) for r in found], np.float64).reshape(-1, FEATURES))


def powers(n: int) -> list[int]:
    """n as powers of two, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Stream:
    """Ids of one document after another, of which pieces of sequences are taken off the front."""

    def __init__(self, length: int, first: int):
        self.length, self.next = length, first
        self.ids = np.zeros(0, np.uint32)
        #: Of each document in ids: how many of its ids are there, and how many went before.
        self.here, self.before, self.total = (np.zeros(0, np.int64) for _ in range(3))
        self.docs = pa.array([], pa.int64())

    def put(self, docs: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.here, self.total = np.concatenate([self.here, count]), np.concatenate([self.total, count])
        self.before = np.concatenate([self.before, np.zeros(len(count), np.int64)])
        self.docs = pa.concat_arrays([self.docs, docs])

    def full(self) -> pa.RecordBatch:
        """What fills sequences; less than one remains."""
        return self.take(np.full(len(self.ids) // self.length, self.length, np.int64))

    def rest(self) -> pa.RecordBatch:
        """What remains, in lengths that are powers of two."""
        return self.take(np.array(powers(len(self.ids)), np.int64))

    def take(self, sizes: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        to = int(ends[-1]) if len(ends) else 0
        doc_ends = np.cumsum(self.here)
        doc_starts = doc_ends - self.here
        # a piece starts where a document or a sequence does
        starts = np.union1d(doc_starts[doc_starts < to], ends[:-1])
        stops = np.append(starts[1:], to)[: len(starts)]
        doc = np.searchsorted(doc_ends, starts, "right")
        sequence = np.searchsorted(ends, starts, "right")
        raw = self.ids[:to].astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
        out = pa.RecordBatch.from_arrays(
            [
                self.docs.take(pa.array(doc)), pa.array(starts - doc_starts[doc] + self.before[doc]), pa.array(stops - starts), pa.array(crc, pa.int64()),
                pa.array(self.total[doc]), pa.array(self.next + sequence), pa.array(starts - (ends - sizes)[sequence]),
            ],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.next += len(sizes)
        gone = int(np.searchsorted(doc_ends, to, "right"))
        self.ids, self.docs, self.total = self.ids[to:], self.docs.slice(gone), self.total[gone:]
        here, before = self.here[gone:].copy(), self.before[gone:].copy()
        if len(here):
            taken = to - doc_starts[gone]
            here[0] -= taken
            before[0] += taken
        self.here, self.before = here, before
        return out


def _packing(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = Stream(length, TaskContext.get().partitionId() * PER_TASK)
        for b in _text.pieces(batches, "text", 1 << 18):
            ids, of = encode(b.column("text").to_pylist(), path)
            stream.put(b.column("doc_id"), np.insert(ids.astype(np.uint32), of[1:], end), np.diff(of) + 1)
            yield stream.full()
        yield stream.rest()

    return run


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece of each document, with its sequence and place. length: a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError(f"sequences have a power of two as length, not {length}")
    _io.ship(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_keyed(*fitted(docs)), "doc_id long, text string, place long")
    # rows that are equal throughout are told apart by their number, so that they too are dealt to many tasks
    order = ["place", "tie", "row"]
    keyed = keyed.withColumns({"tie": F.xxhash64("doc_id", "text"), "row": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(_io.parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "text").mapInArrow(_packing(path or byte_tokenizer(), length, end), PIECES)
