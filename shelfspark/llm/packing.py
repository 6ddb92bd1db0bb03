"""Best-fit packing of tokenised documents into fixed sequences, by bin completion.

A document is its token ids and one end id. Only a document longer than a sequence is cut, into full pieces and a
rest. What is packed is the histogram of piece lengths (as many rows as a sequence has tokens, at most), so that the
search does not grow with the corpus: around the largest open length, branch and bound enumerates undominated
fillings of the space beside it, prunes those whose waste cannot beat the incumbent (the best-fit filling first), and
lays as many equal sequences at once as the counts allow. Each filling wastes as little as the pieces left allow. Pieces get their places by their rank within their length,
counted in salted groups, so that no length's pieces meet in one task.

Cases: null and empty texts are the end id alone; repeated rows are documents of their own; documents whose doc_id is
null are packed too; any number of short texts may share a sequence; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text, _vocab
from shelfspark.llm._chars import LETTER, NUMBER, SPACE, classes

LENGTH, END = 4096, 1
#: Bytes of text that are split at once.
TEXT_BYTES = 1 << 18
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def contractions(codes: np.ndarray, start: np.ndarray) -> None:
    """Let tokens 's 't 'm 'd 're 've 'll, where a token starts with the apostrophe, end after their letters."""
    at = np.flatnonzero((codes[:-2] == 39) & start[:-2])
    if not len(at):
        return
    a, b = codes[at + 1], codes[at + 2]
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    kinds = classes()
    start[at[one | two] + 1] = False
    i = at[one] + 2
    start[i[kinds[codes[i]] == LETTER]] = True
    i = at[two] + 3
    i = i[i < len(codes)]
    start[i[kinds[codes[i]] == LETTER]] = True


def words_of(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and the rows' first of the words of the word tokenizer: letters, single numbers, runs of others.

    Two code points of white space stand between rows and at the end (see _flat), which contractions() may read.
    """
    kind = classes()[codes]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    contractions(codes, start)
    s = np.flatnonzero(start)
    # a word ends where the next starts or white space does
    space = np.flatnonzero(kind == SPACE)
    e = np.minimum(np.append(s[1:], len(codes)), np.append(space, len(codes))[np.searchsorted(space, s)])
    return s, e, np.searchsorted(s, off)


def _normal(t: str) -> str:
    t = unicodedata.normalize("NFC", t)
    return "".join(map(str.lower, t)) if "Σ" in t else t.lower()


def tokenised(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after another, and the rows' offsets.

    Words are split here, each distinct one of a batch is merged by the tokenizer's model. Texts with a special token's
    string, or with a code point that Python's Unicode lacks, go through the tokenizer itself.
    """
    whole = _vocab.beyond(texts, [t.content for t in _vocab.tokenizer(path).get_added_tokens_decoder().values()])
    skip = set(whole)
    normal = ["" if t is None or i in skip else t.lower() if t.isascii() else _normal(t) for i, t in enumerate(texts)]
    text = "  ".join(normal) + "  "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in normal], out=off[1:])
    s, e, first = words_of(codes, off)
    at = _vocab.byte_offsets(codes)
    ids, length = _vocab.encoded(text.encode(), at[s], at[e], _vocab.vocabulary(path))
    ends = np.zeros(len(s) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    return _vocab.with_whole(ids, ends[first], texts, whole, path)


def cut(path: str, length: int, end: int):
    """Tokenise and cut; ``row`` numbers the documents of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for b in _text.pieces(batches, "text", TEXT_BYTES):
            ids, of = tokenised(b.column("text").to_pylist(), path)
            out: list[tuple] = []
            for doc, lo, hi in zip(b.column("doc_id").to_pylist(), of[:-1].tolist(), of[1:].tolist()):
                own = np.append(ids[lo:hi], np.uint32(end)).astype("<u4")
                for k, at in enumerate(range(0, len(own), length)):
                    x = own[at : at + length]
                    out.append((doc, row, k, at, len(x), zlib.crc32(x.tobytes())))
                row += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
            )

    return run


# ---- bin completion over a histogram -------------------------------------------------------------------------------


def reachable(counts: dict[int, int], space: int) -> list[int]:
    """By length: the sums up to ``space`` of pieces of at most that length, as the bits of a number."""
    all_ = (1 << (space + 1)) - 1
    out, bits = [1] * (space + 1), 1
    for size in range(1, space + 1):
        left, step = min(counts.get(size, 0), space // size), 1
        while left > 0:
            take = min(step, left)
            bits |= (bits << (take * size)) & all_
            left, step = left - take, 2 * step
        out[size] = bits
    return out


def fillings(lengths: list[int], counts: dict[int, int], space: int, budget: int = 400, sums: list[int] | None = None) -> list[int]:
    """A filling of ``space`` with the least waste there is: lengths in descending order, none used too often.

    lengths: those with a count, ascending. The incumbent is best fit: always the largest length that fits, as often as it
    fits. Branch and bound goes on from it, a length and how often it is taken at each level (so that there are less than a
    hundred levels, however short the pieces are), larger lengths and numbers first: a branch ends when the space is filled,
    or when the largest sum that the remaining lengths reach in what is left (``sums``, see reachable(), of these counts or
    larger ones) cannot waste less than the incumbent does. A filling into which another length would fit wastes more than
    one with it, and is not kept.

    Sums of larger counts than these are bounds that may not be met. So when ``budget`` nodes are visited, the sums of
    just these counts are made, and completed() follows them to the least waste: the budget decides about time alone.
    """
    best: list[tuple[int, int]] | None = None
    least = space + 1
    nodes = 0
    sums = sums or reachable(counts, space)

    def waste(free: int, top: int) -> int:
        return free + 1 - (sums[min(free, top)] & ((2 << free) - 1)).bit_length()

    def search(free: int, below: int, used: list[tuple[int, int]]) -> bool:
        """Fill with lengths of indices under ``below``; whether to stop."""
        nonlocal best, least, nodes
        i = bisect_right(lengths, free, 0, below) - 1
        if i < 0 and free < least:
            best, least = list(used), free
        while i >= 0:
            size = lengths[i]
            for times in range(min(counts[size], free // size), 0, -1):
                # the first way down is best fit, whatever the bound says
                if best is not None and waste(free, size) >= least:
                    return False
                nodes += 1
                if best is None or waste(free - times * size, size - 1) < least:
                    used.append((size, times))
                    if search(free - times * size, i, used):
                        return True
                    used.pop()
                if nodes > budget and best is not None:
                    return True
            i -= 1
        return least == 0

    search(space, len(lengths), [])
    found = [size for size, times in best or [] for _ in range(times)]
    if nodes > budget and least > 0:
        other = completed(lengths, counts, space)
        return other if sum(other) > sum(found) else found
    return found


def completed(lengths: list[int], counts: dict[int, int], space: int) -> list[int]:
    """The filling with the least waste that holds most of the largest lengths, by exact bounds.

    Each step takes a length as often as the sums of the smaller ones allow the best total still to be reached, so that
    no branch fails.
    """
    sums = reachable(counts, space)
    free, out = sums[space].bit_length() - 1, []
    for size in reversed(lengths[: bisect_right(lengths, space)]):
        times = next(m for m in range(min(counts[size], free // size), -1, -1) if sums[size - 1] >> (free - m * size) & 1)
        out += [size] * times
        free -= times * size
    return out


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Sequences as (piece lengths, how many times), for all pieces of the histogram.

    Around the largest length left, a filling of the rest is searched and laid as often as its scarcest length allows,
    so that the number of searches is bounded by the lengths, not by the pieces.
    """
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts)
    sums = reachable(counts, length)
    out: list[tuple[list[int], int]] = []
    while lengths:
        top = lengths[-1]
        counts[top] -= 1
        fill = fillings([x for x in lengths if counts[x]] if not counts[top] else lengths, counts, length - top, sums=sums)
        counts[top] += 1
        sequence = [top, *fill]
        need = Counter(sequence)
        times = min(counts[x] // k for x, k in need.items())
        out.append((sequence, times))
        for x, k in need.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
                lengths.remove(x)
    return out


def slots(sequences: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each slot, its first sequence and the offset in it."""
    rank: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for sequence, times in sequences:
        at = 0
        for x in sequence:
            found.setdefault(x, []).append((rank.get(x, 0), base, at))
            rank[x] = rank.get(x, 0) + times
            at += x
        base += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in found.items()}


def _placer(place: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                first, base, at = place[int(size[own[0]])]
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = base[i] + rank[own] - first[i], at[i]
            keep = [x for x in b.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in keep], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece of each document, with its sequence and place."""
    _io.ship(docs.sparkSession)
    p = _io.saved(
        docs.select("doc_id", "text")
        .mapInArrow(cut(path or word_tokenizer(), length, end), PIECES)
        .withColumn("task", F.spark_partition_id())
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "task", "row", "piece"), F.lit(2 * _io.parts(docs.sparkSession))).cast("int")),
        "pieces",
    )
    histogram = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count("*").alias("n")).collect()}
    place = slots(plan(histogram, length))
    # how many pieces of each length precede those of a salt: a row for each length and salt, whatever the corpus
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "task", "row", "piece")
    by_salt = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = by_salt.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = p.withColumn("own", F.row_number().over(own)).join(before, ["length", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return out.mapInArrow(_placer(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
