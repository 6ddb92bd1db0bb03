"""Language identification with language-bitmask n-gram filters.

A filter is a bit-sliced Bloom filter: each of its positions holds one bit for each language, so that the AND of an
n-gram's positions is the set of all languages that (may) contain it. For each document the bits are counted by
language, the counts are corrected for the filter's false positives, and the highest count decides.

Learning. The filters are fitted on a bounded sample of labelled rows: of each language's distinct texts the ``sample``
of least hash, as long as they are ``SAMPLE_BYTES`` at most together (and an equal share of ``ALL_BYTES`` for all languages); no single text above ``LONGEST_BYTES`` is learned
from. The sample follows from the texts alone, so that null, equal or repeated doc_ids don't matter, and copies count
once. From it come the most frequent n-grams, at most ``grams`` for each language. Rows with a null language or text are
not learned from. A filter has 2 ** 20 positions at most, since three of them are taken from one 64-bit hash.

Cases: null texts and texts without a letter give ``und`` and score 0; texts whose letters are in no filter give the
language with the most learned documents and score 0; ties go to the language that comes first by name. With no
learned language every result is ``und``. Repeated rows and extra columns don't matter; lang, source and doc_id are
not read for a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text
from shelfspark.llm._chars import code_points, lowered

N, HASHES, UND = 4, 3, "und"
GRAMS, SAMPLE = 6000, 800
SAMPLE_BYTES, LONGEST_BYTES = 16 << 20, 1 << 20
#: Bytes of the sample over all languages: where there are many, each has an equal share of it.
ALL_BYTES = 128 << 20


@dataclass
class Filters:
    langs: list[str]
    #: Planes of 64 languages by positions.
    bits: np.ndarray
    #: The rate of false positives by language.
    false: np.ndarray
    default: int = 0

    def masks(self, plane: int, h: np.ndarray) -> np.ndarray:
        table = self.bits[plane]
        size = np.uint64(len(table) - 1)
        m = table[(h & size).astype(np.int64)]
        for i in range(1, HASHES):
            m &= table[((h >> np.uint64(20 * i)) & size).astype(np.int64)]
        return m


def grams(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of letters in lower case, where one space stands for what is between words; their rows' offsets.

    Only n-grams that hold two letters at least count, so that there is one at least for each word of two letters.
    """
    low = lowered()[codes]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    gap = low == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first of each gap
    keep[0:1] = True
    keep |= edge[:-1]
    # each row begins with a space and, through the next row's, ends with one
    row_at = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=row_at[1:])
    of = row_at[off]
    kept = low[keep]
    n_rows = len(off) - 1
    text = np.zeros(len(kept) + n_rows + 1, np.uint64)
    text[np.arange(len(kept)) + np.repeat(np.arange(n_rows), np.diff(of)) + 1] = kept
    of = of + np.arange(n_rows + 1)  # a space at of[i]
    m = len(text) - N + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    h = np.zeros(m, np.uint64)
    letters = np.zeros(m, np.uint8)
    for j in range(N):
        h = h * np.uint64(0x100000001B3) + text[j : j + m] + np.uint64(1)
        letters += text[j : j + m] != 0
    ok = letters >= 2
    inner = np.zeros(m, bool)
    inner[: max(0, of[-1] - N + 2)] = True
    for b in range(1, N - 1):  # n-grams that run over a row's end
        at = of[1:] - b
        inner[at[(at >= 0) & (at < m)]] = False
    ok &= inner
    h = _text.mix(h[ok])
    before = np.zeros(m + 1, np.int64)
    np.cumsum(ok, out=before[1:])
    return h, before[np.minimum(of, m)]


def fit(sample: dict[str, list[str]], counts: dict[str, int], size: int | None = None, most: int = GRAMS) -> Filters:
    langs = sorted(sample)
    found = []
    for lang in langs:
        seen, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for at in range(0, len(sample[lang]), 200):
            data, off = _text.utf8(pa.array(sample[lang][at : at + 200], pa.large_string()))
            h, n = np.unique(grams(*code_points(data, off))[0], return_counts=True)
            seen, of = np.unique(np.concatenate([seen, h]), return_inverse=True)
            times = np.bincount(of, np.concatenate([times, n]), len(seen)).astype(np.int64)
        found.append(seen[np.lexsort((seen, -times))][:most])
    _text.release()
    size = size or 1 << max(14, int(np.ceil(np.log2(HASHES * 8 * max([1, *map(len, found)])))))
    size = min(size, 1 << 20)
    bits = np.zeros(((len(langs) + 63) // 64, size), np.uint64)
    false = np.zeros(len(langs))
    for i, h in enumerate(found):
        for j in range(HASHES):
            np.bitwise_or.at(bits[i // 64], ((h >> np.uint64(20 * j)) & np.uint64(size - 1)).astype(np.int64), np.uint64(1 << (i % 64)))
        false[i] = (((bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES
    return Filters(langs, bits, false, max(range(len(langs)), key=lambda i: (counts.get(langs[i], 0), -i)) if langs else 0)


def predict(col: pa.Array, f: Filters) -> tuple[list[str], np.ndarray]:
    data, off = _text.utf8(col)
    n = len(off) - 1
    codes, at = code_points(data, off)
    seen = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lowered()[codes] != 0, out=seen[1:])
    letters = seen[at[1:]] > seen[at[:-1]]
    if not f.langs:
        return [UND] * n, np.zeros(n)
    h, of = grams(codes, at)
    total = np.diff(of)
    share = np.zeros((n, len(f.langs)))
    full = np.flatnonzero(total)
    if len(full):
        for plane in range(len(f.bits)):
            m = f.masks(plane, h)
            for i in range(64 * plane, min(len(f.langs), 64 * plane + 64)):
                hits = np.add.reduceat((m >> np.uint64(i % 64)).astype(np.uint8) & 1, of[:-1][full], dtype=np.int64)
                share[full, i] = np.clip((hits / total[full] - f.false[i]) / (1 - f.false[i]), 0, 1)
    best = share.argmax(1)
    score = share[np.arange(n), best]
    best[score == 0] = f.default
    return [f.langs[b] if ok else UND for b, ok in zip(best, letters)], np.where(letters, score, 0.0)


def sampled(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[dict[str, list[str]], dict[str, int]]:
    """The ``sample`` distinct texts of least hash of each language, and the number of rows by language."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").withColumn("h", F.xxhash64("text"))
    narrow = _io.saved(rows.select("lang", "h", F.octet_length("text").alias("size")), "labelled")
    found = narrow.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return {}, {}
    # twice as many as wanted, by an estimate of the distinct texts, and of them exactly the first ones
    rate = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, 2 * sample / max(1, r["texts"])))])
    place = F.col("h").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    few = narrow.where((place < rate[F.col("lang")]) & (F.col("size") <= LONGEST_BYTES)).groupBy("lang", "h").agg(F.min("size").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.col("h").bitwiseAND((1 << 52) - 1), "h")
    few = few.withColumns({"rank": F.row_number().over(order), "bytes": F.sum("size").over(order)})
    few = few.where((F.col("rank") <= sample) & (F.col("bytes") <= min(SAMPLE_BYTES, ALL_BYTES // len(counts)))).select("lang", "h")
    texts = rows.join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))  # ``sample`` rows a language
    out: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["h"])):
        out[r["lang"]].append(r["text"])
    return {k: v for k, v in out.items() if v}, counts


def predictor(f: Filters, carry: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.pieces(batches, "text"):
            lang, score = predict(b.column("text"), f)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(lang, pa.string()), pa.array(score)], [*carry, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, learn: Column, carry: list[str], sample: int = SAMPLE) -> DataFrame:
    """The columns ``carry`` of docs with lang_pred and score; the filters are learned from the rows where ``learn`` holds."""
    _io.ship(docs.sparkSession)
    f = fit(*sampled(docs, learn, sample))
    kinds = [x for x in docs.schema.fields if x.name in carry]
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kinds)
    names = [x.name for x in kinds]
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(predictor(f, names), f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2
