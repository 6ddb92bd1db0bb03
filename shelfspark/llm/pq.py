"""Product quantisation: codes of vectors by codebooks that are learned from all of them.

A component x becomes the integer floor(256 x), a vector's components are cut into PARTS equal parts. Vectors are written
once as columnar NumPy blocks (one binary row for some thousands of vectors, component by component), on which an RDD
works: each task assigns its blocks' parts, distances accumulating dimension by dimension, and adds up int64 tensors of
sums and counts, which treeAggregate merges through a reduction tree. A tensor has the codebooks' size, whatever the
number of vectors; all arithmetic is in integers, so that a task that runs again, or in another order, changes nothing.

Each part's codebook starts as that part of the first ENTRIES vectors by vec_id (then by components); a vector's nearest
entry is the first of those at the least squared distance; an entry becomes the floor of its parts' mean.

Cases: a vector is left out if it is null or empty, holds nulls or values that are not finite, or if its length is not
that of the first vector that has a multiple of PARTS components; a vec_id may be null (last in order) or repeated;
fewer vectors than entries make smaller codebooks; an empty table gives an empty result; other columns are ignored.
Components beyond 2**20 in magnitude raise an error, since 64-bit sums of their squares may not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors in a block, and the largest magnitude of a component.
BLOCK, LARGEST = 2048, 1 << 20
BLOCKS = "vec_ids array<long>, labels array<long>, n int, data binary"
#: Of the tree through which tensors are merged.
DEPTH = 3


def integers(col: pa.Array, length: int) -> np.ndarray:
    """(length, rows) of rows that have that length: floor(SCALE x)."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * SCALE)
    if np.abs(x).max(initial=0) > LARGEST * SCALE:
        raise ValueError(f"components beyond {LARGEST} in magnitude can't be quantised exactly")
    return np.ascontiguousarray(x.astype(np.int32).reshape(-1, length).T)


def _blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                one = lambda c, b=b: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c))
                yield pa.RecordBatch.from_arrays(
                    [one("vec_id"), one("label"), pa.array([b.num_rows], pa.int32()), pa.array([integers(b.column("vector"), length).tobytes()], pa.binary())], ["vec_ids", "labels", "n", "data"]
                )
        _text.release()

    return run


def assigned(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, n) nearest entry and its squared distance of a block (length, n); codebooks: (parts, entries, length of a part)."""
    parts, entries, width = codebooks.shape
    n = x.shape[1]
    code, error = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(codebooks).max(initial=0))
    kind = np.int32 if width * reach * reach < 1 << 31 else np.int64
    x, c = x.astype(kind, copy=False), codebooks.astype(kind)
    for p in range(parts):
        distance = np.zeros((entries, n), kind)
        for j in range(width):
            apart = x[p * width + j][None, :] - c[p, :, j][:, None]
            apart *= apart
            distance += apart
        code[p] = distance.argmin(0)
        error[p] = distance[code[p], np.arange(n)]
    return code, error


class Tensors:
    """Sums and counts of the parts that each entry has; they add up in any order."""

    def __init__(self, codebooks: np.ndarray):
        self.sums, self.counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)

    def add(self, block, codebooks: np.ndarray) -> Tensors:
        x = np.frombuffer(block["data"], np.int32).reshape(-1, block["n"])
        code, _ = assigned(x, codebooks)
        width = codebooks.shape[2]
        for p in range(len(codebooks)):
            np.add.at(self.counts[p], code[p], 1)
            for j in range(width):
                np.add.at(self.sums[p, :, j], code[p], x[p * width + j])
        return self

    def merge(self, other: Tensors) -> Tensors:
        self.sums += other.sums
        self.counts += other.counts
        return self


def trained(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after so many rounds of assignment and replacement over all blocks."""
    rdd = blocks.select("n", "data").rdd
    sc = blocks.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(codebooks)  # of the codebooks' size
        t = rdd.treeAggregate(None, lambda t, b, c=shared: (t or Tensors(c.value)).add(b, c.value), lambda a, b: a.merge(b) if a and b else a or b, DEPTH)
        if t is not None:
            codebooks = np.where(t.counts[:, :, None] > 0, t.sums // np.maximum(t.counts, 1)[:, :, None], codebooks)
        shared.unpersist()
    return codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def _coding(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                code, error = assigned(np.frombuffer(batch.column("data")[i].as_buffer(), np.int32).reshape(-1, n), codebooks)
                names = [row.tobytes().hex() for row in np.ascontiguousarray(code.astype(np.uint8).T)]
                own = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([own("vec_ids"), own("labels"), pa.array(names, pa.string()), pa.array(error.sum(0))], ["vec_id", "label", "code", "error"])
        _text.release()

    return run


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every vector of vectors (vec_id, label, vector), and the codebooks."""
    spark = vectors.sparkSession
    _io.ship(spark)
    none = spark.createDataFrame([], "vec_id long, label long, code string, error long")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector")
    v = v.where("vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    by_id = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    lengths = by_id(v.where(F.size("vector") % parts == 0)).limit(1).collect()
    if not lengths:
        return none, np.zeros((parts, 0, 0), np.int64)
    length = len(lengths[0]["vector"])
    v = v.where(F.size("vector") == length)
    first = by_id(v).limit(entries).select("vector").toArrow()["vector"].combine_chunks()
    codebooks = integers(first, length).astype(np.int64).reshape(parts, length // parts, -1).transpose(0, 2, 1)
    blocks = _io.saved(v.mapInArrow(_blocks(length), BLOCKS), "blocks")
    codebooks = trained(blocks, np.ascontiguousarray(codebooks), rounds)
    return blocks.mapInArrow(_coding(codebooks), none.schema), codebooks


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with the sum of the errors of all rows of its label, those without one together."""
    coded = _io.saved(coded, "codes")
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(_io.bounded(total, "labels"), F.col("label").eqNullSafe(F.col("of"))).drop("of")
