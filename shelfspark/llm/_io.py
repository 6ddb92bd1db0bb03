"""Shared folders, lineage cuts and connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, a new temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Let executors import this package, whether or not it is installed there, and bound their Arrow batches.

    Texts may be long: batches of 4 MB keep the memory of a worker, and of the executor that fills them, small.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    if getattr(sc, "_shelfspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = os.path.join(sc._temp_dir, "shelfspark_package.zip")  # Spark's own folder on the driver, which serves it to executors
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(name)
    sc._shelfspark_shipped = True


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Delete tables that saved() wrote, once all that was made of them is written itself."""
    for df in frames:
        if path := getattr(df, "_saved_at", None):
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def collected(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark's cleaner then drops the shuffle files and broadcasts of finished queries."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame, what: str) -> DataFrame:
    """saved(), and collected(): what the table was made from may be many times its size."""
    out = saved(df, what)
    collected(df.sparkSession)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each round is two aggregations with map-side
    combine, so that a hub's neighbours are never gathered in one task. Rounds grow with the
    logarithm of the longest path. Edges stay distributed; each round is written to the shared folder.
    Null ends and self-loops are dropped; an empty input gives an empty result.
    """
    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        # a set of edges that a round leaves as it was has the same size and sums of hashes, which are counted as it is written
        mark = Observation()
        out = saved(df.observe(mark, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y")), "edges")
        return out, mark.get

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null").where("u <> v").distinct()
    e, before = written(e)
    while before["n"]:
        # large star: each node's larger neighbours go to its smallest neighbour (itself included)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node's smaller neighbours, and itself, go to its smallest neighbour
        low = large.where("u > v").distinct()
        small = low.groupBy("u").agg(F.min("v").alias("m"))
        joined = low.join(small, "u")
        after = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        last, old = before, e
        e, before = written(after)
        discarded(old)
        if before == last:
            break
    named = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = saved(named, "components")
    discarded(e)
    return out


#: A side that is written and below so many bytes (compressed; several times that in memory) is broadcast; beyond it the
#: join shuffles.
BROADCAST_BYTES = 8 << 20


def bounded(small: DataFrame, what: str) -> DataFrame:
    """small, written to the shared folder; marked for broadcast only if what was written is small."""
    out = saved(small, what)
    size = int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > BROADCAST_BYTES:
        return out
    marked = F.broadcast(out)
    marked._saved_at = out._saved_at
    return marked


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that no column of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)
