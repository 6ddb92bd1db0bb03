"""Tables in parts by a hash of their key: a change rewrites the parts that it touches, a look-up reads one.

Parts are Spark's own partitions, replaced by dynamic partition overwrite: a job that fails changes nothing, since new
files take the old ones' places only when all of them are written. One writer at a time. Rows with a null key are kept with
those of a blank one, and no change but create() takes them out. Within a part rows are sorted by
key, and look-up columns have Parquet Bloom filters, so that a scan skips row groups of other keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark.functions.text import text
from shelfspark.sources.store import scratch

PART = "_part"
#: Bytes in a row group: what a look-up reads where others are skipped.
ROW_GROUP = 1 << 20
#: Rows that one task sorts and writes: a part with more is written by several tasks, each a file of its own.
TASK_ROWS = 500_000


def indexed(df: DataFrame, *columns: str, row_group: int = ROW_GROUP):
    """A writer of df with a Bloom filter for each of these columns."""
    w = df.write.option("parquet.block.size", row_group).option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in columns:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return w


class Parts:
    """A table at a path in ``n`` parts by the hash of ``key`` (as text); ``lookup``: further columns to look rows up by."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", n: int = 64, lookup: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.key, self.n, self.lookup = spark, path.rstrip("/"), schema, key, n, lookup

    def part(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(text(self.key if key is None else key)), F.lit(self.n)).cast("int")

    def _dealt(self, df: DataFrame) -> DataFrame:
        """df's rows in order, a part dealt to as many tasks as it has TASK_ROWS. The driver sees a count for each part."""
        rows = df.select(*self.schema.names, self.part().alias(PART))
        counts = {r[PART]: r["count"] for r in rows.groupBy(PART).count().collect()}
        tasks = [-(-counts.get(k, 0) // TASK_ROWS) or 1 for k in range(self.n)]
        first = [sum(tasks[:k]) for k in range(self.n)]
        of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col(PART) + 1)
        task = of(first) + F.pmod(F.xxhash64(F.lit("task"), *self.schema.names), of(tasks)).cast("int")
        return rows.repartitionById(sum(tasks), task).sortWithinPartitions(PART, self.key)

    def _write(self, df: DataFrame) -> None:
        """Replace just the parts that df has rows of."""
        rows = self._dealt(df)
        indexed(rows, self.key, *self.lookup).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def create(self, df: DataFrame) -> Parts:
        """The table anew, with df's rows."""
        self._drop(range(self.n))
        self._write(df)
        return self

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """All rows, or those of some parts, of which alone files are listed in the plan."""
        schema = StructType([*self.schema.fields]).add(PART, "integer")
        df = self.spark.read.schema(schema).parquet(self.path) if self._there() else self.spark.createDataFrame([], schema)
        return (df if parts is None else df.where(F.col(PART).isin(parts))).drop(PART)

    def of(self, *keys: DataFrame) -> list[int]:
        """The parts that hold these keys: a bounded list. Each DataFrame has the key's column."""
        return sorted({r[0] for k in keys for r in k.select(self.part().alias(PART)).distinct().collect()})

    def find(self, value: str) -> DataFrame:
        """The rows of one key, from one part."""
        part = self.spark.range(1).select(self.part(F.lit(str(value)))).first()[0]
        return self.read([part]).where(F.col(self.key) == F.lit(str(value)))

    def replace(self, parts: list[int], rows: DataFrame) -> None:
        """rows are what these parts hold from now on; the others keep their files."""
        if not parts:
            return
        # rows may be read from the parts that they replace
        path = scratch(self.spark, "parts")
        rows.select(*self.schema.names).write.parquet(path)
        new = self.spark.read.schema(self.schema).parquet(path)
        self._write(new)
        # dynamic overwrite leaves a part alone that nothing is written to
        self._drop(set(parts) - set(self.of(new)))

    def _drop(self, parts) -> None:
        jvm = self.spark.sparkContext._jvm
        for k in parts:
            where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{PART}={k}")
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def _there(self) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Put rows in place of those of their keys, and take those of ``gone`` (the key's column) out. The parts rewritten."""
        keys = rows.select(self.key) if gone is None else rows.select(self.key).unionByName(gone.select(self.key))
        parts = self.of(keys)
        self.replace(parts, self.read(parts).join(keys.distinct(), self.key, "left_anti").select(*self.schema.names).unionByName(rows.select(*self.schema.names)))
        return parts

    def insert(self, rows: DataFrame) -> None:
        """Further files; none is rewritten."""
        indexed(self._dealt(rows), self.key, *self.lookup).mode("append").partitionBy(PART).parquet(self.path)
