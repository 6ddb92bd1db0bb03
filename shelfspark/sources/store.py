"""Table states as snapshots: each save writes a new folder, and then one pointer file changes. The audit log only grows."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.schemas import AUDIT, TABLES


class Snapshots:
    """A folder of snapshots on any file system that Spark reaches.

    A reader sees the snapshot that the pointer named when it looked; a failed save changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._options = jvm.org.apache.hadoop.fs.FileUtil

    def _pointers(self) -> list[str]:
        root = self._path(f"{self.path}/_current")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    @property
    def version(self) -> int:
        """0 before the first save."""
        names = self._pointers()
        return int(names[-1].split("-")[0]) if names else 0

    def save(self, **tables: DataFrame) -> int:
        """Write tables; those that are not given stay as they are. Two savers of one version: the second one raises."""
        at = self.version + 1
        where = json.loads(self._where()) if at > 1 else {}
        for name, df in tables.items():
            where[name] = f"{name}-{at}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{where[name]}")
        name = self._path(f"{self.path}/_current/{at:012d}-pointer")
        out = self._fs.create(name, False)  # fails if it is there
        out.write(bytearray(json.dumps(where).encode()))
        out.close()
        return at

    def _where(self) -> str:
        return self.spark.read.text(f"{self.path}/_current/{self._pointers()[-1]}", wholetext=True).first()[0]

    def load(self, name: str) -> DataFrame:
        where = json.loads(self._where())
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{where[name]}") if name in TABLES else self.spark.read.parquet(f"{self.path}/{where[name]}")


def append_audit(rows: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Timestamp, User and Action, partitioned by day, in a folder of the batch's own.

    A batch with a name (or number) that is appended again takes the place of what it wrote before, so that a job that
    failed may be run again; one without gets a name that nobody else has.
    """
    name = uuid.uuid4().hex if batch is None else str(batch)
    rows.selectExpr("Timestamp", "User", "Action", "to_date(Timestamp) as day").write.mode("overwrite").partitionBy("day").parquet(f"{path.rstrip('/')}/batch={name}")


def create_audit(spark: SparkSession, path: str) -> None:
    """An audit log without a record, with its columns; one that is there stays as it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], AUDIT).write.parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).option("recursiveFileLookup", True).parquet(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which executors share; in local mode, where it is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="shelfspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def numbered(ordered: DataFrame, column: str = "rank") -> DataFrame:
    """A sorted DataFrame with the number of each row in its order, from 1. Written once; no task sees more than its own rows."""
    spark, path = ordered.sparkSession, scratch(ordered.sparkSession, "numbered")
    ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    rows = spark.read.parquet(path)
    before, at = {}, 0
    for r in sorted(rows.groupBy("_part").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect()):  # a row for each partition
        before[r["_part"]], at = at - r["first"] + 1, at + r["n"]
    if not before:
        return rows.withColumn(column, F.lit(0).cast("long")).drop("_part", "_at")
    shift = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
    return rows.withColumn(column, F.col("_at") + shift[F.col("_part")]).drop("_part", "_at")
