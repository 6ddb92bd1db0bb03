"""Extensions: the audit log as a stream, and commands from a stream. The log grows only, so it is a natural source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.functions.dates import Day
from shelfspark.plans.commands import circulate
from shelfspark.schemas import AUDIT
from shelfspark.sources.store import Snapshots


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT).parquet(path)


def actions_by_window(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Actions by kind (their first word) and window; state older than the watermark is dropped."""
    kind = F.substring_index("Action", " ", 1)
    return log.withWatermark("Timestamp", late).groupBy(F.window("Timestamp", width), kind.alias("kind")).agg(F.count("*").alias("n")).select("window.start", "window.end", "kind", "n")


def once(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """Records of a stream (Timestamp, batch, seq) without those that a source sends again: one each of batch and seq, while
    it may still come; what it has seen is forgotten after the watermark."""
    return records.withWatermark("Timestamp", late).dropDuplicatesWithinWatermark(["batch", "seq"])


def circulate_stream(commands: DataFrame, store: Snapshots, audit: str, checkpoint: str, as_of: Day = None) -> StreamingQuery:
    """Apply each micro-batch of commands to the stored loans. The store remembers the last batch, so that one that is
    run again after its snapshot was saved is skipped. ``audit`` is a folder of the stream's own with a part for each
    batch, which a batch that is run again overwrites."""

    def apply(batch: DataFrame, number: int) -> None:
        done = store.load("_batch").first()[0] if store.version and "_batch" in store._where() else -1
        if number <= done:
            return
        out = circulate(store.load("Loans"), batch, as_of)
        rows = out.audit.select(F.current_timestamp().alias("Timestamp"), F.lit("stream").alias("User"), F.col("action").alias("Action"))
        rows.write.mode("overwrite").parquet(f"{audit.rstrip('/')}/batch={number}")
        store.save(Loans=out.loans, _batch=batch.sparkSession.createDataFrame([(number,)], "batch long"))

    return commands.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
