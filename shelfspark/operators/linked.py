"""Groups of nodes that edges link, told only where somebody asks: labels spread from seeds along edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfspark.sources.store import scratch


def labelled(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of every node that edges (a, b) link with a seed (node): label is the least seed reachable.

    Each round is a join of the labels that changed with the edges and one aggregation; labels are written to the shared
    folder, which cuts the lineage. Rounds follow the longest way from a seed, which is short where edges are a resource's
    copies or a copy's loan. Nodes that no seed reaches are never touched.
    """
    spark = seeds.sparkSession
    path = scratch(spark, "edges")
    e = edges.where("a is not null and b is not null and a <> b")
    e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().write.parquet(path)
    both = spark.read.parquet(path)

    def written(df: DataFrame) -> tuple[DataFrame, int]:
        mark, at = Observation(), scratch(spark, "labels")
        df.observe(mark, F.count_if("changed").alias("n")).write.parquet(at)
        return spark.read.parquet(at), mark.get["n"]

    labels, n = written(seeds.select("node", F.col("node").alias("label"), F.lit(True).alias("changed")).where("node is not null").distinct())
    while n:
        spread = both.join(labels.where("changed").select(F.col("node").alias("a"), "label"), "a").select(F.col("b").alias("node"), "label", F.lit(None).cast("string").alias("old"))
        all_ = spread.unionByName(labels.select("node", "label", F.col("label").alias("old")))
        least = all_.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        labels, n = written(least.select("node", "label", F.expr("old is null or label < old").alias("changed")))
    return labels.select("node", "label")
