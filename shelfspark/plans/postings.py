"""Substring search through postings: which rows hold each run of three characters, so that a query reads only its own.

A row's grams are those of its searched fields in lower case. A query of three characters or more is in a field only if
all of its grams are: of those, the rarest few are read (postings are in parts by the gram's hash and sorted by gram, so
that a scan takes few parts and row groups), and what has them all is verified against the rows themselves, which are in
parts by id. Shorter queries scan. The result is the scan's, whatever the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from shelfspark.functions.text import any_contains, text
from shelfspark.sources.parts import Parts

#: Characters of a gram, and grams of a query that are looked up: the rarest.
GRAM, LOOKED_UP = 3, 4
#: Beyond so many parts with hits the rows are scanned with the hits joined: below, just those parts are read.
FEW_PARTS = 16
_POSTINGS = T.StructType().add("gram", "string").add("id", "string")
_SIZES = T.StructType().add("gram", "string").add("rows", "long")


def grams(c: Column | str) -> Column:
    """The distinct grams of a text in lower case; none if it is shorter."""
    low = F.lower(text(c))
    at = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(GRAM))))


class Postings:
    """Rows of a table with text ``id`` and the columns that are searched."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, columns: list[str], n: int = 64):
        self.spark, self.columns = spark, columns
        self.rows = Parts(spark, f"{path}/rows", schema, "id", n)
        self.postings = Parts(spark, f"{path}/postings", _POSTINGS, "gram", n)
        self.sizes = Parts(spark, f"{path}/sizes", _SIZES, "gram", n)

    def _of(self, df: DataFrame) -> DataFrame:
        return df.select("id", F.explode(F.array_distinct(F.flatten(F.array(*map(grams, self.columns))))).alias("gram"))

    def create(self, df: DataFrame) -> Postings:
        self.rows.create(df)
        self.postings.create(self._of(self.rows.read()))
        self.sizes.create(self.postings.read().groupBy("gram").agg(F.count("*").alias("rows")))
        return self

    def upsert(self, rows: DataFrame) -> None:
        """New and changed rows. Postings only grow: one that no longer holds costs a look at its row, and no more."""
        new = self._of(rows)
        self.postings.insert(new)
        more = new.groupBy("gram").agg(F.count("*").alias("rows"))
        old = self.sizes.read(self.sizes.of(more))
        self.sizes.upsert(old.unionByName(more).join(more.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.sum("rows").alias("rows")))
        self.rows.upsert(rows)

    def hits(self, query: str) -> DataFrame | None:
        """Ids of rows that have the query's rarest grams; None for a query that is too short to have one."""
        q = query.lower()
        all_ = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        if not all_:
            return None
        asked = self.spark.createDataFrame([(g,) for g in all_], "gram string")
        sizes = {r["gram"]: r["rows"] for r in self.sizes.read(self.sizes.of(asked)).where(F.col("gram").isin(all_)).collect()}  # a row for each gram of the query
        if len(sizes) < len(all_):
            return self.postings.read([]).select("id")
        rare = sorted(all_, key=sizes.get)[:LOOKED_UP]
        found = self.postings.read(self.postings.of(asked.where(F.col("gram").isin(rare)))).where(F.col("gram").isin(rare))
        return found.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rare)).select("id")

    def search(self, query: str) -> DataFrame:
        """Rows with the query in one of the columns, regardless of case."""
        hits = self.hits(query)
        if hits is None:
            return self.rows.read().where(any_contains(self.columns, query))
        parts = self.rows.of(hits)
        own = self.rows.read(parts if len(parts) <= FEW_PARTS else None)
        return own.join(hits, "id", "left_semi").where(any_contains(self.columns, query))
