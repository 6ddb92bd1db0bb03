"""Row changes as transformations from one state of a table to the next."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import same_id, text
from shelfspark.schemas import TABLES


def seeded_id(prefix: str, *seed: Column | str) -> Column:
    """An id of the usual shape that follows from its seed, so that a task that runs again makes it again."""
    h = F.xxhash64(*seed)
    part = lambda k, n: F.lpad(F.pmod(F.shiftright(h, k), F.lit(10**n)).cast("string"), n, "0")
    return F.concat(F.lit(prefix), part(0, 5), F.char((65 + F.pmod(F.shiftright(h, 20), F.lit(26))).cast("int")), part(30, 4))


def insert(df: DataFrame, table: str, rows: DataFrame) -> DataFrame:
    """rows with all columns of the table; missing ones and nulls are blank."""
    have = set(rows.columns)
    new = rows.select(*[(text(c) if c in have else F.lit("")).alias(c) for c in TABLES[table].names])
    return df.select(*TABLES[table].names).unionByName(new)


def _apart(df: DataFrame, value: str, ordinal: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The row that is meant, further rows with its id, and all others. Only rows with the id are put in order."""
    hit = F.coalesce(same_id("id", value), F.lit(False))
    own, others = df.where(hit), df.where(~hit)
    if ordinal is None:
        return own, own.limit(0), others
    nth = next(n for n in ("nth", *(f"nth_{i}" for i in range(len(df.columns)))) if n not in df.columns)
    own = own.withColumn(nth, F.row_number().over(Window.partitionBy(same_id("id", value)).orderBy(ordinal)))
    return own.where(F.col(nth) == 1).drop(nth), own.where(F.col(nth) > 1).drop(nth), others


def update(df: DataFrame, value: str, patch: Mapping[str, str | Column], ordinal: str | None = None) -> DataFrame:
    """The row's cells in patch change; its id becomes the one given."""
    first, more, others = _apart(df, value, ordinal)
    new = {"id": value, **patch}
    cell = lambda c: (new[c] if isinstance(new[c], Column) else F.lit(new[c])).alias(c) if c in new else F.col(c)
    return others.unionByName(more).unionByName(first.select(*map(cell, df.columns)))


def delete(df: DataFrame, value: str, ordinal: str | None = None) -> DataFrame:
    _, more, others = _apart(df, value, ordinal)
    return others.unionByName(more)
