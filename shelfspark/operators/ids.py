"""New ids without repeats: running numbers through a keyed permutation of all ids of the usual shape.

An id is a prefix, five digits, a letter and four digits, of which there are 26 * 10**9. A number below that is split into
a remainder below LOW and a quotient below HIGH (LOW * HIGH is just that many, so that no number has to be walked on to
stay in range), and a Feistel network adds keyed hashes of each half to the other. Different numbers give different ids,
and numbers in a row give ids that don't look it. All of it is plain SQL functions; the inverse tells an id's number, by
which numbers are passed over whose ids a table has already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import text
from shelfspark.sources.store import numbered, scratch

LOW, HIGH = 160_000, 162_500
ALL = LOW * HIGH
ROUNDS = 4


def _turned(place: Column, key: str, rounds: range) -> Column:
    """A number after the rounds in their order; what comes back is again low + LOW * high."""
    sign = 1 if rounds.step > 0 else -1
    hashed = lambda half, i, size: sign * F.pmod(F.xxhash64(F.lit(key), i, half), F.lit(size).cast("long"))
    within = lambda c, size: F.pmod(c, F.lit(size).cast("long"))
    turn = lambda s, i: F.struct(
        F.when(i % 2 == 0, within(s["low"] + hashed(s["high"], i, LOW), LOW)).otherwise(s["low"]).alias("low"),
        F.when(i % 2 == 1, within(s["high"] + hashed(s["low"], i, HIGH), HIGH)).otherwise(s["high"]).alias("high"),
    )
    start = F.struct((place % LOW).alias("low"), F.floor(place / LOW).alias("high"))
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), start, turn, lambda s: s["high"] * LOW + s["low"])


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def numbered_id(prefix: str, number: Column | str, key: str = "") -> Column:
    """The id of a running number; numbers count modulo 26 * 10**9."""
    n = F.pmod((F.col(number) if isinstance(number, str) else number).cast("long"), F.lit(ALL).cast("long"))
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    letter = lambda p: F.char((65 + F.floor(p / 10**4) % 26).cast("int"))
    return _with(_turned(n, key, range(ROUNDS)), lambda p: F.concat(F.lit(prefix), digits(F.floor(p / (26 * 10**4)), 5), letter(p), digits(p % 10**4, 4)))


def number_of(prefix: str, id_: Column | str, key: str = "") -> Column:
    """The running number of an id; null for text of another shape or prefix."""
    part = lambda c, at, n: F.substr(c, F.lit(len(prefix) + at), F.lit(n))
    place = lambda c: part(c, 1, 5).cast("long") * (26 * 10**4) + (F.ascii(part(c, 6, 1)) - 65) * 10**4 + part(c, 7, 4).cast("long")
    shaped = lambda c: c.rlike(f"^\\Q{prefix}\\E[0-9]{{5}}[A-Z][0-9]{{4}}$")
    return _with(text(id_), lambda c: F.when(shaped(c), _turned(place(c), key, range(ROUNDS)[::-1])))


def identified(rows: DataFrame, order: str, known: DataFrame, prefix: str, key: str = "") -> DataFrame:
    """rows with an ``id`` each, in the order of a column: the least running numbers whose ids ``known`` (id) doesn't have.

    Equal rows and ids give equal results, so that a job that runs again makes the same ids. rows are written once, in
    order; the numbers to pass over are counted, and joined by number, wherever there are any.
    """
    ranked = numbered(rows.orderBy(order), "_nth")
    n = ranked.agg(F.max("_nth")).first()[0] or 0
    taken = known.select(number_of(prefix, "id", key).alias("_number")).where(f"_number is not null and _number < {n}").distinct()
    spark, have = rows.sparkSession, taken.count() if n else 0
    if not have:
        return ranked.withColumn("id", numbered_id(prefix, F.col("_nth") - 1, key)).drop("_nth")
    # so many more numbers, of which some may be taken too
    most, more = n, have
    while more:
        most += more
        taken = known.select(number_of(prefix, "id", key).alias("_number")).where(f"_number is not null and _number < {most}").distinct()
        more = n - (most - taken.count())
    path = scratch(spark, "free")
    free = numbered(spark.range(most).withColumnRenamed("id", "_number").join(taken, "_number", "left_anti").orderBy("_number"), "_nth")
    free.where(F.col("_nth") <= n).write.parquet(path)
    return ranked.join(spark.read.parquet(path), "_nth").withColumn("id", numbered_id(prefix, "_number", key)).drop("_nth", "_number")
