"""Library tables derived from the driver's star schema, by the same formulas in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.dates import show

AS_OF = "2001-08-15"
LOANS_FROM = "2001-05-01"
#: Classification by p_partkey % 10.
CLASSES = ["", "BIOG", "DVD F 060", "dvd tv box", " Kids ", "ELT Magazine", "ELT Magazine CD", "XZ 12", "English Course B1", "GEN"]


def _pad6(c: Column | str) -> Column:
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), 6, "0")


def _copy(part: Column, k: Column) -> Column:
    return F.concat(F.lit("P"), _pad6(part), F.lit("C"), k.cast("string"))


def borrowers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, blank = F.col("c_custkey"), F.lit("")
    return c.select(
        F.concat(F.lit("B"), _pad6("c_custkey")).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
        *[blank.alias(x) for x in ("phone", "gender", "address", "postcode")],
        F.col("c_mktsegment").alias("borrowerType"),
        F.when(key % 11 == 0, "").otherwise(show(F.date_add(F.lit("2000-12-01").cast("date"), (key * 37 % 500).cast("int")))).alias("expiryDate"),
        show(F.date_add(F.lit("1995-01-01").cast("date"), (key % 1000).cast("int"))).alias("memberSince"),
    )


def media(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """more: further columns of part, as they are."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    n = (key % 4).cast("int")
    copies = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: _copy(key, k)))
    joined = F.when(key % 7 == 0, F.array_join(copies, " | ")).otherwise(F.array_join(copies, "|"))
    own, next_ = _copy(key, F.lit(1)), _copy(key + 1, F.lit(1))
    entry = lambda v: F.concat(F.lit('{"'), own, F.lit('":'), v, F.lit("}"))
    box = (
        F.when(key % 20 == 1, entry(F.concat(F.lit('"'), next_, F.lit('"'))))
        .when(key % 20 == 5, "not json").when(key % 20 == 9, entry(F.lit("5"))).when(key % 20 == 13, entry(F.lit('"NOPE"'))).when(key % 20 == 17, '["x"]').otherwise("")
    )
    return p.select(
        F.concat(F.lit("M"), _pad6("p_partkey")).alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.col("p_type").alias("type"),
        F.element_at(F.array(*map(F.lit, CLASSES)), (key % 10 + 1).cast("int")).alias("classification"),
        F.when(key % 13 == 0, F.concat(joined, F.lit("|"))).otherwise(joined).alias("barcodes"),
        box.alias("resourceBox"),
        *more,
    )


def loans(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """more: further columns of lineitem, orders, part and customer as joined, as they are."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_shipdate") >= F.lit(LOANS_FROM).cast("timestamp_ntz"))
    k = (1 + F.col("l_linenumber") % 3).alias("k")
    kept = li.select("l_partkey", "l_orderkey", "l_shipdate", k).where("k <= l_partkey % 4")
    g = kept.groupBy("l_partkey", "k").agg(F.min("l_orderkey").alias("o_orderkey"), F.max("l_shipdate").cast("date").alias("out"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    j = g.join(orders, "o_orderkey").join(parts, "l_partkey").join(people, "o_custkey")
    barcode = _copy(F.col("l_partkey"), F.col("k"))
    return j.select(
        F.concat(F.lit("L"), barcode).alias("id"),
        barcode.alias("barcode"),
        F.col("p_name").alias("title"),
        show(F.col("out")).alias("checkoutDate"),
        show(F.date_add("out", 21)).alias("dueDate"),
        F.col("c_name").alias("borrowerName"),
        F.concat(F.lit("B"), _pad6("o_custkey")).alias("borrowerId"),
        *more,
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("ts").alias("Timestamp"), F.col("user_id").cast("string").alias("User"), F.col("event_type").alias("Action"))


_CLASS_CASE = "case p_partkey % 10 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(CLASSES)) + " end"
_PAD = "lpad({}::varchar, 6, '0')"
#: The same tables as common table expressions of DuckDB.
SQL = {
    "borrowers": f"""select 'B' || {_PAD.format('c_custkey')} as id, c_name as name, lower(replace(c_name, '#', '.')) || '@example.org' as email,
  '' as phone, '' as gender, '' as address, '' as postcode, c_mktsegment as "borrowerType",
  case when c_custkey % 11 = 0 then '' else strftime(date '2000-12-01' + (c_custkey * 37 % 500)::int, '%B %-d, %Y') end as "expiryDate",
  strftime(date '1995-01-01' + (c_custkey % 1000)::int, '%B %-d, %Y') as "memberSince" from customer""",
    "media": f"""select id, title, author, type, classification,
  case when p_partkey % 7 = 0 then array_to_string(copies, ' | ') else array_to_string(copies, '|') end || case when p_partkey % 13 = 0 then '|' else '' end as barcodes,
  case p_partkey % 20 when 1 then '{{"' || own || '":"P' || {_PAD.format('(p_partkey + 1)')} || 'C1"}}' when 5 then 'not json' when 9 then '{{"' || own || '":5}}'
    when 13 then '{{"' || own || '":"NOPE"}}' when 17 then '["x"]' else '' end as "resourceBox"
  from (select *, 'M' || {_PAD.format('p_partkey')} as id, p_name as title, p_brand as author, p_type as type, {_CLASS_CASE} as classification,
    'P' || {_PAD.format('p_partkey')} || 'C1' as own, list_transform(range(1, (p_partkey % 4 + 1)::bigint), lambda k: 'P' || {_PAD.format('p_partkey')} || 'C' || k::varchar) as copies from part)""",
    "loans": f"""select 'L' || code as id, code as barcode, p_name as title, strftime(d, '%B %-d, %Y') as "checkoutDate", strftime(d + 21, '%B %-d, %Y') as "dueDate",
  c_name as "borrowerName", 'B' || {_PAD.format('o_custkey')} as "borrowerId"
  from (select 'P' || {_PAD.format('l_partkey')} || 'C' || k::varchar as code, l_partkey, o, d from (
      select l_partkey, 1 + l_linenumber % 3 as k, min(l_orderkey) as o, max(l_shipdate)::date as d from lineitem
      where l_shipdate >= timestamp '{LOANS_FROM}' and 1 + l_linenumber % 3 <= l_partkey % 4 group by 1, 2)) g
  join orders on o_orderkey = o join part on p_partkey = l_partkey join customer on c_custkey = o_custkey""",
}
