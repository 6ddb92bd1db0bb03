"""A training corpus from raw documents: five stages, each an operator over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns one row for each packed
piece. Texts change (lines go, pseudonyms come in) and n_chars follows them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import _io, langid, linededup, ngram_join, packing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of known n-grams a text is in none of the learned languages.
LEAST_SCORE = 0.2
#: Near duplicates: words in a shingle, and the least Jaccard similarity in percent (op8's contract has values of its own).
WORDS, PERCENT = 5, 80


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language, go."""
    out = langid.identify(docs, ~langid.held_out(), COLUMNS)
    return out.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which nothing but white space is left."""
    return _documents(linededup.deduplicated(docs)).where("text rlike '[^ \\\\t-\\\\r]'")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard 0.8 stays: that with the smallest doc_id. Documents without a doc_id stay."""
    found = _io.saved(ngram_join.joined(docs, WORDS, PERCENT), "groups")
    first = _io.bounded(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "first")
    kept = docs.join(first, "doc_id", "left_semi")
    if first.where("rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return _documents(pii.pseudonymised(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as sequences."""
    return packing.packed(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _io.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Token ids and keyed pseudonyms are beyond SQL.
ORACLE_SQL = None
