"""Reading tables by position, looking rows up, and finding tables among files."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import text as X
from shelfspark.schemas import AUDIT_LOCATION, CLASSIFICATIONS, DATE_FORMAT, LAST_DISCOVERY, PROPERTY, TABLES


def scan_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All rows by position: the first line is skipped whatever it says; blank cells stay blank text."""
    df = spark.read.schema(TABLES[table]).option("header", True).option("enforceSchema", True).csv(path)
    return df.select(*[X.text(c).alias(c) for c in df.columns])


def scan_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    return decode(spark.read.parquet(path), table)


def decode(df: DataFrame, table: str) -> DataFrame:
    """Columns by position; dates become long text, other values text; further columns are ignored, too few raise."""
    schema = TABLES[table]
    if len(df.columns) < len(schema):
        raise ValueError(f"{table} has {len(schema)} columns, this has {len(df.columns)}")

    def cell(f: T.StructField, name: str):
        c = F.col(f"`{f.name}`")
        return (F.coalesce(F.date_format(c, DATE_FORMAT), F.lit("")) if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else X.text(c)).alias(name)

    return df.select(*[cell(f, n) for f, n in zip(df.schema.fields, schema.names)])


def encode(df: DataFrame, table: str) -> DataFrame:
    """All columns of the table, null as blank."""
    return df.select(*[X.text(c).alias(c) for c in TABLES[table].names])


def write_csv(df: DataFrame, table: str, path: str) -> None:
    """All columns of the table as CSV with a header; blanks at a cell's ends stay."""
    encode(df, table).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def by_id(df: DataFrame, value: str | int, ordinal: str | None = None) -> DataFrame:
    """The first row with this id; ids are compared as text."""
    found = df.where(X.same_id("id", value))
    return (found.orderBy(ordinal) if ordinal else found).limit(1)


def classifications(spark: SparkSession) -> DataFrame:
    """value, label and prefix of all options, in the order of the list."""
    return spark.createDataFrame([(value, label or value, label is not None) for value, label in CLASSIFICATIONS], "value string, label string, prefix boolean")


def newest(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Of files (id, name, lastModified), for each prefix the newest whose name starts with it; ties go to the smallest id."""
    names = files.sparkSession.createDataFrame([(p,) for p in prefixes], "sheetName string")
    hits = files.join(F.broadcast(names), F.col("name").startswith(F.col("sheetName")))  # a handful of prefixes
    w = Window.partitionBy("sheetName").orderBy(F.desc("lastModified"), "id")
    best = hits.groupBy("sheetName").agg(F.max("lastModified").alias("lastModified"))
    return (
        hits.join(best, ["sheetName", "lastModified"])
        .withColumn("first", F.row_number().over(w))
        .where("first = 1")
        .select("sheetName", F.col("id").alias("spreadsheetId"), F.col("name").alias("spreadsheetName"), "lastModified")
    )


def listing(spark: SparkSession, folder: str, prefixes: list[str] | None = None) -> DataFrame:
    """id (path), name and lastModified of the files in a folder and those below; with prefixes only of names that start so.

    A scan that lists: each prefix is a glob of its own, which is all that storage is asked for, and no content is read.
    """
    escaped = ["*"] if prefixes is None else [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) + "*" for p in prefixes]
    scans = [spark.read.format("binaryFile").option("pathGlobFilter", g).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime") for g in escaped]
    found = reduce(DataFrame.unionByName, scans)
    return found.select(F.col("path").alias("id"), F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("lastModified")).distinct()


def first_of(spark: SparkSession, folder: str) -> str | None:
    """The first table file of a container: a folder of CSV files is what a spreadsheet of sheets is, in the order of names."""
    csv = listing(spark, folder).where(F.lower("name").endswith(".csv"))
    return csv.agg(F.min_by("id", "name")).first()[0]


@dataclass
class Config:
    """Where the tables are, as properties that may be kept in a JSON file."""

    values: dict[str, str] = field(default_factory=dict)
    path: str | None = None

    @classmethod
    def load(cls, path: str) -> Config:
        return cls(json.loads(Path(path).read_text()) if Path(path).exists() else {}, path)

    def _saved(self) -> None:
        if self.path:
            Path(self.path).write_text(json.dumps(self.values, indent=1, sort_keys=True))

    def location(self, table: str) -> str | None:
        return self.values.get(PROPERTY[table])

    def set_audit(self, location: str) -> None:
        """Where the audit log is; a log that is not there begins with its first record."""
        self.set(AUDIT_LOCATION, location)

    def audit(self) -> str | None:
        return self.values.get(AUDIT_LOCATION)

    def set(self, key: str, value: str) -> None:
        self.values[key] = value
        self._saved()

    def master(self) -> Mapping[str, str | None] | None:
        """All locations and the last discovery; None if no table has one."""
        found = {t: self.location(t) for t in TABLES}
        return None if not any(found.values()) else {**found, "lastDiscoveryDate": self.values.get(LAST_DISCOVERY)}

    def clear(self) -> None:
        """Forget the tables and the last discovery; other properties (the audit log's) stay."""
        for key in [*PROPERTY.values(), LAST_DISCOVERY]:
            self.values.pop(key, None)
        self._saved()

    def raw(self, spark: SparkSession, table: str) -> DataFrame | None:
        """The configured file as it is, with its own column names; None as in open()."""
        path = self.location(table)
        if not path:
            return None
        try:
            return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def open(self, spark: SparkSession, table: str) -> DataFrame | None:
        """The configured table; None if it is not configured or not there. Lack of permission raises."""
        path = self.location(table)
        if not path:
            return None
        try:
            return scan_csv(spark, path, table) if path.endswith(".csv") else scan_parquet(spark, path, table)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise


def discover(files: DataFrame, config: Config, now: str) -> dict:
    """Find all tables among files by name, and remember where they are. Partly found is a success with a message."""
    found = newest(files, list(TABLES)).collect()  # three rows at most
    missing = [f'Could not find spreadsheet starting with "{t}"' for t in TABLES if t not in {r["sheetName"] for r in found}]
    if not found:
        return {"success": False, "error": "No master spreadsheets found. " + "; ".join(missing)}
    for r in found:
        config.set(PROPERTY[r["sheetName"]], r["spreadsheetId"])
    config.set(LAST_DISCOVERY, now)
    out = {"success": True, "data": [r.asDict() for r in found]}
    return out | ({"error": "Partial discovery. Missing: " + "; ".join(missing)} if missing else {})


def with_ids(df: DataFrame, prefix: str = "M") -> DataFrame:
    """An id column in front, if the first column is not one already."""
    return df if df.columns[:1] == ["id"] else df.select(X.new_id(prefix).alias("id"), *df.columns)


def headers_match(df: DataFrame, table: str) -> bool:
    """Whether the table's first columns have the expected names."""
    return df.columns[: len(TABLES[table])] == TABLES[table].names


def initialise_headers(spark: SparkSession, config: Config) -> dict[str, dict]:
    """For each table whether it has the expected columns in front, or why not. Parquet and CSV files are not changed."""
    out = {}
    for table in TABLES:
        df = config.raw(spark, table)
        error = f"{table} is not configured" if df is None else None if headers_match(df, table) else f"{table} has other columns: {', '.join(df.columns)}"
        out[table] = {"success": error is None, **({"error": error} if error else {})}
    return out


def ensure_headers(spark: SparkSession, config: Config, table: str, path: str) -> dict:
    """If the configured table's first columns have other names, write it to ``path`` with the expected ones, and configure that.

    A CSV file's first line is then taken for a row, which stays, below the header that is put above it; Parquet columns
    are named by position. Further columns are not kept: a scan by position ignores them.
    """
    df = config.raw(spark, table)
    if df is None:
        return {"success": False, "error": f"{table} is not configured"}
    if headers_match(df, table):
        return {"success": True, "inserted": False}
    where = config.location(table)
    if where.endswith(".csv"):
        names = TABLES[table].names
        lines = spark.read.schema(TABLES[table]).option("header", False).csv(where)
        path = path if path.endswith(".csv") else path + ".csv"
        write_csv(lines.select(*names), table, path)
    else:
        decode(df, table).write.parquet(path)
    config.set(PROPERTY[table], path)
    return {"success": True, "inserted": True}


def backfill(spark: SparkSession, config: Config, path: str, table: str = "Media") -> dict:
    """Write the configured table with ids to ``path`` and configure that, if it has no ids yet; how many rows got one."""
    df = config.raw(spark, table)
    if df is None:
        return {"success": False, "error": f"{table} is not configured"}
    if df.columns[:1] == ["id"]:
        return {"success": True, "rowsUpdated": 0}
    with_ids(df).write.parquet(path)
    config.set(PROPERTY[table], path)
    return {"success": True, "rowsUpdated": spark.read.parquet(path).count()}
