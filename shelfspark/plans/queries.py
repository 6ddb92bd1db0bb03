"""The library's queries over its tables. All are lazy, and all that depend on the day take it as ``as_of``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.functions.copies import exploded, k2_copies, k3_copies, tokens
from shelfspark.functions.dates import Day, membership, overdue, parse
from shelfspark.operators import availability as A
from shelfspark.operators import classification as C

MEDIA_FIELDS = ["id", "title", "author", "type", "classification", "barcodes", "resourceBox"]


def members(borrowers: DataFrame, as_of: Day = None) -> DataFrame:
    """All members with their membership status, by name in the order of a dictionary."""
    return borrowers.withColumn("status", membership("expiryDate", as_of)).orderBy(F.expr("coalesce(name, '') collate UNICODE"), "id")


def search_members(borrowers: DataFrame, query: str, as_of: Day = None) -> DataFrame:
    """Members whose name or e-mail address holds the query; all for a blank one."""
    return borrowers.where(X.any_contains(["name", "email"], query)).withColumn("status", membership("expiryDate", as_of))


def all_media(media: DataFrame, loans: DataFrame) -> DataFrame:
    """Resources with barcodes, blank fields as null, and whether a copy is free (raw keys)."""
    return media.where("barcodes <> ''").select(*X.sparse(media.columns)).join(A.two_state_status(media, loans), "id")


def media_json(media: DataFrame, loans: DataFrame) -> DataFrame:
    """all_media as one JSON text for each resource, for functions.edge.response."""
    return all_media(media, loans).select("id", X.json([*media.columns, "status"]).alias("json"))


def barcodes(media: DataFrame) -> DataFrame:
    """All copies' barcodes, trimmed, without blank ones; duplicates stay."""
    return media.select(F.explode(k2_copies("barcodes")).alias("barcode"))


def available_media(media: DataFrame) -> DataFrame:
    """All resources: despite its name it does not filter."""
    return media


def search_available_copies(media: DataFrame, loans: DataFrame, query: str) -> DataFrame:
    """id, barcode and title of each raw copy that is not on loan, if the query is in a field or in that copy's barcode."""
    free = A.available_copies(media, loans, "K1")
    fields = ["title", "author", "type", "classification", "resourceBox", "copy"]
    return free.where(X.any_contains(fields, query)).select("id", F.col("copy").alias("barcode"), "title")


def search_media(media: DataFrame, loans: DataFrame, query: str = "", classification: str = "", status: str = "") -> DataFrame:
    """Resources by text, classification and three-state status; nothing if all three are blank."""
    if not (query or classification or status):
        return media.select(*X.sparse(media.columns), F.lit("").alias("status")).limit(0)
    hit = media.where(C.selected("classification", classification)) if classification else media
    hit = hit.where(X.any_contains(["title", "author", "type", "classification", "resourceBox", "barcodes"], query))
    out = hit.select(*X.sparse(media.columns)).join(A.status(hit, loans, "K2"), "id")
    return out.where(F.col("status") == status) if status else out


def find_available(media: DataFrame, loans: DataFrame, query: str) -> DataFrame:
    """Resources by text, with the number of copies that are free; nothing for a blank query."""
    q = query.strip()
    out = media.select("id", "title", "author", "classification")
    if not q:
        return out.withColumn("availableCount", F.lit(0).cast("long")).limit(0)
    fields = X.any_contains(["title", "author", "type", "classification", "resourceBox"], q)
    hit = media.where(fields | F.exists(k3_copies("barcodes"), lambda b: b.contains(q.lower())))
    return hit.select(*out.columns).join(A.counts(hit, loans, "K3").select("id", "availableCount"), "id")


def active_loans(loans: DataFrame) -> DataFrame:
    """All loans: a returned loan is no row any more."""
    return loans


def overdue_loans(loans: DataFrame, as_of: Day = None) -> DataFrame:
    return loans.where(overdue("dueDate", as_of))


def loans_by_borrower(loans: DataFrame, borrower: str) -> DataFrame:
    return loans.where(F.col("borrowerId") == borrower)


def media_by_type(media: DataFrame, kind: str) -> DataFrame:
    return media.where(F.col("type") == kind)


def owner_of(media: DataFrame, barcode: str, ordinal: str = "id") -> DataFrame:
    """The first resource with a copy of a scanned barcode, and that copy as the catalogue spells it."""
    hits = exploded(media, "K2", "id", "title", "resourceBox").where((F.lower("copy") == barcode.lower()) & (F.col("copy") != ""))
    return hits.orderBy(ordinal).limit(1)


def loan_of(loans: DataFrame, barcode: str, ordinal: str = "id") -> DataFrame:
    """The first loan of a scanned barcode."""
    return loans.where(F.lower(X.text("barcode")) == barcode.lower()).orderBy(ordinal).limit(1)


def in_catalogue(media: DataFrame, scanned: DataFrame) -> DataFrame:
    """Of scanned barcodes, those that the catalogue has, without regard to case."""
    known = media.select(F.explode(F.transform(tokens("barcodes"), lambda x: F.lower(X.trim(x)))).alias("known")).distinct()
    return scanned.join(known, F.lower("barcode") == F.col("known"), "left_semi")


def members_by(borrowers: DataFrame, column: str, as_of: Day = None, ascending: bool = True) -> DataFrame:
    """Members sorted by name or by date (blank and unreadable dates last)."""
    m = borrowers.withColumn("status", membership("expiryDate", as_of))
    key = parse(column) if column in ("expiryDate", "memberSince") else F.expr(f"coalesce({column}, '') collate UNICODE")
    return m.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), "id")


def loans_by(loans: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    key = parse(column) if column in ("checkoutDate", "dueDate") else F.expr(f"coalesce({column}, '') collate UNICODE")
    return loans.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), "id")


def search_loans(loans: DataFrame, query: str, only_overdue: bool = False, as_of: Day = None) -> DataFrame:
    """Loans by member, title or barcode, with a status: overdue, or else on-time (our label)."""
    out = loans.where(X.any_contains(["borrowerName", "borrowerId", "title", "barcode"], query))
    out = out.withColumn("status", F.when(overdue("dueDate", as_of), "overdue").otherwise("on-time"))
    return out.where("status = 'overdue'") if only_overdue else out


def barcode_typeahead(media: DataFrame, prefix: str) -> DataFrame:
    """Barcodes that start with what was typed; case does not matter (our choice)."""
    return barcodes(media).where(F.lower("barcode").startswith(prefix.lower()))


def autocomplete(borrowers: DataFrame, query: str, as_of: Day = None) -> DataFrame:
    """Members for the checkout dialogue; expired ones are dimmed."""
    m = search_members(borrowers, query, as_of)
    return m.select("id", "name", "email", (F.col("status") == "expired").alias("dimmed"))
