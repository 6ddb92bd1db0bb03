"""Copies of a resource, and the four ways in which barcodes are compared. They differ on purpose: do not unify them.

K1  raw: tokens and loans as they are; blank tokens count
K2  tokens trimmed, blank ones dropped, case matters; loans as they are
K3  tokens and loans trimmed and in lower case; blank tokens dropped
K4  scan look-up: tokens trimmed and in lower case, loans and the scanned text in lower case only
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import text, trim


def tokens(barcodes: Column | str) -> Column:
    return F.split(text(barcodes), "[|]")


def k1_copies(barcodes: Column | str) -> Column:
    return tokens(barcodes)


def k2_copies(barcodes: Column | str) -> Column:
    return F.filter(F.transform(tokens(barcodes), trim), lambda x: x != "")


def k3_copies(barcodes: Column | str) -> Column:
    return F.transform(k2_copies(barcodes), F.lower)


def k4_copies(barcodes: Column | str) -> Column:
    return F.transform(tokens(barcodes), lambda x: F.lower(trim(x)))


def k1_loan(barcode: Column | str) -> Column:
    return text(barcode)


k2_loan = k1_loan


def k3_loan(barcode: Column | str) -> Column:
    return F.lower(trim(text(barcode)))


def k4_loan(barcode: Column | str) -> Column:
    return F.lower(text(barcode))


COPIES = {"K1": k1_copies, "K2": k2_copies, "K3": k3_copies, "K4": k4_copies}
LOAN = {"K1": k1_loan, "K2": k2_loan, "K3": k3_loan, "K4": k4_loan}


def exploded(media: DataFrame, variant: str = "K2", *columns: str) -> DataFrame:
    """One row for each copy with its key; resources without one are left out."""
    return media.select(*columns, F.explode(COPIES[variant]("barcodes")).alias("copy"))


def loaned(loans: DataFrame, variant: str = "K2") -> DataFrame:
    """The distinct keys on loan."""
    return loans.select(LOAN[variant]("barcode").alias("copy")).distinct()
