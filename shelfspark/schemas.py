"""Table schemas, in column order, and fixed reference data."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


BORROWERS = _strings("id", "name", "email", "phone", "gender", "address", "postcode", "borrowerType", "expiryDate", "memberSince")
MEDIA = _strings("id", "title", "author", "type", "classification", "barcodes", "resourceBox")
LOANS = _strings("id", "barcode", "title", "checkoutDate", "dueDate", "borrowerName", "borrowerId")
AUDIT = T.StructType([T.StructField("Timestamp", T.TimestampType()), T.StructField("User", T.StringType()), T.StructField("Action", T.StringType())])
TABLES = {"Borrowers": BORROWERS, "Media": MEDIA, "Loans": LOANS}
ID_PREFIX = {"Borrowers": "B", "Media": "M", "Loans": "L"}
#: Property names under which the tables' locations are configured.
PROPERTY = {"Borrowers": "BORROWERS_ID", "Media": "MEDIA_ID", "Loans": "LOANS_ID"}
LAST_DISCOVERY = "LAST_DISCOVERY_DATE"
AUDIT_LOCATION = "AUDIT_LOG_ID"

DATE_FORMAT = "MMMM d, yyyy"
TIME_ZONE = "Europe/Paris"
LOAN_DAYS = 21

#: The classifications on offer in their order, with what is shown for those that take all that starts with them.
CLASSIFICATIONS = [
    ("Bilingual", None), ("BIOG", None), ("CD", None), ("CF", None), ("DET", None),
    ("DVD C", "DVD – Classics"), ("DVD D", "DVD – Documentaries"), ("DVD F", "DVD – Film"), ("DVD K", "DVD – Kids"), ("DVD S", "DVD – Shakespeare"), ("DVD TV", "DVD – TV"),
    ("Easy Reader Level 1", None), ("Easy Reader Level 2", None), ("Easy Reader Level 3", None), ("Easy Reader Level 4", None), ("Easy Reader Level 5", None), ("Easy Reader Level 6", None),
    ("Easy Reader Starter Level", None), ("ELT Magazine", None), ("ELT Magazine CD", None), ("ELT Resource CD", None), ("ELT Resource Folder", None), ("ELT Resource Magazine", None),
    ("English Course", "English Course"), ("FAN", None), ("FSS", None), ("GEN", None), ("HF", None), ("HUM", None), ("JF", None), ("Kids", None), ("Literature", None), ("Magazine", None), ("RF", None),
]
PREFIX_CLASSIFICATIONS = {value: label for value, label in CLASSIFICATIONS if label}
EXACT_CLASSIFICATIONS = [value for value, label in CLASSIFICATIONS if not label]
NO_CLASSIFICATION, UNCLASSIFIED = "__NONE__", "__UNCLASSIFIED__"
