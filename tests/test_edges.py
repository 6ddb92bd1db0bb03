"""Hand-written rows for the rules that the driver's tables do not exercise (FIXTURES.md, section 5)."""

import re

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import dates as D
from shelfspark.functions import edge
from shelfspark.functions import text as X
from shelfspark.operators import availability as A
from shelfspark.operators import boxes
from shelfspark.operators import classification as C
from shelfspark.operators import rows as R
from shelfspark.plans import commands
from shelfspark.plans import queries as Q
from shelfspark.schemas import BORROWERS, LOANS, MEDIA, NO_CLASSIFICATION, UNCLASSIFIED
from shelfspark.sources import store
from shelfspark.sources import tables as T

DAY = "2026-03-05"


def media(spark, *rows):
    return spark.createDataFrame([tuple((dict(zip(MEDIA.names, [""] * 7)) | r).values()) for r in rows], MEDIA)


def loans(spark, *rows):
    return spark.createDataFrame([tuple((dict(zip(LOANS.names, [""] * 7)) | {"id": f"L{i}"} | r).values()) for i, r in enumerate(rows)], LOANS)


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "barcodes, loan, k1, k2, free_k3",
    [("B4|", "B4", "available", "on-loan", 0), ("ab1", "AB1", "available", "available", 0), ("X1", " X1 ", "available", "available", 0), ("B4", "B4", "on-loan", "on-loan", 0), (" B4 | B5", "B4", "available", "available", 1)],
)
def test_key_variants_differ(spark, barcodes, loan, k1, k2, free_k3):
    m, on = media(spark, {"id": "M1", "barcodes": barcodes}), loans(spark, {"barcode": loan})
    assert one(A.two_state_status(m, on)) == [("M1", k1)]
    assert one(A.status(m, on, "K2")) == [("M1", k2)]
    assert one(A.counts(m, on, "K3").select("availableCount")) == [(free_k3,)]


def test_no_barcodes(spark):
    m, on = media(spark, {"id": "M1", "title": "t", "barcodes": ""}), loans(spark)
    assert one(Q.search_media(m, on, "t").select("status")) == [("no-copies",)]
    assert one(Q.all_media(m, on)) == []
    assert one(Q.search_available_copies(m, on, "t")) == [("M1", "", "t")]


def test_dates(spark):
    df = spark.createDataFrame([("March 5, 2026",), ("March 4, 2026",), ("2026-03-04",), ("February 30, 2026",), ("soon",), ("",), (None,), ("March 6, 2026",)], "d string")
    got = [tuple(r) for r in df.select(D.overdue("d", DAY), D.not_yet_due("d", DAY), D.membership("d", DAY)).collect()]
    assert got == [(False, True, "expired"), (True, False, "expired"), (True, False, "expired"), *[(False, False, "expired")] * 4, (False, True, "active")]
    assert df.select(D.later("d", 21)).first()[0] == "March 26, 2026"


def test_trim_takes_all_white_space(spark):
    assert spark.createDataFrame([("\t  a b﻿\n",)], "s string").select(X.trim(F.col("s"))).first()[0] == "a b"


def test_classification(spark):
    df = spark.createDataFrame([("DVD F 060",), ("ELT Magazine CD",), (" kids ",), ("",), (None,), ("XZ 12",)], "c string")
    pick = lambda v: [r[0] for r in df.select(C.selected("c", v)).collect()]
    assert pick("DVD F") == [True, False, False, False, False, False]
    assert pick("ELT Magazine") == [False] * 6
    assert pick("Kids") == [False, False, True, False, False, False]
    assert pick(NO_CLASSIFICATION) == [False, False, False, True, True, False]
    assert pick(UNCLASSIFIED) == [False] * 5 + [True]


def test_blank_searches(spark):
    m, on = media(spark, {"id": "M1"}), loans(spark)
    people = spark.createDataFrame([("B1", "Ann", *[""] * 8), ("B2", None, *[""] * 8)], BORROWERS)
    assert Q.search_media(m, on).count() == 0 and Q.find_available(m, on, " ").count() == 0
    assert Q.search_members(people, "").count() == 2 and Q.search_members(people, "ANN").count() == 1


def test_members_sort_like_a_dictionary(spark):
    people = spark.createDataFrame([(n, n, *[""] * 8) for n in ["Zed", "eva", "Émile", "adam", "Eve"]], BORROWERS)
    assert [r["name"] for r in Q.members(people, DAY).collect()] == ["adam", "Émile", "eva", "Eve", "Zed"]


def test_boxes(spark):
    m = media(
        spark,
        {"id": "M1", "barcodes": "A|B", "resourceBox": '{"A":"X1","B":5}'}, {"id": "M2", "title": "Box", "barcodes": " X1 "}, {"id": "M3", "resourceBox": '["x"]'},
        {"id": "M4", "resourceBox": "nope"}, {"id": "M5", "resourceBox": '{"C":"gone"}'}, {"id": "M6", "resourceBox": '{"D":"X1","D":"gone"}'}, {"id": "M7", "resourceBox": '{"E":""}'},
    )
    assert sorted(one(boxes.containing(m))) == [("M1", "A", "X1", "Box"), ("M5", "C", "gone", "gone"), ("M6", "D", "gone", "gone")]


def desk(spark, m, on):
    return commands.Desk(spark.createDataFrame([], BORROWERS), m, on, "me@x", DAY)


def test_checkout_by_barcode(spark):
    m = media(spark, {"id": "M1", "title": "T", "barcodes": "Ab1| A2 |A3", "resourceBox": '{"A3":"Q"}'})
    d = desk(spark, m, loans(spark, {"barcode": "A2"}))
    assert d.checkout_by_barcode("B1", "zz", "n")[1] == {"success": False, "notFound": True, "error": "Barcode zz not found in catalog"}
    assert "inside box" in d.checkout_by_barcode("B1", "a3", "n")[1]["error"]
    assert d.checkout_by_barcode("B1", "a2", "n")[1] == {"success": False, "error": "Media item is not available for checkout"}
    after, out = d.checkout_by_barcode("B1", "AB1", "n")
    assert out["success"] and len(after.audit) == 1
    row = after.loans.where("barcode = 'Ab1'").first()
    assert (row["checkoutDate"], row["dueDate"], row["title"]) == ("March 5, 2026", "March 26, 2026", "T")
    assert re.fullmatch(r"L\d{5}[A-Z]\d{4}", row["id"])


@pytest.mark.parametrize("barcodes, says", [("A1", "No copies"), ("A1|A2", None), ("A1|A2|A3", "There are 2 copies")])
def test_checkout_by_resource(spark, barcodes, says):
    d = desk(spark, media(spark, {"id": "7", "title": "T", "barcodes": barcodes}), loans(spark, {"barcode": " a1 "}))
    after, out = d.checkout_by_resource("B1", 7, "n")
    assert (out["success"], out.get("barcode")) == (True, "A2") if says is None else out["error"].startswith(says)
    assert d.checkout_by_resource("B1", 8, "n")[1]["error"] == "Resource not found"


def test_return_and_extend(spark):
    m = media(spark, {"id": "M1", "barcodes": "A1|A2", "resourceBox": '{"A2":"Q"}'})
    d = desk(spark, m, loans(spark, {"barcode": "A1", "dueDate": "March 1, 2026"}, {"barcode": "A2"}))
    after, out = d.extend_by_barcode("a1")
    assert out["newDueDate"] == "March 22, 2026"
    after, out = after.return_by_barcode("a1")
    assert out["success"] and after.loans.count() == 1 and len(after.audit) == 2
    assert "Return the box instead" in d.return_by_barcode("A2")[1]["error"]
    assert d.return_by_barcode("zz")[1]["error"] == "No active loan found for barcode zz"
    assert d.extend_by_barcode("zz")[1]["error"] == "Barcode zz not found in catalog"
    assert after.extend_by_barcode("A1")[1]["error"] == "Barcode A1 is not currently checked out"
    after, out = d.return_by_id("none")
    assert not out["success"] and len(after.audit) == 1


def test_delete_media(spark):
    m = media(spark, {"id": "M1", "title": "T", "barcodes": "A1|A2|A3"})
    old, now, odd = {"barcode": "A1", "dueDate": "March 4, 2026"}, {"barcode": "A2", "dueDate": "March 5, 2026"}, {"barcode": "A3", "dueDate": "soon"}
    d = desk(spark, m, loans(spark, old, now))
    after, out = d.delete_media("M1")
    assert out["error"].startswith('Cannot delete "T" — 1 copy is currently') and after.loans.count() == 2
    after, out = desk(spark, m, loans(spark, old, odd)).delete_media("M1")
    assert out["success"] and after.media.count() == 0 and one(after.loans.select("barcode")) == [("A3",)] and len(after.audit) == 2
    assert d.delete_media("M2")[1]["error"] == "Resource not found"


def test_save(spark):
    d = desk(spark, media(spark), loans(spark))
    d, out = d.save("Media", {"title": "New"})
    row = d.media.first()
    assert out["success"] and re.fullmatch(r"M\d{5}[A-Z]\d{4}", row["id"]) and row["author"] == ""
    d, out = d.save("Media", {"id": row["id"], "title": "Newer"})
    assert out["success"] and d.media.first()["title"] == "Newer" and d.audit[-1][1].startswith("updated media: Newer")
    assert not d.save("Media", {"id": "nope", "title": "x"})[1]["success"]
    assert len(d.user_error("x" * 600).audit[-1][1]) == len("error shown to user: ") + 500


def test_circulate_folds_in_order(spark):
    on = loans(spark, {"barcode": "A1", "dueDate": "March 1, 2026", "title": "T"})
    todo = spark.createDataFrame(
        [(1, "checkout", "A1"), (2, "return", "A1"), (3, "checkout", "A1"), (4, "extend", "A1"), (5, "return", "Z"), (6, "checkout", "B1"), (7, "checkout", "B1")], "seq long, op string, barcode string"
    )
    out = commands.circulate(on, todo, DAY)
    assert [(r["seq"], r["success"]) for r in out.outcomes.orderBy("seq").collect()] == [(1, False), (2, True), (3, True), (4, True), (5, False), (6, True), (7, False)]
    assert sorted((r["barcode"], r["dueDate"]) for r in out.loans.collect()) == [("A1", "April 16, 2026"), ("B1", "March 26, 2026")]
    assert out.audit.count() == 4
    assert out.loans.groupBy("barcode").count().where("count > 1").count() == 0


def test_resolve(spark):
    m = media(spark, {"id": "M1", "title": "T", "barcodes": "Ab1|A2", "resourceBox": '{"A2":"Q"}'})
    todo = spark.createDataFrame([(1, "aB1"), (2, "a2"), (3, "zz")], "seq long, barcode string")
    rows = {r["seq"]: r for r in commands.resolve(todo, m).collect()}
    assert (rows[1]["barcode"], rows[1]["error"]) == ("Ab1", None) and "inside box" in rows[2]["error"] and rows[3]["error"] == "Barcode zz not found in catalog"


def test_discovery_and_config(spark, tmp_path):
    files = spark.createDataFrame([("1", "Media old", 1), ("2", "Media new", 5), ("3", "My Media", 9), ("4", "Loans", 2), ("5", "Media new", 5)], "id string, name string, lastModified int")
    c = T.Config.load(str(tmp_path / "c.json"))
    assert c.master() is None
    out = T.discover(files, c, "2026-01-01T00:00:00.000Z")
    assert out["success"] and out["error"].startswith("Partial discovery") and c.location("Media") == "2" and c.location("Borrowers") is None
    c.set("AUDIT_LOG_ID", "a")
    T.Config.load(str(tmp_path / "c.json")).clear()
    assert T.Config.load(str(tmp_path / "c.json")).values == {"AUDIT_LOG_ID": "a"}
    assert not T.discover(files.limit(0), c, "")["success"]


def test_scan_by_position(spark, tmp_path):
    p = tmp_path / "loans.csv"
    p.write_text('any,thing,at,all,in,the,header\nL1,A1,"a, b",,"March 5, 2026",n,B1\n')
    row = T.scan_csv(spark, str(p), "Loans").first()
    assert (row["title"], row["checkoutDate"], row["dueDate"]) == ("a, b", "", "March 5, 2026")
    df = spark.sql("select 5 as a, 'x' as b, 't' as c, date'2026-03-05' as d, timestamp'2026-03-26 00:00:00' as e, null as f, 1 as g, 2 as extra")
    assert tuple(T.decode(df, "Loans").first()) == ("5", "x", "t", "March 5, 2026", "March 26, 2026", "", "1")
    with pytest.raises(ValueError):
        T.decode(df.select("a"), "Loans")
    assert T.Config({"LOANS_ID": str(tmp_path / "none")}).open(spark, "Loans") is None


def test_rows_with_equal_ids(spark):
    df = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", "c", 3)], "id string, title string, n int")
    assert [r["title"] for r in R.delete(df, "1", "n").orderBy("n").collect()] == ["b", "c"]
    assert [r["title"] for r in R.update(df, "1", {"title": "x"}, "n").orderBy("n").collect()] == ["x", "b", "c"]
    assert T.by_id(df, 1, "n").first()["title"] == "a"


def test_ids_and_backfill(spark):
    df = spark.range(50).select(X.new_id("M").alias("a"), X.new_id("").alias("b"))
    assert all(re.fullmatch(r"M\d{5}[A-Z]\d{4}", r["a"]) and len(r["b"]) == 36 for r in df.collect())
    m = media(spark, {"title": "t"})
    assert T.with_ids(m).columns == m.columns and T.with_ids(m.drop("id")).columns[0] == "id" and T.headers_match(m, "Media")


def test_response(spark):
    m, on = media(spark, {"id": "M1", "title": "é", "barcodes": "A"}), loans(spark)
    assert edge.decoded(edge.response(Q.media_json(m, on))) == [{"id": "M1", "title": "é", "barcodes": "A", "status": "available"}]


def test_store_and_audit(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path / "s"))
    assert s.version == 0
    s.save(Loans=loans(spark, {"barcode": "A"}), Media=media(spark))
    s.save(Loans=loans(spark))
    assert s.version == 2 and s.load("Loans").count() == 0 and s.load("Media").count() == 0
    d = desk(spark, media(spark), loans(spark)).user_error("m")
    store.append_audit(d.audit_rows(), str(tmp_path / "a"))
    store.append_audit(d.audit_rows(), str(tmp_path / "a"))
    assert store.read_audit(spark, str(tmp_path / "a")).count() == 2
