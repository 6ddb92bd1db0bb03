"""Many commands at once do what single ones do one after another."""

import random

from shelfspark.plans import commands, desk
from shelfspark.schemas import BORROWERS, MEDIA
from shelfspark.sources import store
from shelfspark.sources.tables import Config, backfill, initialise_headers
from tests.test_edges import DAY, loans, media


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_commands_see_what_earlier_ones_did(spark):
    m = media(spark, {"id": "M1", "title": "T", "barcodes": "Ab1|A2"}, {"id": "M2", "title": "U", "barcodes": "B1", "resourceBox": '{"B1":"Q"}'})
    on = loans(spark, {"barcode": "A2", "dueDate": "March 1, 2026", "title": "T"})
    todo = spark.createDataFrame([(1, "AB1"), (2, "ab1"), (3, "b1"), (4, "zz"), (5, "a2")], "seq long, scanned string").selectExpr("*", "'B1' as borrowerId", "'n' as borrowerName")
    done = desk.checkouts_by_barcode(m, on, todo, DAY)
    taken = commands.SAYS["taken"]
    assert [r[1:] for r in rows(done.outcomes, "seq", "success", "error", "notFound")] == [
        (True, None, False), (False, taken, False), (False, '"U" (B1) is inside box "Q" (Q). Check out the box instead.', False), (False, "Barcode zz not found in catalog", True), (False, taken, False)
    ]
    assert rows(done.state, "barcode") == [("A2",), ("Ab1",)] and done.audit.count() == 1
    back = spark.createDataFrame([(1, "a2"), (2, "A2"), (3, "zz")], "seq long, scanned string")
    done = desk.returns_by_barcode(m, on, back, DAY)
    assert rows(done.outcomes, "seq", "error") == [(1, None), (2, "No active loan found for barcode A2"), (3, "No active loan found for barcode zz")] and done.state.count() == 0
    more = desk.extensions_by_barcode(m, on, back, DAY)
    assert rows(more.outcomes, "seq", "newDueDate") == [(1, "March 22, 2026"), (2, "April 12, 2026"), (3, None)]
    left, done = desk.deletions(m, on, spark.createDataFrame([(1, "M1"), (2, "M1"), (3, "M9")], "seq long, resource string"), DAY)
    assert rows(done.outcomes, "seq", "success", "loansDeleted") == [(1, True, 1), (2, False, 0), (3, False, 0)] and rows(left, "id") == [("M2",)]
    assert done.state.count() == 0 and done.audit.count() == 2


def test_as_single_commands(spark):
    """Outcomes of random scans are those of the desk, one at a time."""
    r = random.Random(4)
    m = media(spark, *[{"id": f"M{i}", "title": f"T{i}", "barcodes": "|".join(f"C{i}x{k}" for k in range(i % 4)), "resourceBox": f'{{"C{i}x0":"C1x0"}}' if i % 3 == 0 else ""} for i in range(8)])
    on = loans(spark, *[{"barcode": f"C{i}x0", "dueDate": f"March {i}, 2026", "title": f"T{i}", "borrowerName": "n"} for i in (1, 2, 3, 6)])
    scans = [(k, r.choice([f"c{r.randrange(9)}X{r.randrange(3)}", f"C{r.randrange(9)}x0"])) for k in range(8)]
    todo = spark.createDataFrame(scans, "seq long, scanned string").selectExpr("*", "'B1' as borrowerId", "'n' as borrowerName")
    for bulk, single in (
        (desk.checkouts_by_barcode, lambda d, s: d.checkout_by_barcode("B1", s, "n")), (desk.returns_by_barcode, lambda d, s: d.return_by_barcode(s)), (desk.extensions_by_barcode, lambda d, s: d.extend_by_barcode(s)),
    ):
        done = bulk(m, on, todo, DAY)
        d = commands.Desk(spark.createDataFrame([], BORROWERS), m, on, "me", DAY)
        want = []
        for k, s in scans:
            d, out = single(d, s)
            want.append((k, out["success"], out.get("error")))
        assert rows(done.outcomes, "seq", "success", "error") == want
        assert rows(done.state, "barcode", "dueDate") == rows(d.loans, "barcode", "dueDate")


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 as k").repartition(7)
    got = {x["k"]: x["rank"] for x in store.numbered(df.orderBy("k")).collect()}
    assert got == {k: k + 1 for k in range(1000)}
    assert store.numbered(df.where("id < 0").orderBy("k")).count() == 0


def test_headers_backfill_and_audit_location(spark, tmp_path):
    m = media(spark, {"id": "M1", "title": "T"})
    m.drop("id").write.parquet(str(tmp_path / "old"))
    c = Config()
    c.set("MEDIA_ID", str(tmp_path / "old"))
    out = initialise_headers(spark, c)
    assert not out["Media"]["success"] and out["Loans"]["error"] == "Loans is not configured"
    assert backfill(spark, c, str(tmp_path / "new")) == {"success": True, "rowsUpdated": 1}
    assert backfill(spark, c, str(tmp_path / "more")) == {"success": True, "rowsUpdated": 0}
    assert initialise_headers(spark, c)["Media"] == {"success": True} and c.open(spark, "Media").columns == MEDIA.names
    assert not backfill(spark, Config(), str(tmp_path / "x"))["success"]
    assert c.audit() is None
    c.set_audit("/somewhere")
    assert c.audit() == "/somewhere"
