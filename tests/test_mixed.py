"""A table of commands of all kinds does what the desk does, one command after another."""

import random

import pytest

from shelfspark.plans import commands, mixed
from shelfspark.schemas import BORROWERS, MEDIA
from tests.test_edges import DAY, loans, media

TODO = "seq long, op string, target string, days int, cells map<string,string>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def single(d, op, target, days, cells):
    """One command on a Desk."""
    days = days or 21
    who = (cells or {}).get("borrowerId", ""), (cells or {}).get("borrowerName", "")
    row = {k: v for k, v in (cells or {}).items() if v is not None}
    return {
        "checkout": lambda: d.checkout(who[0], target, "", row.get("title", ""), who[1], days),
        "checkout_by_barcode": lambda: d.checkout_by_barcode(who[0], target, who[1], days),
        "checkout_by_resource": lambda: d.checkout_by_resource(who[0], target, who[1], days),
        "return": lambda: d.return_by_id(target),
        "return_by_barcode": lambda: d.return_by_barcode(target),
        "extend": lambda: d.extend(target, days),
        "extend_by_barcode": lambda: d.extend_by_barcode(target, days),
        "delete_media": lambda: d.delete_media(target),
        "save_media": lambda: d.save("Media", row | {"id": target}),
        "save_borrower": lambda: d.save("Borrowers", row | {"id": target}),
    }[op]()


def frozen(spark, d):
    """The desk's state without its plan, which grows with each command."""
    again = lambda df: spark.createDataFrame(df.collect(), df.schema)
    from dataclasses import replace

    return replace(d, borrowers=again(d.borrowers), media=again(d.media), loans=again(d.loans))


def both(spark, b, m, on, todo):
    d, want, audit = commands.Desk(b, m, on, "me", DAY), [], []
    for seq, op, target, days, cells in sorted(todo):
        n = len(d.audit)
        d, out = single(d, op, target, days, cells)
        d = frozen(spark, d)
        want.append((seq, out["success"], out.get("error")))
        audit += [(seq, a) for _, a in d.audit[n:]]
    got = mixed.run(b, m, on, spark.createDataFrame(todo, TODO), DAY)
    assert rows(got.outcomes, "seq", "success", "error") == sorted(want, key=str)
    assert rows(got.audit, "seq", "action") == sorted(audit, key=str)
    # ids of new rows are made in another way
    old = {r["id"] for r in on.collect()}
    show = lambda df: sorted((r["id"] if r["id"] in old else "new", *r[1:]) for r in df.collect())
    assert show(got.loans) == show(d.loans)
    known = {r["id"] for r in m.collect()} | {r["id"] for r in b.collect()}
    show = lambda df: sorted((r["id"] if r["id"] in known else "new", *r[1:]) for r in df.collect())
    assert show(got.media) == show(d.media) and show(got.borrowers) == show(d.borrowers)
    for df in (got.loans, got.media, got.borrowers):
        ids = [r["id"] for r in df.collect()]
        assert len(ids) == len(set(ids))
    return got


def library(spark, r):
    """Resources with up to three copies, some in boxes that are resources themselves, some on loan."""
    boxes = ["", "", "not json", '{"C1x0":"C2x0"}', '{"C3x1":"NOPE"}', '{"C5x0":"C4x0","C5x1":"C4x0"}']
    m = [{"id": f"M{i}", "title": f"T{i}" if i != 4 else "", "barcodes": " |".join(f"C{i}x{k}" for k in range(i % 4)), "resourceBox": boxes[i % 6]} for i in range(7)]
    m[6]["barcodes"] += "| C1x0"
    due = ["March 1, 2026", "March 4, 2026", "April 1, 2026", "soon"]
    on = [{"id": f"L{k}", "barcode": c, "dueDate": r.choice(due), "title": f"t{k}", "borrowerName": "n", "borrowerId": "B1"} for k, c in enumerate(r.sample(["C1x0", "C2x0", "C2x1", "C3x0", "C3x1", "C5x0", " C3x2", "ZZ"], 4))]
    b = spark.createDataFrame([("B1", "Ann", *[""] * 8), ("B2", "Bob", *[""] * 8)], BORROWERS)
    return b, media(spark, *m), loans(spark, *on)


def some(r, n):
    out = []
    for seq in r.sample(range(1000), n):
        op = r.choice(mixed.BARCODE * 2 + mixed.LOAN + mixed.RESOURCE * 2 + mixed.MEMBER)
        copy, who = r.choice([f"C{r.randrange(1, 7)}x{r.randrange(3)}", f"c{r.randrange(1, 7)}X0", "ZZ", "none"]), {"borrowerId": "B1", "borrowerName": "Ann"}
        if op in mixed.BARCODE:
            # of two loans whose barcodes differ in case the one with the smaller id is meant, and new ids differ
            target, cells = (copy.upper().replace("X", "x"), who | {"title": "given"}) if op == "checkout" else (copy, who)
        elif op in mixed.LOAN:
            target, cells = r.choice(["L0", "L1", "L2", "L3", "L9"]), None
        elif op == "save_media":
            target = r.choice(["", *[f"M{i}" for i in range(9)]])
            cells = {k: v for k, v in {"title": f"new {seq}", "barcodes": r.choice([copy, f"{copy}|C2x0", "", "N1|N2"]), "resourceBox": r.choice(["", f'{{"{copy}":"C2x0"}}', f'{{"C2x1":"{copy}"}}']), "author": "a"}.items() if r.random() < 0.5}
        elif op == "save_borrower":
            target, cells = r.choice(["", "B1", "B2", "B9"]), {k: f"{k} {seq}" for k in r.sample(["name", "email", "phone"], r.randint(1, 3))}
        else:
            target, cells = f"M{r.randrange(9)}", who
        out.append((seq, op, target, r.choice([None, 3, 30]), cells))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_commands(spark, seed):
    r = random.Random(seed)
    both(spark, *library(spark, r), some(r, 28))


def test_what_a_command_sees(spark):
    """A return before a checkout, a deletion between two checkouts, a box that is renamed and then deleted."""
    m = media(spark, {"id": "M1", "title": "T", "barcodes": "A1"}, {"id": "M2", "title": "Box", "barcodes": "X1"}, {"id": "M3", "title": "In", "barcodes": "I1", "resourceBox": '{"I1":"X1"}'}, {"id": "M4", "title": "Apart", "barcodes": "Q1"})
    on = loans(spark, {"id": "L1", "barcode": "A1", "dueDate": "March 1, 2026", "title": "T", "borrowerName": "n"}, {"id": "L2", "barcode": "Q1", "dueDate": "March 1, 2026"})
    who = {"borrowerId": "B1", "borrowerName": "Ann"}
    todo = [
        (1, "checkout_by_barcode", "a1", None, who), (2, "return_by_barcode", "a1", None, None), (3, "checkout_by_barcode", "A1", 7, who), (4, "extend_by_barcode", "a1", 7, None),
        (5, "checkout_by_barcode", "I1", None, who), (6, "save_media", "M2", None, {"title": "Chest"}), (7, "checkout_by_resource", "M3", None, who), (8, "delete_media", "M2", None, None), (9, "checkout_by_barcode", "i1", None, who),
        (10, "save_media", "M3", None, {"resourceBox": ""}), (11, "checkout_by_resource", "M3", None, who), (12, "delete_media", "M3", None, None), (13, "return", "L1", None, None), (14, "checkout", "Q1", None, who | {"title": "given"}),
    ]
    got = both(spark, spark.createDataFrame([], BORROWERS), m, on, todo)
    errors = {r["seq"]: r["error"] for r in got.outcomes.collect()}
    assert "inside box \"Box\"" in errors[5] and "inside box \"Chest\"" in errors[7] and "inside box \"X1\"" in errors[9]
    assert [k for k, v in errors.items() if v is None] and errors[12].startswith('Cannot delete "In"')


def test_nothing_to_do(spark):
    m, on = media(spark, {"id": "M1", "barcodes": "A1"}), loans(spark, {"barcode": "A1"})
    got = mixed.run(spark.createDataFrame([], BORROWERS), m, on, spark.createDataFrame([], TODO), DAY)
    assert got.media.columns == MEDIA.names and got.media.count() == 1 and got.loans.count() == 1 and got.outcomes.count() == got.audit.count() == 0
