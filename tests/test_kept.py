"""What is kept and changed in parts equals what is computed anew."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.text import any_contains
from shelfspark.operators import availability as A
from shelfspark.operators import ids
from shelfspark.plans import commands, desk, kept, postings
from shelfspark.schemas import BORROWERS, LOANS, MEDIA
from shelfspark.sources import fixtures as S
from shelfspark.sources import parts
from shelfspark.sources import tables as T
from shelfspark.sources.parts import PART, Parts, indexed
from tests.test_edges import DAY, loans, media
from tests.test_mixed import frozen


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


# ---- parts ----


def test_an_update_rewrites_one_part(spark, tmp_path):
    m = media(spark, *[{"id": f"M{i}", "title": f"T{i}", "barcodes": f"C{i}"} for i in range(300)])
    p = Parts(spark, str(tmp_path / "media"), MEDIA, n=16).create(m)
    assert rows(p.read()) == rows(m)
    before = files(p.path)
    touched = p.upsert(media(spark, {"id": "M7", "title": "new"}))
    after = files(p.path)
    assert len(touched) == 1 and {f.split("/")[0] for f in before ^ after} == {f"{PART}={touched[0]}"}
    assert len(before - after) == len(after - before) == 1
    assert p.find("M7").first()["title"] == "new" and p.read().count() == 300 and p.find("none").count() == 0
    # rows that go: a part that holds nothing more has no files
    own = [r["id"] for r in p.read(touched).collect()]
    gone = spark.createDataFrame([(i,) for i in own], "id string")
    assert p.upsert(m.limit(0), gone) == touched and p.read(touched).count() == 0 and p.read().count() == 300 - len(own)
    assert files(p.path) == {f for f in before if not f.startswith(f"{PART}={touched[0]}/")}
    p.insert(media(spark, {"id": "M7", "title": "back"}))
    assert p.find("M7").first()["title"] == "back" and len(files(p.path) - before) == 1


def test_parts_read_one_part(spark, tmp_path):
    p = Parts(spark, str(tmp_path / "m"), MEDIA, n=8).create(media(spark, *[{"id": f"M{i}"} for i in range(50)]))
    plan = p.find("M3")._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull({PART}" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,M3)]" in plan
    assert Parts(spark, str(tmp_path / "none"), MEDIA).read().count() == 0


# ---- counts ----


def test_kept_counts_after_batches(spark, tmp_path):
    """Five batches of commands, then resources that change: stored counts are those of a fresh count, and a commit may come again."""
    r = random.Random(2)
    m = media(spark, *[{"id": f"M{i}", "title": f"T{i}", "barcodes": "|".join(f"C{i * 3 // 2}x{k}" for k in range(i % 4)) + "|" * (i % 3)} for i in range(30)])
    on = loans(spark, *[{"id": f"L{i}", "barcode": f"C{i}x{i % 3}", "dueDate": "March 9, 2026"} for i in range(20)])
    for variant in ("K3",):
        k = kept.KeptCounts(spark, str(tmp_path / variant), variant, n=8).create(m, on)
        now, rewritten = on, 0
        for number in range(1, 6):
            todo = [(n, r.choice(["checkout", "return", "extend"]), f"C{r.randrange(45)}x{r.randrange(3)}") for n in range(12)]
            out = commands.circulate(now, spark.createDataFrame(todo, "seq long, op string, barcode string"), DAY)
            rewritten += len(k.commit_loans(number, out.before, out.after))
            assert k.commit_loans(number, out.before, out.after) == [] and k.done == number
            now = spark.createDataFrame(out.loans.collect(), LOANS)
            assert rows(k.counts.read(), "id", "copies", "availableCount") == rows(A.counts(m, now, variant), "id", "copies", "availableCount")
        assert 0 < rewritten < 5 * 8
        old = m.where("id in ('M3', 'M4', 'M7')")
        new = media(spark, {"id": "M3", "barcodes": "C4x0|N1|N1"}, {"id": "M4", "barcodes": ""}, {"id": "M99", "barcodes": "C1x0|C9x9"})
        k.commit_media(6, old, new)
        again = m.join(old.select("id"), "id", "left_anti").select(*MEDIA.names).unionByName(new)
        assert rows(k.counts.read(), "id", "copies", "availableCount") == rows(A.counts(again, now, variant), "id", "copies", "availableCount")
        assert rows(k.status()) == rows(A.status(again, now, variant))


def test_kept_counts_where_rows_share_an_id(spark, tmp_path):
    """Commits that change, add and delete one of several rows of an id; loans come and go between them."""
    m = media(spark, {"id": "M1", "title": "a", "barcodes": "A|B"}, {"id": "M1", "title": "b", "barcodes": "A"}, {"id": "M1", "title": "c"}, {"id": "M2", "barcodes": "A|C"})
    on = loans(spark, {"id": "L1", "barcode": "A"})
    k, now = kept.KeptCounts(spark, str(tmp_path / "k"), n=4).create(m, on), on
    b, c, none = m.where("title = 'b'"), m.where("title = 'c'"), m.limit(0)
    changes = [(b, media(spark, {"id": "M1", "title": "b", "barcodes": "B|B|D"})), (c, none), (none, media(spark, {"id": "M1", "title": "d", "barcodes": "C"}, {"id": "M3"}, {"id": "M3", "barcodes": "D"})), (m.where("id = 'M2'"), none)]
    for n, (before, after) in enumerate(changes):
        m = spark.createDataFrame(m.exceptAll(before).unionByName(after).collect(), MEDIA)
        k.commit_media(2 * n + 1, before, after)
        assert rows(k.counts.read()) == rows(A.counts(m, now, "K2")), n
        out = loans(spark, {"id": f"N{n}", "barcode": "ABCD"[n]})
        k.commit_loans(2 * n + 2, now, out)
        now = out
        assert rows(k.counts.read()) == rows(A.counts(m, now, "K2")), n
    assert k.commit_media(2 * n + 1, none, m) == [] and k.owners.read().where("copy in ('A', 'D')").count() == 3


def test_a_commit_that_failed_is_completed(spark, tmp_path, monkeypatch):
    m, on = media(spark, {"id": "M1", "barcodes": "A|B"}), loans(spark, {"id": "L1", "barcode": "A"})
    k = kept.KeptCounts(spark, str(tmp_path / "k"), n=4).create(m, on)
    after = loans(spark, {"id": "L2", "barcode": "B"})
    whole = k.counts.upsert
    monkeypatch.setattr(k.counts, "upsert", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        k.commit_loans(1, on, after.unionByName(on))
    monkeypatch.setattr(k.counts, "upsert", whole)
    k.commit_loans(1, on, after.unionByName(on))
    assert rows(k.counts.read()) == [("M1", 2, 0)] and rows(k.keys.read()) == [("A", 1), ("B", 1)]
    # made anew at the same place, it knows of no commit
    k.create(m, on)
    assert k.done == 0 and len(k.commit_loans(1, on, on.limit(0))) == 1 and rows(k.counts.read()) == [("M1", 2, 2)]


# ---- postings ----


def test_search_through_postings_is_the_scan(spark, sf_dir, tmp_path):
    """Random pieces of one to eight characters of members' names and addresses, in any case, and some that nothing has."""
    r = random.Random(6)
    b = S.borrowers(spark, sf_dir).cache()
    p = postings.Postings(spark, str(tmp_path / "p"), BORROWERS, ["name", "email"], n=8).create(b)
    values = [v for x in b.select("name", "email").collect() for v in x]
    for n in range(1, 9):
        for _ in range(1):
            v = r.choice(values)
            at = r.randrange(max(1, len(v) - n))
            q = r.choice([str.upper, str.lower, str])(v[at : at + n])
            assert rows(p.search(q), "id") == rows(b.where(any_contains(["name", "email"], q)), "id"), q
    for q in ("", "zzz", "#0000000001 ", "example.orgx"):
        assert rows(p.search(q), "id") == rows(b.where(any_contains(["name", "email"], q)), "id"), q
    plan = p.hits("customer#000000012")._jdf.queryExecution().optimizedPlan().toString()
    assert PART in plan
    changed = b.limit(3).withColumn("name", F.lit("Änderung Zoë"))
    p.upsert(changed)
    assert rows(p.search("ÄNDER"), "name") == [("Änderung Zoë",)] * 3 == rows(p.search("zoë"), "name")
    gone = b.limit(1).first()["name"]
    assert p.search(gone).count() == b.where(any_contains(["name", "email"], gone)).count() - 1


# ---- ids and saves ----


def test_ids_are_a_permutation(spark):
    n = 300_000
    df = spark.range(n).select("id", ids.numbered_id("M", "id").alias("x")).union(spark.range(0, ids.ALL, 999_983_111).select("id", ids.numbered_id("M", "id")))
    got = df.agg(F.count_distinct("x").alias("distinct"), F.count_if(F.col("x").rlike(r"^M\d{5}[A-Z]\d{4}$")).alias("shaped"), F.count_if(ids.number_of("M", "x") == F.col("id")).alias("back"), F.count_distinct("id").alias("n"), F.count("*").alias("all")).first()
    assert got["distinct"] == got["n"] and got["shaped"] == got["back"] == got["all"]
    odd = spark.createDataFrame([("M1",), (None,), ("L00000A0000",), ("M00000a0000",), ("M00000A0000 ",)], "x string")
    assert odd.where(ids.number_of("M", "x").isNotNull()).count() == 0
    assert spark.range(5).where(ids.numbered_id("M", "id", "one") == ids.numbered_id("M", "id", "two")).count() == 0


def test_new_ids_pass_over_those_that_are_there(spark):
    known = spark.range(0, 90, 3).select(ids.numbered_id("L", "id").alias("id")).union(spark.createDataFrame([("L1",), (None,)], "id string"))
    new = spark.range(100).selectExpr("id * 7 % 100 as seq", "'x' as title")
    got = ids.identified(new, "seq", known, "L").select("seq", ids.number_of("L", "id").alias("n")).collect()
    free = [n for n in range(200) if n >= 90 or n % 3][:100]
    assert sorted((r["seq"], r["n"]) for r in got) == list(enumerate(free))
    assert ids.identified(new.limit(0), "seq", known, "L").count() == 0


def test_patches_of_one_row_add_up(spark):
    """Random patches of several rows and columns, by bulk and one after another."""
    r = random.Random(7)
    b = spark.createDataFrame([(f"B{i}", f"name {i}", *[""] * 8) for i in range(4)], BORROWERS)
    cols = ["name", "email", "phone", "memberSince"]
    todo = [(n, r.choice(["B0", "B1", "B2", "B7", ""]), {c: f"{c} {n}" if r.random() < 0.9 else "" for c in cols if r.random() < 0.5}) for n in range(14)]
    d = commands.Desk(b, spark.createDataFrame([], MEDIA), spark.createDataFrame([], LOANS))
    want = []
    for _, i, patch in todo:
        d, out = d.save("Borrowers", patch | {"id": i})
        d = frozen(spark, d)
        want.append((out["success"], out.get("error")))
    table = spark.createDataFrame([(n, i, *[p.get(c) for c in cols]) for n, i, p in todo], "seq long, id string, " + ", ".join(f"{c} string" for c in cols))
    done = desk.saves(b, "Borrowers", table)
    assert [tuple(x) for x in done.outcomes.orderBy("seq").select("success", "error").collect()] == want
    show = lambda df: sorted((x["id"] if len(x["id"]) < 3 else "new", *x[1:]) for x in df.collect())
    assert show(done.state) == show(d.borrowers)
    assert rows(done.audit, "action") == sorted((a,) for _, a in d.audit)


def test_loans_of_one_id(spark):
    """A return takes its own copy's loan; another loan of that id stays."""
    on = loans(spark, {"id": "L1", "barcode": "A"}, {"id": "L1", "barcode": "C"})
    out = commands.circulate(on, spark.createDataFrame([(1, "return", "A")], "seq long, op string, barcode string"), DAY)
    assert rows(out.loans, "id", "barcode") == [("L1", "C")] and rows(out.before, "barcode") == [("A",)] and out.after.count() == 0




# ---- look-ups and files ----


def test_a_look_up_skips_row_groups(spark, tmp_path):
    """Keys in no order, so that only Bloom filters can tell which row groups lack one."""
    path = str(tmp_path / "t")
    indexed(spark.range(150_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("key")).coalesce(1), "key", row_group=1 << 20).parquet(path)
    key = spark.range(1).select(F.sha2(F.lit("777"), 256)).first()[0]
    for wanted, rows_ in ((key, [777]), ("0" * 64, [])):
        df = spark.read.parquet(path).where(F.col("key") == wanted).select("id", "key")
        assert [r["id"] for r in df.collect()] == rows_
        scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().get("numOutputRows").get().value() < 50_000


def test_files_of_a_folder(spark, tmp_path):
    """Newest by prefix, ties by path; names with characters that mean something in a glob; content is not read."""
    for name, at in (("Media 2023.csv", 100), ("Media b.csv", 300), ("below/Media a.csv", 300), ("My Media.csv", 900), ("Loans [x]{y} *1%.csv", 5), ("Loans x.csv", 9)):
        p = tmp_path / "f" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("id,title\nM1,t\n")
        os.utime(p, (at, at))
    found = T.listing(spark, str(tmp_path / "f"), ["Media", "Loans [x]{y} *"])
    assert {r["name"] for r in found.collect()} == {"Media 2023.csv", "Media b.csv", "Media a.csv", "Loans [x]{y} *1%.csv"}
    assert T.listing(spark, str(tmp_path / "f")).count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp>" in plan
    best = T.newest(T.listing(spark, str(tmp_path / "f"), ["Media"]), ["Media"]).first()
    assert best["spreadsheetName"] == "Media b.csv" and best["spreadsheetId"].endswith("/f/Media b.csv")  # "Media b" is before "below" by path
    assert T.first_of(spark, str(tmp_path / "f")).endswith("Loans [x]{y} *1%.csv")


def test_a_header_is_put_in(spark, tmp_path):
    c = T.Config()
    assert T.ensure_headers(spark, c, "Loans", str(tmp_path / "x"))["error"] == "Loans is not configured"
    (tmp_path / "loans.csv").write_text('L1,A1,"a, b",,"March 5, 2026",n,B1\nL2,A2,,,,,\n')
    c.set("LOANS_ID", str(tmp_path / "loans.csv"))
    assert T.ensure_headers(spark, c, "Loans", str(tmp_path / "with")) == {"success": True, "inserted": True}
    assert T.ensure_headers(spark, c, "Loans", str(tmp_path / "again")) == {"success": True, "inserted": False}
    assert rows(c.open(spark, "Loans"), "id", "title", "dueDate") == [("L1", "a, b", "March 5, 2026"), ("L2", "", "")]
    loans(spark, {"id": "L5"}).toDF(*"abcdefg").write.parquet(str(tmp_path / "p"))
    c.set("LOANS_ID", str(tmp_path / "p"))
    assert T.ensure_headers(spark, c, "Loans", str(tmp_path / "q"))["inserted"] and c.raw(spark, "Loans").columns == LOANS.names and c.open(spark, "Loans").count() == 1


def test_large_parts_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """No file has many more rows than a task's share, also where all rows have one key; rows are found and replaced as before."""
    monkeypatch.setattr(parts, "TASK_ROWS", 50)
    schema = "gram string, id string"
    rows = spark.range(1000).selectExpr("if(id < 900, 'abc', concat('g', id)) as gram", "cast(id as string) as id")
    p = parts.Parts(spark, str(tmp_path / "p"), rows.schema, "gram", n=4).create(rows)
    sizes = spark.read.parquet(p.path).groupBy("_metadata.file_path").count().collect()
    assert sum(x["count"] for x in sizes) == 1000 and max(x["count"] for x in sizes) < 150
    assert p.find("abc").count() == 900 and [x["id"] for x in p.find("g950").collect()] == ["950"]
    p.insert(spark.createDataFrame([("abc", "more")] * 2, schema))
    assert p.find("abc").count() == 902
    p.upsert(spark.createDataFrame([("abc", "one")], schema))
    assert [x["id"] for x in p.find("abc").collect()] == ["one"] and p.read().count() == 101


def test_a_sheet_is_written_from_rows_that_many_tasks_made(spark, tmp_path):
    from pyspark import TaskContext

    from shelfspark.plans.registry_state import _sheet

    tasks = spark.sparkContext.accumulator(0)

    def made(batches):
        tasks.add(TaskContext.get().partitionId())
        yield from batches

    rows = spark.range(100, numPartitions=4).selectExpr("cast(id as string) as id").mapInPandas(made, "id string")
    path = _sheet(rows, str(tmp_path / "x" / "Sheet1.csv"))
    assert tasks.value == 6
    assert sorted(x["id"] for x in spark.read.option("header", True).csv(path).collect()) == sorted(map(str, range(100)))
