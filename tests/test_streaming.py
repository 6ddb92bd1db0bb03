import random

from pyspark.sql import functions as F

from shelfspark.plans import commands
from shelfspark.schemas import AUDIT, LOANS
from shelfspark.sources import store
from shelfspark.sources.store import Snapshots, read_audit
from shelfspark.streaming import audit, circulation
from tests.test_edges import DAY, loans


def test_windows(spark, sf_dir):
    log = spark.createDataFrame([("2026-01-01 10:05:00", "u", "checked out x"), ("2026-01-01 10:50:00", "u", "checked out y"), ("2026-01-01 11:05:00", "u", "returned z")], "Timestamp string, User string, Action string")
    got = audit.actions_by_window(log.withColumn("Timestamp", F.to_timestamp("Timestamp"))).collect()
    assert sorted((r["kind"], r["n"]) for r in got) == [("checked", 2), ("returned", 1)]


def test_commands_from_a_stream(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    store.save(Loans=spark.createDataFrame([], LOANS))
    todo = "seq long, op string, barcode string"
    spark.createDataFrame([(1, "checkout", "A"), (2, "checkout", "A")], todo).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(todo).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        audit.circulate_stream(stream, store, str(tmp_path / "a"), str(tmp_path / "c"), "2026-03-05").awaitTermination()
    assert store.load("Loans").count() == 1 and read_audit(spark, str(tmp_path / "a")).count() == 1
    assert audit.audit_stream(spark, str(tmp_path / "a")).isStreaming


def test_keyed_state_is_the_batch_fold(spark, tmp_path):
    """Commands in three runs of a stream, each with a restart, do what one fold over all of them does."""
    r = random.Random(3)
    on = loans(spark, *[{"id": f"L{i}", "barcode": f"C{i}", "title": f"t{i}", "borrowerName": "n", "dueDate": d} for i, d in enumerate(["March 9, 2026", "soon", "2026-03-01", "April 1, 2026"])])
    kind = "seq long, op string, barcode string, days int, title string, borrowerId string, borrowerName string"
    todo = [(n, r.choice(["checkout", "return", "extend", "extend"]), f"C{r.randrange(7)}", r.choice([None, 3]), f"T{n}", "B1", "Ann") for n in range(40)]
    for n, part in enumerate((todo[:15], todo[15:16], todo[16:])):
        spark.createDataFrame(part, kind).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        circulation.start(stream, str(tmp_path / "out"), str(tmp_path / "c"), on, DAY).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == (15, 16, 40)[n]
    got, want = spark.read.parquet(str(tmp_path / "out")), commands.circulate(on, spark.createDataFrame(todo, kind), DAY)
    rows = lambda df, *c: sorted((tuple(x) for x in df.select(*c).collect()), key=str)
    assert rows(got, "seq", "op", "barcode", "success", "error", "dueDate") == rows(want.outcomes, "seq", "op", "barcode", "success", "error", "dueDate")
    assert rows(got.where("action is not null"), "seq", "action") == rows(want.audit, "seq", "action")
    assert rows(circulation.standing(got, on), *LOANS.names) == rows(want.loans, *LOANS.names)


def test_records_that_come_again(spark, tmp_path):
    kind = "Timestamp timestamp, batch long, seq long, Action string"
    records = spark.sql("select timestamp'2026-03-05 10:00:00' as Timestamp, 1L as batch, id as seq, concat('a', id) as Action from range(5)")
    for _ in range(2):
        records.write.mode("append").parquet(str(tmp_path / "in"))
    audit.once(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    store.create_audit(spark, path)
    store.create_audit(spark, path)
    assert read_audit(spark, path).count() == 0 and read_audit(spark, path).columns == AUDIT.names
    rows = spark.sql("select timestamp'2026-03-05 10:00:00' + make_interval(0, 0, 0, id) as Timestamp, 'u' as User, concat('a', id) as Action from range(3)")
    for batch in (1, 1, 2, 1):
        store.append_audit(rows, path, batch)
    store.append_audit(rows.limit(1), path, 1)  # what is run again may come to less
    assert read_audit(spark, path).count() == 4
    store.append_audit(rows, path)
    store.append_audit(rows, path)
    assert read_audit(spark, path).count() == 10
