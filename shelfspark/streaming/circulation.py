"""Commands as a stream with keyed state: each barcode's loan lies in Spark's state store, where its next command finds it.

A micro-batch reads and writes just the barcodes that it has commands of, however many loans there are; the checkpoint
holds state and progress, so that a restart goes on where the last run ended. What a command says and logs follows in SQL
from what it did; the state machine itself knows loans and days only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfspark.functions import dates as D
from shelfspark.operators.ids import numbered_id
from shelfspark.plans.commands import SAYS, said
from shelfspark.schemas import LOAN_DAYS, LOANS

_LOAN = ", ".join([*(f"{c} string" for c in LOANS.names if c != "barcode"), "due date"])
_OUT = f"seq long, op string, barcode string, days int, done string, {', '.join(f'{c} string' for c in LOANS.names if c != 'barcode')}, due date"
_CELLS = [c for c in LOANS.names if c != "barcode"]
_ROW = Row("seq", "op", "barcode", "days", "done", *_CELLS, "due")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Copy(StatefulProcessor):
    """One barcode: on loan or not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.loan = handle.getValueState("loan", _LOAN)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        self.loan.update(tuple(initialState[c] for c in [*_CELLS, "due"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        loan = had = self.loan.get()  # each call asks the JVM: one for what there was, one for what changed
        for o in sorted(rows, key=lambda o: o["seq"]):  # a barcode's commands of one micro-batch
            own, done = loan, "taken" if o["op"] == "checkout" else "not loaned"
            if o["op"] == "checkout" and loan is None:
                loan = own = tuple(o[c] for c in [*_CELLS, "due"])
                done = "out"
            elif o["op"] == "return" and loan is not None:
                loan, done = None, "in"
            elif o["op"] == "extend" and loan is not None:
                if loan[-1] is not None:
                    loan = own = (*loan[:-1], loan[-1] + dt.timedelta(days=o["days"]))
                done = "more"
            yield _ROW(o["seq"], o["op"], key[0], o["days"], done, *(own or [None] * (len(_CELLS) + 1)))
        if loan is None and had is not None:
            self.loan.clear()
        elif loan is not had:
            self.loan.update(loan)

    def close(self) -> None:
        pass


def outcomes(commands: DataFrame, loans: DataFrame | None = None, as_of: D.Day = None) -> DataFrame:
    """Of a stream of commands (as plans.commands.circulate takes them): seq, op, barcode, success, error, dueDate, action and
    the loan's cells after it (null once it is returned). loans: a static table with which the first run begins."""
    have = set(commands.columns)
    cell = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default).cast(kind)).alias(c)
    day, days = D.day(as_of), cell("days", "int", LOAN_DAYS)
    due = F.date_add(day, days)
    o = commands.select(
        F.col("seq").cast("long").alias("seq"), "op", "barcode", days, numbered_id("L", F.col("seq").cast("long")).alias("id"), cell("title", "string", ""), D.show(day).alias("checkoutDate"), D.show(due).alias("dueDate"),
        cell("borrowerName", "string", ""), cell("borrowerId", "string", ""), due.alias("due"),
    )
    first = None
    if loans is not None:
        least = loans.groupBy("barcode").agg(F.min(F.struct(*LOANS.names)).alias("loan"))
        first = least.select("barcode", *[F.col("loan")[c].alias(c) for c in _CELLS]).withColumn("due", D.parse("dueDate")).groupBy("barcode")
    done = o.groupBy("barcode").transformWithState(_Copy(), _OUT, "Append", "None", first)
    shown = F.coalesce(D.show(F.col("due")), "dueDate")
    ok = F.col("done").isin("out", "in", "more")
    name = {"title": "title", "barcode": "barcode"}
    action = (
        F.when(F.col("done") == "out", said("out", name="borrowerName", borrower="borrowerId", days="days", **name))
        .when(F.col("done") == "in", said("in", name="borrowerName", **name)).when(F.col("done") == "more", said("more", days="days", **name))
    )
    kept = ~F.col("done").isin("in", "not loaned")
    return done.select(
        "seq", "op", "barcode", ok.alias("success"), F.when(F.col("done") == "taken", F.lit(SAYS["taken"])).when(F.col("done") == "not loaned", said("not loaned", barcode="barcode")).alias("error"),
        F.when(F.col("done") == "more", shown).alias("dueDate"), action.alias("action"), F.when(kept, F.struct(*[(shown if c == "dueDate" else F.col(c)).alias(c) for c in LOANS.names])).alias("loan"),
    )


@contextmanager
def _rocks(spark: SparkSession):
    """Queries that start meanwhile keep their state in RocksDB, which keyed state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def start(commands: DataFrame, path: str, checkpoint: str, loans: DataFrame | None = None, as_of: D.Day = None) -> StreamingQuery:
    """Run all commands that are there, each once, and write their outcomes to a folder."""
    with _rocks(commands.sparkSession):
        return outcomes(commands, loans, as_of).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def standing(out: DataFrame, loans: DataFrame) -> DataFrame:
    """All loans after the outcomes: of each barcode with a command the last one's, of the others what they were."""
    last = out.groupBy("barcode").agg(F.max_by("loan", "seq").alias("loan"))
    return loans.join(last, "barcode", "left_anti").select(*LOANS.names).unionByName(last.where("loan is not null").select("loan.*"))
