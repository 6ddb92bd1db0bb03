"""Session versions of events that arrive in batches, some of them late: every creation, extension and merge.

After each batch a user's events so far form sessions: neighbours in time at most ``gap`` apart share one. A session that
holds an event of that batch is a new version and retracts the standing sessions that it contains.

Events of one user and batch in one slot of ``gap`` seconds share a session from their batch on, whatever else comes, so
they are one item: counted and summed before the shuffle. What a task gathers of a user is bounded by the user's time
range (slots by batches), not by the user's events. A task streams its users' items in order of time and cuts them where
the gap between all items is too wide: what lies beyond never meets in any snapshot. Each such stretch is one activity
matrix of batches by items, many stretches at a time: maximum.accumulate over the active items' ends is the last active
time before each item and so marks the breaks, their cumulative sum numbers the sessions of all snapshots, and reduceat
aggregates them. A stretch whose matrix has more than ``CELLS`` cells is worked in blocks of batches; between two blocks
a standing session is one item.

Cases: events without a user, batch or second don't count; a null value adds nothing; repeated events all count; equal
times are no gap; an empty table gives an empty result; columns other than the four are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io

GAP = 600
#: Cells of a matrix, and rows of items that are worked on at once.
CELLS, ITEMS = 1 << 20, 1 << 14
COLUMNS = ["user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s"]
#: Stands for what was before the first batch of a block.
BEFORE = np.iinfo(np.int64).min


class Versions(NamedTuple):
    """Columns of versions; ``by`` is the number of the version that retracts each, or -1."""

    stretch: np.ndarray
    batch: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n: np.ndarray
    new: np.ndarray
    retracts: np.ndarray
    h: np.ndarray
    by: np.ndarray


def matrix_of(stretch: np.ndarray, batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all stretches' matrices (a stretch's batches, ascending): stretch, batch, and how many items each has."""
    order = np.lexsort((batch, stretch))
    s, b = stretch[order], batch[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
    rows, batches = s[first], b[first]
    return rows, batches, np.bincount(stretch, minlength=int(stretch.max(initial=-1)) + 1)


def snapshots(stretch: np.ndarray, batch: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, h: np.ndarray, gap: int) -> Versions:
    """All versions of stretches 0, 1, ... whose items are sorted by stretch and start, in order of stretch, batch and start."""
    of_row, at_batch, width = matrix_of(stretch, batch)
    # the cells, row after row: each row of a stretch has all of its items
    size = width[of_row]
    row = np.repeat(np.arange(len(of_row)), size)
    first_item, first_cell = np.cumsum(width) - width, np.cumsum(size) - size
    item = np.arange(len(row)) - np.repeat(first_cell - first_item[of_row], size)
    active = batch[item] <= at_batch[row]
    # ends rise from row to row by more than any time, so that one accumulation serves all rows
    low = int(start.min(initial=0))
    reach = int(end.max(initial=0)) - low + 2
    last = np.maximum.accumulate(np.where(active, row * reach + (end[item] - low + 1), 0))
    before = np.zeros(len(row), np.int64)
    before[1:] = last[:-1]
    before -= row * reach
    opens = active & ((before <= 0) | (start[item] - low + 1 - before > gap))
    session_of = np.cumsum(opens) - 1  # of active cells
    cell = np.flatnonzero(active)
    bounds = np.searchsorted(cell, np.flatnonzero(opens))
    its, rows = item[cell], row[cell]
    if not len(bounds):
        none = np.zeros(0, np.int64)
        return Versions(*[none] * 9)
    new = np.add.reduceat(np.where(batch[its] == at_batch[rows], n[its], 0), bounds)
    latest = np.maximum.reduceat(batch[its], bounds)
    s_row, s_item = rows[bounds], its[bounds]
    made = latest == at_batch[s_row]
    version = np.cumsum(made) - 1
    # a session that a row leaves as it was is the version of an earlier row with the same first item
    old = np.flatnonzero(~made)
    order = np.lexsort((s_row, s_item))
    known = np.maximum.accumulate(np.where(made[order], np.arange(len(order)), -1))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    version[old] = version[order[known[place[old]]]]
    # a row's sessions stand before the next row of their stretch: where is their first item then?
    has_next = np.append(of_row[1:] == of_row[:-1], False)
    standing = np.flatnonzero(has_next[s_row])
    into = session_of[first_cell[s_row[standing] + 1] + s_item[standing] - first_item[of_row[s_row[standing]]]]
    lost = made[into]
    by = np.full(int(made.sum()), -1, np.int64)
    by[version[standing[lost]]] = version[into[lost]]
    retracts = np.bincount(version[into[lost]], minlength=len(by))
    kept = lambda x: x[made]
    return Versions(
        kept(of_row[s_row]), kept(at_batch[s_row]), kept(start[s_item]), kept(np.maximum.reduceat(end[its], bounds)), kept(np.add.reduceat(n[its], bounds)),
        kept(new), retracts.astype(np.int64), kept(np.add.reduceat(h[its], bounds)), by,
    )


def in_blocks(batch: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, h: np.ndarray, gap: int, cells: int = CELLS) -> Versions:
    """snapshots() of one stretch, in blocks of batches of about so many cells; the sessions that stand are items of the next block."""
    batches, counts = np.unique(batch, return_counts=True)
    none = np.zeros(0, np.int64)
    out: list[list[np.ndarray]] = []
    known: list[tuple[np.ndarray, np.ndarray]] = []
    base, at = 0, 0
    standing = {k: none for k in ("start", "end", "n", "h", "number")}
    while at < len(batches):
        to, items = at + 1, len(standing["start"]) + int(counts[at])
        while to < len(batches) and (to - at + 2) * (items + int(counts[to])) <= cells:
            items += int(counts[to])
            to += 1
        own = (batch >= batches[at]) & (batch <= batches[to - 1])
        old = len(standing["start"])
        join = lambda k, x: np.concatenate([standing[k], x[own]])
        b, s, e = np.concatenate([np.full(old, BEFORE), batch[own]]), join("start", start), join("end", end)
        order = np.lexsort((b, s))
        got = snapshots(np.zeros(len(b), np.int64), b[order], s[order], e[order], join("n", n)[order], join("h", h)[order], gap)
        # the first row is what stood before: its versions are known, and now it may be known what retracts them
        number = np.concatenate([standing["number"], base + np.arange(len(got.batch) - old)])
        got = got._replace(by=np.where(got.by < 0, -1, number[np.maximum(got.by, 0)]))
        known.append((standing["number"], got.by[:old]))
        live = np.flatnonzero(got.by < 0)
        live = live[np.argsort(got.start[live])]
        standing = {"start": got.start[live], "end": got.end[live], "n": got.n[live], "h": got.h[live], "number": number[live]}
        out.append([x[old:] for x in got])
        base += len(got.batch) - old
        at = to
    v = Versions(*map(np.concatenate, zip(*out)))
    for numbers, by in known:
        v.by[numbers[by >= 0]] = by[by >= 0]
    return v


def _table(user: np.ndarray, v: Versions) -> pa.RecordBatch:
    gone = v.by < 0
    at = np.maximum(v.by, 0)
    columns = [pa.array(x) for x in (user[v.stretch], v.batch, v.start, v.end, v.n, v.new, v.retracts, v.h)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(v.batch[at] if len(at) else at, mask=gone), pa.array(v.start[at] if len(at) else at, mask=gone)], COLUMNS)


def _merging(gap: int, items: int = ITEMS):
    """Items in order of user and start; whole stretches are worked on, what may go on waits for the next batch."""
    names = ("user", "batch", "start", "end", "n", "h")

    def worked(x: dict[str, np.ndarray], opens: np.ndarray) -> Iterator[pa.RecordBatch]:
        stretch = np.cumsum(opens) - 1
        first = np.flatnonzero(opens)
        of, _, width = matrix_of(stretch, x["batch"])
        cells = np.bincount(of, width[of], len(first)).astype(np.int64)
        ends = np.append(first[1:], len(stretch))
        a = 0
        while a < len(first):
            b, sum_ = a + 1, int(cells[a])
            while b < len(first) and sum_ + int(cells[b]) <= CELLS:
                sum_ += int(cells[b])
                b += 1
            lo, hi = int(first[a]), int(ends[b - 1])
            own = [x[k][lo:hi] for k in names[1:]]
            v = in_blocks(*own, gap) if sum_ > CELLS else snapshots(stretch[lo:hi] - a, *own, gap)
            yield _table(x["user"][first[a:b]], v)
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows, most = 0, items
        for b in batches:
            held.append([b.column(k).to_numpy() for k in names])
            rows += b.num_rows
            if rows >= most:
                x, opens = read(held)
                cut = int(np.flatnonzero(opens)[-1])
                if cut:
                    yield from worked({k: v[:cut] for k, v in x.items()}, opens[:cut])
                held = [[x[k][cut:] for k in names]]
                rows -= cut
                most = max(items, 2 * rows)
        if rows:
            yield from worked(*read(held))

    def read(held: list[list[np.ndarray]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        x = dict(zip(names, map(np.concatenate, zip(*held))))
        user, start, end = x["user"], x["start"], x["end"]
        opens = np.ones(len(user), bool)
        same = user[1:] == user[:-1]
        # the latest end so far of the same user: users are numbered, so that one accumulation serves all of them
        number = np.cumsum(np.append(True, ~same))
        low = int(start.min())
        reach = int(end.max()) - low + 1
        latest = np.maximum.accumulate(number * reach + (end - low)) - number * reach + low
        opens[1:] = ~same | (start[1:] - latest[:-1] > gap)
        return x, opens

    return run


def merged(events: DataFrame, gap: int = GAP) -> DataFrame:
    """Every version of every session of ``events`` (user, batch, seconds, h: long), see COLUMNS."""
    _io.ship(events.sparkSession)
    e = events.select(*[F.col(c).cast("long").alias(c) for c in ("user", "batch", "seconds", "h")]).where("user is not null and batch is not null and seconds is not null")
    slot = F.expr(f"(seconds - pmod(seconds, {gap})) div {gap}")
    items = e.groupBy("user", "batch", slot.alias("slot")).agg(
        F.min("seconds").alias("start"), F.max("seconds").alias("end"), F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h")
    )
    items = items.select("user", "batch", "start", "end", "n", "h").repartition("user").sortWithinPartitions("user", "start", "batch")
    return items.mapInArrow(_merging(gap), ", ".join(f"{c} long" for c in COLUMNS))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """The turns of conversations as events: user, batch, seconds and h follow from the ids. Rows without a turn or conversation are none."""
    crc: Column = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    e = conversations.where("turn is not null and conv_id is not null").select(
        "conv_id", "turn", crc.alias("c"), F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")).alias("h")
    )
    e = e.withColumn("seconds", F.expr("(c div 2) % 7200 + 300 * turn + h % 600")).withColumn("g", F.expr("h div 600"))
    return e.select(
        F.expr("2 * ((conv_id - pmod(conv_id, 8)) div 8) + c % 2").alias("user"),
        F.expr("(seconds - pmod(seconds, 900)) div 900 + if(g % 5 = 0, g % 4, 0)").alias("batch"),
        "seconds",
        "h",
    )
