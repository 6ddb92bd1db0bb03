import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from shelfspark.llm import queries
from shelfspark.llm import sessions as S


def brute(events, gap=S.GAP):
    """Every snapshot of every user, from scratch: versions in order, with what retracts them."""
    by_user = defaultdict(list)
    for u, b, s, h in events:
        if None not in (u, b, s):
            by_user[u].append((s, b, h or 0))
    out = []
    for u, all_ in by_user.items():
        standing = []
        for at in sorted({b for _, b, _ in all_}):
            runs = []
            for e in sorted(x for x in all_ if x[1] <= at):
                if runs and e[0] - runs[-1][-1][0] <= gap:
                    runs[-1].append(e)
                else:
                    runs.append([e])
            for run in runs:
                new = sum(b == at for _, b, _ in run)
                if not new:
                    continue
                lo, hi = run[0][0], run[-1][0]
                gone = [v for v in standing if lo <= v[2] <= hi]
                v = [u, at, lo, hi, len(run), new, len(gone), sum(h for *_, h in run), None, None]
                for g in gone:
                    g[8:] = [at, lo]
                    standing.remove(g)
                standing.append(v)
                out.append(v)
    return sorted(map(tuple, out), key=str)


def versions(spark, events, gap=S.GAP):
    df = spark.createDataFrame(events, "user long, batch long, seconds long, h long")
    return sorted(map(tuple, S.merged(df, gap).select(*S.COLUMNS).collect()), key=str)


def some(r, users, n, span, batches, late):
    out = []
    for _ in range(n):
        s = r.randrange(span)
        out.append((r.randrange(users), s * batches // span + r.choice([0, 0, 0, *range(late)]), s, r.randrange(1 << 32)))
    return out


@pytest.mark.parametrize(("users", "n", "span", "batches", "late"), [(40, 900, 9000, 10, 4), (3, 700, 60_000, 60, 9), (1, 400, 4_000, 400, 300), (200, 400, 900, 1, 1)])
def test_random_events(spark, users, n, span, batches, late):
    events = some(random.Random(n), users, n, span, batches, late)
    assert versions(spark, events) == brute(events)


def test_many_sparse_events_merge_late(spark):
    """Sessions stand for many batches before one event joins two or three of them."""
    events = [(7, k % 5, 1000 * k, k) for k in range(60)] + [(7, 10 + k, 1000 * k + 500, 1) for k in range(0, 59, 2)] + [(7, 99, 1000 * k + 500, 1) for k in range(1, 59, 2)]
    got = versions(spark, events)
    assert got == brute(events)
    assert max(v[6] for v in got) > 20


@pytest.mark.parametrize("cells", [1, 40, 500, 5000])
def test_blocks_of_batches(cells):
    """A stretch in blocks of any size has the versions that one matrix has."""
    r = random.Random(cells)
    for _ in range(30):
        n = r.randint(1, 60)
        x = np.array(sorted((r.randrange(12_000), r.randrange(9)) for _ in range(n)))
        start, batch = x[:, 0], x[:, 1]
        ones = np.ones(n, np.int64)
        cols = (batch, start, start, ones, np.arange(n))
        want = S.snapshots(np.zeros(n, np.int64), *cols, 600)
        got = S.in_blocks(*cols, 600, cells)
        show = lambda v: sorted((*map(int, t[:8]), int(v.batch[t[8]]) if t[8] >= 0 else None, int(v.start[t[8]]) if t[8] >= 0 else None) for t in zip(*v))
        assert show(got) == show(want)


@pytest.mark.parametrize("items", [1, 7, 100])
def test_stretches_over_arrow_batches(items):
    """Items come in Arrow batches of any size, with any nullability; a stretch may go over several."""
    r = random.Random(items)
    x = sorted({(r.randrange(6), r.randrange(40_000), r.randrange(8)) for _ in range(300)})
    cols = {"user": [a for a, _, _ in x], "batch": [b for *_, b in x], "start": [s for _, s, _ in x], "end": [s for _, s, _ in x], "n": [1] * len(x), "h": list(range(len(x)))}
    t = pa.table({k: pa.array(v, pa.int64()) for k, v in cols.items()})
    got = [tuple(row.values()) for b in S._merging(600, items)(iter(t.to_batches(max_chunksize=11))) for row in b.to_pylist()]
    assert sorted(got, key=str) == brute([(u, b, s, k) for k, (u, s, b) in enumerate(x)])


def test_a_user_of_many_events_is_few_items(spark):
    """A third of all events is one user's: what is gathered of that user follows the time range and the batches."""
    r = random.Random(5)
    events = [(r.randrange(50), s // 900 + r.choice([0, 0, 1]), s, 1) for s in (r.randrange(20_000) for _ in range(6000))]
    events += [(-1, s // 900 + r.choice([0, 0, 1]), s, 1) for s in (r.randrange(20_000) for _ in range(3000))]
    assert versions(spark, events) == brute(events)


def test_awkward(spark):
    events = [(1, 0, 0, None), (1, 0, 0, 5), (1, 0, 0, 5), (None, 0, 1, 1), (1, None, 1, 1), (1, 0, None, 1), (2, -3, -601, 1), (2, -2, 0, 2), (2, -1, -1, 3), (3, 1, 600, 1), (3, 1, 0, 1), (4, 1, 601, 1), (4, 1, 0, 1)]
    got = versions(spark, events)
    assert got == brute(events)
    assert [v for v in got if v[0] == 1] == [(1, 0, 0, 0, 3, 3, 0, 10, None, None)]
    assert len([v for v in got if v[0] == 3]) == 1 and len([v for v in got if v[0] == 4]) == 2
    df = spark.createDataFrame([(1, 0, 5, 2, "x", [1], 3)], "user long, batch long, seconds long, h long, slot string, start array<int>, n int")
    assert [tuple(r) for r in S.merged(df).collect()] == [(1, 0, 5, 5, 1, 1, 0, 2, None, None)]
    assert S.merged(df.where("user = 2")).collect() == []


def test_conversation_events(spark):
    rows = [(c, t) for c in (0, 5, 8, 123_456_789, -3) for t in (0, 1, 7)] + [(None, 1), (4, None), (5, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long")
    want = []
    for c, t in rows:
        if c is None or t is None:
            continue
        x, h = zlib.crc32(str(c).encode()), zlib.crc32(f"{c}:{t}".encode())
        g, s = h // 600, x // 2 % 7200 + 300 * t + h % 600
        want.append((2 * (c // 8) + x % 2, s // 900 + (g % 4 if g % 5 == 0 else 0), s, h))
    assert sorted(map(tuple, S.conversation_events(df).collect())) == sorted(want)


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    df = queries.op12_sessions(spark, d)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op12_sessions"])
    cols = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(cur.fetchall(), key=str)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint>" in plan and "SinglePartition" not in plan
