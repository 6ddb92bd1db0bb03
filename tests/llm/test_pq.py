import math
import random

import duckdb
import numpy as np
import pytest

from shelfspark.llm import pq as Q
from shelfspark.llm import queries


def brute(rows, parts, entries, rounds):
    """Codes, errors and codebooks in plain Python integers, one vector after another."""
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    length = len(next(v for _, _, v in kept if len(v) % parts == 0))
    kept = [r for r in kept if len(r[2]) == length]
    w = length // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for *_, v in kept[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for *_, v in kept:
                own[nearest(p, cut(v)[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(xs) for c in zip(*xs)] if xs else e for e, xs in zip(books[p], own)]
    out = []
    for i, label, v in kept:
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=str), books


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, vector array<float>")


@pytest.mark.parametrize(("n", "parts", "width", "entries", "rounds"), [(300, 4, 3, 16, 2), (40, 2, 1, 64, 2), (500, 16, 2, 64, 3), (9, 1, 4, 3, 1)])
def test_random_vectors(spark, n, parts, width, entries, rounds):
    r = random.Random(n)
    rows = [(i, r.choice([None, 1, 2]), [float(np.float32(r.choice([0, r.gauss(0, 0.3), r.uniform(-9, 9)]))) for _ in range(parts * width)]) for i in range(n)]
    r.shuffle(rows)
    coded, books = Q.compressed(frame(spark, rows).repartition(7), parts, entries, rounds)
    want, want_books = brute(rows, parts, entries, rounds)
    assert sorted(map(tuple, coded.collect()), key=str) == want
    assert books.tolist() == want_books


def test_large_components_take_wide_integers(spark):
    rows = [(i, 0, [float(i * 3000 % 1_000_000), -float(i)]) for i in range(50)]
    coded, _ = Q.compressed(frame(spark, rows), 1, 4, 2)
    assert sorted(map(tuple, coded.collect()), key=str) == brute(rows, 1, 4, 2)[0]
    with pytest.raises(Exception, match="in magnitude"):
        Q.compressed(frame(spark, [(1, 0, [1e30])]), 1, 4, 2)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, 1, [0.5, 0.25]), (5, 1, [0.5, 0.25]), (5, None, [0.1, 0.25]), (None, 2, [-0.5, 1.0]), (1, 2, None), (2, 2, []), (3, 2, [None, 1.0]), (0, 3, [nan, 1.0]), (0, 3, [1.0, -inf]),
        (-4, 3, [1.0, 2.0, 3.0]), (9, None, [0.0, -0.001]), (10, 4, [1.0, 2.0, 3.0, 4.0]),
    ]
    coded, books = Q.compressed(frame(spark, rows), 2, 3, 2)
    want, want_books = brute(rows, 2, 3, 2)
    assert sorted(map(tuple, coded.collect()), key=str) == want and books.tolist() == want_books
    got = {(r["vec_id"], r["label"]): r["label_error"] for r in Q.with_label_errors(coded).collect()}
    errors = {}
    for _, label, _, e in want:
        errors[label] = errors.get(label, 0) + e
    assert len(want) == 5 and got == {(i, label): errors[label] for i, label, *_ in want}
    clash = frame(spark, rows).selectExpr("*", "'x' as n", "1 as data", "array(1) as code", "'y' as error", "2 as of")
    assert sorted(map(tuple, Q.compressed(clash, 2, 3, 2)[0].collect()), key=str) == want
    none, books = Q.compressed(frame(spark, rows).where("vec_id = 77"))
    assert none.collect() == [] and not books.size and Q.with_label_errors(none).collect() == []


def test_copies_of_one_vector(spark):
    """Most rows are one vector: entries that nobody is nearest to stay as they are, ties go to the first."""
    rows = [(i, 1, [0.5] * 4) for i in range(400)] + [(1000 + i, 2, [i / 50, 0.0, -i / 50, 1.0]) for i in range(60)]
    coded, books = Q.compressed(frame(spark, rows), 2, 8, 2)
    want, want_books = brute(rows, 2, 8, 2)
    assert sorted(map(tuple, coded.collect()), key=str) == want and books.tolist() == want_books


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    df = queries.op13_vector_codes(spark, d)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op13_vector_codes"])
    cols = [c[0] for c in cur.description]
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())
