import hashlib
import random

import numpy as np

from shelfspark.llm import substrings as S
from tests.llm.conftest import WORD


def brute(rows, k=20):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def run(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.deduplicated(df).collect()}


def test_small_alphabet(spark):
    """Periodic and overlapping repeats, in one document and across them."""
    r = random.Random(5)
    base = [r.choice("abc") for _ in range(400)]
    piece = lambda: base[r.randrange(300) :][: r.randint(1, 90)]
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.choice([5, 19, 20, 21, 60])))) if i % 3 == 0 else (i, " ".join(piece() + ["z"] * r.randint(0, 40) + piece())) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " ".join(["a", "b"] * 200)), (203, "q " * 50)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(df) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_awkward(awkward, empty):
    df, texts = awkward
    got = S.deduplicated(df).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_removed"] == by[2]["n_words"] == 120 and by[1]["n_removed"] == 0
    assert by[4]["n_words"] == 0 and by[4]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert S.deduplicated(empty).collect() == []


def test_seeds_cover_every_window():
    w = np.random.default_rng(1).integers(1, 1 << 62, 500, dtype=np.uint64)
    row, at, _ = S.seeds(w, np.array([0, 15, 35, 300, 500]))
    chosen = {(int(r), int(a)) for r, a in zip(row, at)}
    assert not any(r == 0 for r, _ in chosen)
    for r, n in ((1, 20), (2, 265), (3, 200)):
        for s in range(n - 19):
            assert any((r, p) in chosen for p in range(s, s + 13))


def test_equal_and_missing_ids(spark):
    """Rows of equal doc_id are documents of their own; those without one come last."""
    r = random.Random(8)
    a, b, c = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (1, f"{c} {c}"), (4, f"q {c}"), (None, f"z {a}"), (None, c), (1, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, x["n_words"], x["n_removed"]) for x in S.deduplicated(df).collect())
    assert got == sorted([(1, 40, 0), (1, 40, 0), (1, 40, 0), (1, 80, 40), (2, 40, 40), (3, 40, 40), (4, 41, 40), (0, 41, 40), (0, 40, 40)])
    # the same place in both rows of one id: each later copy goes, whichever it follows
    rows = [(1, f"{a} {b}"), (1, f"{a} {c}"), (2, b), (3, c), (4, a)]
    got = sorted((x["doc_id"], x["n_removed"]) for x in S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, 40), (3, 40), (4, 40)]


def test_one_passage_in_most_documents(spark):
    """A seed that most documents hold is dealt to many tasks."""
    r = random.Random(9)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, f"u{i} " * 3 + common + "".join(f" x{r.randrange(10**6)}" for _ in range(20))) for i in range(600)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    texts = spark.createDataFrame(rows, "doc long, text string")
    found = texts.mapInArrow(S._seeding(20), "h long, doc long, at int, once boolean")
    assert {x["doc"] for x in S.owned(found).collect()} == set(range(1, 600))
