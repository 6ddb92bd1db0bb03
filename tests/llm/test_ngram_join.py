import random

from pyspark.sql import functions as F

from shelfspark.llm import _io
from shelfspark.llm import ngram_join as J
from tests.llm.conftest import WORD, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, n=4):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    s = {d: shingles(t) for d, t in rows}
    up = {d: d for d in s}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            i = len(s[a] & s[b])
            if s[a] and s[b] and 100 * i >= percent * (len(s[a]) + len(s[b]) - i):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s[d]), root(d)) for d in ids}


def run(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.joined(df).collect()}


def variants(r, words, n, edits):
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        yield " ".join(w)


def test_groups_chains_and_common_lines(spark):
    r = random.Random(3)
    line = prose(r, 15, 10**6)
    texts = []
    for size, n, edits in ((30, 25, 2), (100, 60, 4), (400, 40, 12), (8, 20, 1), (3, 6, 1)):
        texts += variants(r, [f"v{r.randrange(10**6)}" for _ in range(size)], n, edits)
    texts += [prose(r, 40, 10**6) + "\n" + line for _ in range(80)]
    # a chain in which only neighbours link
    chain = [f"c{i}" for i in range(260)]
    texts += [" ".join(chain[k * 8 : k * 8 + 120]) for k in range(15)]
    texts += ["", None, "A b C d", "a B c D", "a", "A"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 60
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(df) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_awkward(awkward, empty):
    df, texts = awkward
    got = J.joined(df).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[3] == by[14] == 1 and all(by[d] == d for d in (4, 5, 6, 7, 11, 12))
    assert J.joined(empty).collect() == []


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(5, 5), (None, 3), (2, 1)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in _io.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert _io.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plan_has_no_cross_join(spark, sf_dir):
    plan = J.joined(spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("doc_id") < 20))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_rows_without_an_id_link(spark):
    """They join what they are near to, name no component, and are one another's partners too."""
    r = random.Random(6)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(120)] for x in "ab")
    text = lambda w, *edits: " ".join(f"e{i}" if i in edits else x for i, x in enumerate(w))
    # 5 and 7 link only through the row without an id
    rows = [(5, text(a)), (7, text(a, 20, 21, 22, 60, 61, 62)), (None, text(a, 20, 21, 22)), (None, text(a, 20, 21, 22)), (None, text(b)), (None, text(b, 50)), (9, text(b, 0, 10, 20, 30, 40, 50, 60, 70, 80))]
    s = [shingles(t) for _, t in rows]
    like = lambda i, j: len(s[i] & s[j]) / len(s[i] | s[j])
    assert like(0, 1) < 0.85 <= min(like(0, 2), like(1, 2), like(4, 5))
    got = sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in J.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (0, 0), (0, 5), (0, 5), (5, 5), (7, 5), (9, 9)]


def test_one_id_on_several_texts_of_one_length(spark):
    r = random.Random(7)
    words = [f"{r.randrange(10**5):05}" for _ in range(100)]
    change = lambda w, i: [*w[:i], f"{r.randrange(10**5):05}", *w[i + 1 :]]
    other = [f"{r.randrange(10**5):05}" for _ in range(100)]
    rows = [(1, " ".join(words)), (1, " ".join(other)), (2, " ".join(change(words, 50))), (3, " ".join(change(other, 50)))]
    got = sorted((x["doc_id"], x["component_id"]) for x in J.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_large_tiles_are_cut_into_blocks(spark, monkeypatch):
    """With blocks of four classes the result is the same."""
    monkeypatch.setattr(J, "BLOCK", 4)
    r = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    texts = [t for k in range(25) for t in variants(r, base[:40] + [f"v{k}x{i}" for i in range(20)], 4, 3)]
    rows = list(enumerate(texts))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
