import random

from shelfspark.llm import linededup as L


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[d] = None
            continue
        keep = []
        for line in t.split("\n"):
            blank = not line.strip(" \t\r\x0b\x0c")
            if blank or not any(near(line, x) for x in seen):
                keep.append(line)
            if not blank:
                seen.append(line)
        out[d] = "\n".join(keep)
    return out


def run(df):
    return {r["doc_id"]: r["text"] for r in L.deduplicated(df).collect()}


def test_against_brute_force(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "x", "Page 1", "Page 2", "Page 12", "Licensed under the Apache License, Version 2.0.", "été", "", "  ", "a", "b", "ab", "abc", "a much longer line of several words that repeats"]

    def edit(s):
        if not s or r.random() < 0.4:
            return s
        i, k = r.randrange(len(s) + 1), r.random()
        return s[:i] + r.choice("xyzé") + s[i:] if k < 0.4 else s[:i] + s[i + 1 :] if k < 0.7 else s[:i] + r.choice("qé") + s[i + 1 :]

    rows = [(d, "\n".join(edit(edit(r.choice(words) + r.choice(["", " tail of some length"]))) for _ in range(r.randint(0, 6)))) for d in range(200)] + [(900, None), (901, "")]
    want = brute(rows)
    assert sum(want[d] != t for d, t in rows) > 100
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run(df) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_awkward(awkward, empty):
    df, texts = awkward
    got = L.deduplicated(df)
    assert got.columns == df.columns
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert got.count() == len(texts)
    assert by[4] is None and by[5] == "" and by[2] == "" and by[10] == "same line\nother" and by[6] == "  \n\t "
    assert L.deduplicated(empty).collect() == []
    counts = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in L.deduplicated(df.select("doc_id", "text"), counts=True).collect()}
    assert counts[10] == (4, 2) and counts[4] == (0, 0) and counts[5] == (1, 0)


def test_nothing_runs_python(awkward):
    assert "Python" not in L.deduplicated(awkward[0])._jdf.queryExecution().executedPlan().toString()


def test_rows_of_equal_id(spark):
    rows = [(1, "first line\nsecond line"), (1, "first line\nanother one"), (1, "first line\nsecond line"), (2, "second lines")]
    got = sorted(r["text"] for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # a repeated row keeps what the first keeps; the line that both texts of id 1 hold stays in one of them
    assert got in (["", "another one", "first line\nsecond line", "first line\nsecond line"], ["", "first line\nanother one", "second line", "second line"])


def test_a_million_lines_in_one_document(spark):
    """Half of them repeat; what goes is found by number, not by search."""
    lines = [f"line number {i}, with some words of its own {i * i}" for i in range(100_000)]
    many = [x for i in range(500_000) for x in (f"{i * 7919} unique {i}", "a line that returns again and again")]
    rows = [(1, "\n".join(many)), (2, "\n".join(lines[:10] + ["a line that returns again and again"] + lines[10:]))]
    got = {r["doc_id"]: r for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert got[1]["n_lines"] == 1_000_000 and got[1]["n_removed"] >= 499_999
    assert "a line that returns" not in got[2]["text"] and got[1]["text"].count("a line that returns") == 1


def test_columns_of_any_name(awkward):
    df, texts = awkward
    got = L.deduplicated(df)
    assert got.columns == df.columns and {r["lines_gone"] for r in got.collect()} == {"keep"}
    counted = L.deduplicated(df, counts=True)
    assert sorted(counted.columns) == sorted(df.columns) and {r["n_lines"] for r in counted.select("n_lines").distinct().collect()} != {"keep"}
