import random
import re
from collections import Counter

import numpy as np

from shelfspark.llm import quality as Q
from tests.llm.conftest import WORD


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base(spark, awkward, empty, sf_dir):
    r = random.Random(4)
    texts = [(i, "".join(r.choice(["a ", "b ", "é", "\n", "#", " ", "a b c ", "\t", "|"]) for _ in range(r.randint(0, 80)))) for i in range(300)]
    for df, rows in ((spark.createDataFrame(texts, "doc_id long, text string"), texts), awkward):
        got = Q.scored(df).collect()
        assert len(got) == len(rows)
        want = {d: brute(t) for d, t in rows}
        for x in got:
            assert tuple(x[c] for c in BASE) == want[x["doc_id"]], x["doc_id"]
            n, _, _, _, again = want[x["doc_id"]]
            assert x["base_failed"] == (n < 50 or 100 * again > 50 * n) and not (x["base_failed"] and x["kept"])
    assert Q.scored(empty).collect() == []


def test_verdict_follows_labels(spark):
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        got = Q.scored(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
        good, bad = [x["kept"] for x in got if x["quality"] == 1], [x["kept"] for x in got if x["quality"] == 0]
        assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def plain_em(patterns, counts, rounds):
    """The same estimates, vote by vote."""
    import math

    post = [1 / (1 + math.exp(-sum(p))) for p in patterns]
    for _ in range(rounds):
        table = {}
        for c in (0, 1):
            weight = [n * (q if c else 1 - q) for n, q in zip(counts, post)]
            for r in range(len(patterns[0])):
                votes = [sum(w for w, p in zip(weight, patterns) if p[r] == v) + Q.PRIOR_VOTES[c][v + 1] for v in (-1, 0, 1)]
                table[r, c] = [v / sum(votes) for v in votes]
        prior = (sum(n * q for n, q in zip(counts, post)) + 1) / (sum(counts) + 2)
        new = []
        for p in patterns:
            like = [math.log(x) + sum(math.log(table[r, c][v + 1]) for r, v in enumerate(p)) for c, x in ((0, 1 - prior), (1, prior))]
            new.append(1 / (1 + math.exp(like[0] - like[1])))
        post = new
    return post


def test_query_against_brute_force(spark, sf_dir):
    """Votes, posteriors and verdicts of the query that runs, by a plain computation over its features."""
    from shelfspark.llm.queries import op6_quality

    got = {x["doc_id"]: x for x in op6_quality(spark, sf_dir).collect()}
    rows = Q.scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    votes = {}
    for x in rows:
        w, c, n = x["n_words"], x["word_chars"], x["n_lines"]
        rules = [
            (x["n_symbols"] > 0.1 * w, w > 0 and x["n_symbols"] <= 0.01 * w), (x["n_upper"] > 0.3 * c, w > 0 and x["n_upper"] <= 0.1 * c),
            (x["n_dup_lines"] > 0.3 * n, n >= 2 and x["n_dup_lines"] == 0), (x["n_repeat_words"] > 0.3 * w, w >= 50 and x["n_repeat_words"] <= 0.05 * w),
            (w < 30, w >= 100), (w > 0 and (c < 2.5 * w or c > 12 * w), w > 0 and 3.5 * w <= c <= 7 * w), (n >= 3 and x["n_ended"] < 0.3 * n, n > 0 and x["n_ended"] >= 0.9 * n),
            (x["plain_words"] < 0.6 * w, w > 0 and x["plain_words"] >= 0.85 * w),
        ]
        votes[x["doc_id"]] = tuple(-1 if bad else int(good) for bad, good in rules)
    patterns = sorted(set(votes.values()))
    failed = {x["doc_id"]: x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"] for x in rows}
    counts = [sum(v == p and not failed[d] for d, v in votes.items()) for p in patterns]
    post = dict(zip(patterns, plain_em(patterns, counts, 300)))
    for d, v in votes.items():
        assert abs(got[d]["posterior"] - post[v]) < 1e-5 and got[d]["kept"] == (not failed[d] and post[v] >= 0.5)


def test_expectation_maximisation_finds_accuracies():
    """What runs, on rules of unlike accuracy and coverage; one of them is right no more often than wrong."""
    r = np.random.default_rng(1)
    truth = r.random(40_000) < 0.7
    acc = np.array([0.95, 0.9, 0.8, 0.7, 0.6, 0.5])
    right = r.random((40_000, 6)) < acc
    votes = np.where(right, 1, -1) * np.where(truth, 1, -1)[:, None] * (r.random((40_000, 6)) < 0.8)
    p, n = np.unique(votes, axis=0, return_counts=True)
    post, prior, table = Q.expectation_maximisation(p, n.astype(float))
    assert abs(prior - 0.7) < 0.05
    for c, v in ((1, 2), (0, 0)):
        assert np.allclose(table[:, c, v] / (table[:, c, 0] + table[:, c, 2]), acc, atol=0.05)
