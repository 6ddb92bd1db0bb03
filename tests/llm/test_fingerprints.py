import hashlib
import random

import numpy as np

from shelfspark.llm import fingerprints as P
from tests.llm.conftest import WORD, prose


def shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return 1.0 if not x and not y else len(x & y) / max(1, len(x | y))


def brute(texts):
    rows = sorted(texts, key=lambda r: -r[0])
    out = {}
    for k, (d, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        third = len(t) // 3
        e = t[: len(t) - third] + n[:third]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(t, e), jaccard(t, n))
    return out


def test_against_brute_force(spark):
    r = random.Random(1)
    texts = [(i, prose(r, r.choice([0, 1, 4, 5, 6, 50, 300]))) for i in range(150)]
    texts += [(200, None), (201, texts[5][1]), (202, "é" * 1000), (203, texts[5][1])]
    got = {x["doc_id"]: x for x in P.fingerprints_with_edits(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = brute(texts)
    assert got.keys() == want.keys()
    for d, (n, sha, near, after) in want.items():
        x = got[d]
        assert (x["n_chars"], x["edited_sha256"]) == (n, sha)
        assert abs(x["near_edited"] - near) < 0.2 and abs(x["near_next"] - after) < 0.2
    assert got[5]["fingerprint"] == got[201]["fingerprint"] == got[203]["fingerprint"]
    assert np.mean([abs(got[d]["near_edited"] - want[d][2]) for d in want]) < 0.05


def test_signature_of_edit_equals_direct_one():
    r = random.Random(2)
    texts = [prose(r, n) for n in (0, 3, 5, 9, 40, 200, 5)]
    block = P._block(list(range(7)), texts, P.permutations()).to_pylist()
    for k, row in enumerate(block):
        third = len(texts[k]) // 3
        edited = texts[k][: len(texts[k]) - third] + texts[k + 1][:third]
        assert row["edited_fingerprint"] == P.written(P.signatures([edited]))[0]
        assert row["fingerprint"] == P.written(P.signatures([texts[k]]))[0]


def test_permutations_in_blocks():
    """Long runs cross blocks; the least values are those of a direct computation."""
    x = np.random.default_rng(3).integers(0, 1 << 63, 150_000, dtype=np.uint64)
    first = np.array([0, 0, 10, 140_000, 140_000, 150_000])
    a, b = P.permutations(4)
    low = P.least(x, first, (a, b))
    for i in range(5):
        own = x[first[i] : first[i + 1]] >> np.uint64(32)
        assert (low[i] == [((own * p + q) >> np.uint64(32)).min() if len(own) else P.NONE for p, q in zip(a, b)]).all()


def test_awkward(awkward, empty):
    df, texts = awkward
    got = P.fingerprints_with_edits(df).collect()
    assert len(got) == len(texts)
    by = {x["doc_id"]: x for x in got}
    assert by[4]["fingerprint"] == by[5]["fingerprint"] == by[6]["fingerprint"] == "ffff" * P.K
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[14]["fingerprint"] != by[3]["fingerprint"]
    assert P.fingerprints_with_edits(empty).collect() == []


def test_classes(spark):
    r = random.Random(5)
    base = prose(r, 400, 100_000).split()
    texts = [(0, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base[:200], "x", *base[201:]])), (3, " ".join(base[:200] + prose(r, 200, 100_000).split())), (4, None), (5, "")]
    texts += [(10 + i, prose(r, 200, 100_000)) for i in range(40)]
    got = {x["doc_id"]: x["class_id"] for x in P.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[0], got[1], got[2], got[3]) == (0, 0, 0, 3)
    assert all(got[d] == d for d in got if d > 3)


def test_classes_where_no_member_of_a_pair_is_a_pivot(spark):
    """A family of documents that share bands and are just below the threshold, with planted pairs above it."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(1275)]
    texts = []
    for k in range(100):
        # lines of a plane of 17 points a side: two meet once at most, so that most stay just below 0.8
        line = [5 * (17 * j + (k // 17 * j + k) % 17) + 2 for j in range(15)]
        for m, places in enumerate((line, line + r.sample(range(1275), 9))):
            words = list(base)
            for p in places:
                words[p] = f"x{k}y{m}z{p}"
            texts.append((2 * k + m, " ".join(words)))
    sets = {d: shingles(t) for d, t in texts}
    up = {d: d for d, _ in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in range(a + 1, len(sets)):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    want = {d: root(d) for d in up}
    assert len(set(want.values())) > 80
    got = {x["doc_id"]: x["class_id"] for x in P.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want


def test_query_where_bands_hold_several_components(spark):
    """Likeness 0.78: bands are shared, no link is made, and each document keeps its class and its one row."""
    base = [f"b{i}" for i in range(400)]
    texts = []
    for k in range(4):
        words = list(base)
        for i in range(10):
            words[40 * i + 10 * k] = f"x{k}y{i}"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame([*texts, (9, texts[0][1]), (10, None)], "doc_id long, text string")
    got = P.fingerprinted(docs).collect()
    assert sorted((x["doc_id"], x["class_id"]) for x in got) == [(0, 0), (1, 1), (2, 2), (3, 3), (9, 0), (10, 10)]
