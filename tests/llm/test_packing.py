import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from shelfspark.llm import packing as P


def check(rows, texts, length=4096):
    t = Tokenizer.from_file(P.word_tokenizer())
    want = Counter()
    for d, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), length)):
            want[(d, k, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(r["length"] for r in rows) // length)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    used, least = check(P.packed(df).collect(), [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert used <= least + 1


def test_awkward(awkward, empty):
    df, texts = awkward
    check(P.packed(df).collect(), texts)
    assert P.packed(empty).collect() == []


def test_plan_places_everything_and_is_tight():
    r = random.Random(1)
    for length, n in ((10, 200), (100, 1000), (4096, 3000)):
        h = Counter(r.randint(1, length) for _ in range(n))
        sequences = P.plan(dict(h), length)
        got = Counter()
        for s, times in sequences:
            assert sum(s) <= length and times > 0
            for x in s:
                got[x] += times
        assert got == h
        used = sum(t for _, t in sequences)
        first_fit: list[int] = []
        for x in sorted(h.elements(), reverse=True):
            k = next((k for k, free in enumerate(first_fit) if free >= x), None)
            if k is None:
                first_fit.append(length - x)
            else:
                first_fit[k] -= x
        assert used <= len(first_fit)


def test_small_cases_are_optimal():
    def fewest(items, length):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= length and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    r = random.Random(6)
    off = 0
    for _ in range(60):
        items = sorted((r.randint(1, 20) for _ in range(9)), reverse=True)
        off += sum(t for _, t in P.plan(Counter(items), 20)) - fewest(items, 20)
    assert off <= 3


def test_filling_beats_best_fit():
    # best fit takes 7 and leaves 3; completion finds 5 + 5
    assert P.fillings([5, 7], {5: 2, 7: 1}, 10) == [5, 5]


def test_completion_reaches_small_lengths_behind_many_larger_ones():
    """Around 60, eight lengths from 39 to 32 waste more than 20 + 20 does."""
    full = [(60, 20, 20), (39, 38, 23), (37, 36, 27), (35, 34, 31), (35, 33, 32)]
    for n in (1, 1000):
        sequences = P.plan({x: n * sum(s.count(x) for s in full) for s in full for x in s}, 100)
        assert sum(t for _, t in sequences) == 5 * n


def test_the_bound_is_above_every_sum():
    counts = {3: 2, 5: 1, 9: 4}
    sums = P.reachable(counts, 20)
    for top in (2, 3, 5, 9, 20):
        own = {3 * a + 5 * b + 9 * c for a in range(3) for b in range(2) for c in range(5) if (top >= 3 or not a) and (top >= 5 or not b) and (top >= 9 or not c)}
        assert {k for k in range(21) if sums[top] >> k & 1} == {k for k in own if k <= 20}


def test_fillings_waste_as_little_as_possible():
    """Whatever the budget of nodes: the best sum of lengths by all subsets."""
    r = random.Random(3)
    for _ in range(300):
        space = r.randint(1, 60)
        counts = Counter(r.randint(2, 40) for _ in range(r.randint(1, 8)))
        sums = {0}
        for x, k in counts.items():
            sums = {s + m * x for s in sums for m in range(k + 1) if s + m * x <= space}
        for budget in (0, 3, 400):
            got = P.fillings(sorted(counts), dict(counts), space, budget, P.reachable({x: 60 for x in counts}, space))
            assert sum(got) == max(sums) and not Counter(got) - counts
        got = P.completed(sorted(counts), dict(counts), space)
        assert sum(got) == max(sums) and not Counter(got) - counts and got == sorted(got, reverse=True)


def test_sequences_against_the_lower_bound(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    row = P.packed(df).selectExpr("count(distinct sequence_id) as used", "sum(length) as tokens").first()
    assert row["used"] <= -(-row["tokens"] // P.LENGTH) + 2


def test_short_pieces_are_packed_at_the_bound():
    """However many pieces share a sequence: no recursion by piece, and no time by their number."""
    r = random.Random(8)
    mixes = [{1: 1_000_000}, {1: 1100}, {4: 20_000, 4000: 3}, {1: 40_000, 3000: 7, 4096: 2}]
    mixes += [{k: r.randrange(1, 60_000) for k in range(1, 9) if r.random() < 0.6} or {8: 3} for _ in range(12)]
    for h in mixes:
        sequences = P.plan(dict(h))
        got = Counter()
        for s, times in sequences:
            assert sum(s) <= 4096
            for x in s:
                got[x] += times
        assert got == h
        assert sum(t for _, t in sequences) == -(-sum(k * v for k, v in h.items()) // 4096)


def test_many_empty_texts(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 50 = 0, repeat('some words ', 300), if(id % 2 = 0, '', null)) as text")
    rows = P.packed(df).select("length", "sequence_id", "offset").collect()
    # six of the 400 long texts fit into a sequence, and all else beside them
    longest = max(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) == -(-400 // (4096 // longest)) == 67
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) == 20_000
