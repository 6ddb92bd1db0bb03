import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import bpe, queries
from shelfspark.llm import curve as C
from tests.llm.conftest import prose


def check(rows, texts, length=1024):
    """Every id of every document lies in one piece; sequences have no gap, and are full or a power of two."""
    t = Tokenizer.from_file(bpe.byte_tokenizer())
    want = Counter()
    for d, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    whole = {k[:2]: None for k in want}
    sequences = defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= length and (r["doc_id"], r["doc_tokens"]) in whole
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length and at & (at - 1) == 0
    # pieces of one document (or of documents of equal id and size) put together again
    all_ids = {}
    for d, x in texts:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        all_ids.setdefault((d, len(ids)), []).append(ids)
    seen = defaultdict(Counter)
    for r in rows:
        a, b = r["start"], r["start"] + r["length"]
        assert r["ids_crc32"] in {zlib.crc32(ids[a:b].tobytes()) for ids in all_ids[r["doc_id"], r["doc_tokens"]]}
        seen[r["doc_id"], r["doc_tokens"]].update(range(a, b))
    for k, ids in all_ids.items():
        assert seen[k] == Counter({i: len(ids) for i in range(k[1])})
    return len(sequences), -(-sum(r["length"] for r in rows) // length)


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2), (4, 1)])
def test_hilbert_curve_visits_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    place = C.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_query_packs_every_id(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    used, least = check(queries.op11_curve_packing(spark, d).collect(), [(r["doc_id"], r["text"]) for r in docs])
    assert used <= least + 8 * 10  # ten lengths at most at each task's end


def test_awkward(spark, awkward, empty):
    df, texts = awkward
    check(C.packed(df).collect(), texts)
    for length in (1, 8):
        few = [(d, x) for d, x in texts if len(x or "") < 900]
        check(C.packed(spark.createDataFrame(few, "doc_id long, text string"), length=length).collect(), few, length)
    assert C.packed(empty).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        C.packed(df, length=1000)


@pytest.mark.parametrize(("words", "vocabulary", "least"), [(60, 300, 5 / 8), (120, 40, 0.9)])
def test_neighbours_are_alike(spark, words, vocabulary, least):
    """Documents of one vocabulary lie together on the curve, where packing follows it: the more so, the more words they share."""
    r = random.Random(3)
    texts = [(i, prose(r, words, vocabulary).replace("w", "abcdefgh"[i % 8])) for i in range(400)]
    kind = lambda i: i % 8
    rows = C.packed(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)
    by = defaultdict(list)
    for x in rows:
        by[x["sequence_id"]].append((x["offset"], kind(x["doc_id"])))
    pairs = [a[1] == b[1] for s in by.values() for a, b in zip(sorted(s), sorted(s)[1:])]
    assert sum(pairs) / len(pairs) > least  # one in eight by chance


@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_directions(n):
    """Orthonormal whatever the sample, and the first one along what differs most."""
    r = np.random.default_rng(n)
    v = r.standard_normal((n, C.FEATURES)) * 0.01
    v[:, 5] += r.choice([-1, 1], n)
    middle, across = C.directions(v)
    assert np.allclose(across.T @ across, np.eye(C.DIMENSIONS)) and middle.shape == (C.FEATURES,)
    assert n < 500 or abs(across[5, 0]) > 0.99


def test_copies_are_dealt_to_many_tasks(spark):
    """One text in 90 percent of the rows, some of them without an id, and rows that are equal throughout."""
    text = prose(random.Random(1), 50)
    texts = [(i, text) for i in range(1500)] + [(None, text)] * 300 + [(7, text)] * 300 + [(5000 + i, f"other {i}") for i in range(200)]
    rows = C.packed(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    check(rows, texts)
    by_task = Counter(r["sequence_id"] // C.PER_TASK for r in rows)
    assert len(by_task) == 8 and max(by_task.values()) < 2 * sum(by_task.values()) / 8


def test_powers_and_keys():
    for n in range(70):
        assert sum(C.powers(n)) == n and all(x & (x - 1) == 0 for x in C.powers(n))
    texts = pa.array([None, "", " \n", "a word", "A WORD", "other words"])
    k = C.keys(texts, *C.directions(C.vectors(texts)))
    assert k[:3].tolist() == [0, 0, 0] and k[3] == k[4] != k[5] and (k[3:] > 0).all()
