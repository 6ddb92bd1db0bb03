import random
import re

import corpus_pipeline as C
from shelfspark.llm import langid
from tests.llm.test_linededup import brute as lines_brute
from tests.llm.test_ngram_join import brute as join_brute
from tests.llm.test_ngram_join import shingles
from tests.llm.test_packing import check


def test_against_brute_force(spark, sf_dir):
    """Each stage's output against a plain computation on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    kept = C.language(spark, docs, sf_dir)
    assert kept.columns == C.COLUMNS
    before, after = rows(docs), rows(kept)
    assert all(after[d] == before[d] for d in after)
    assert all(re.search(r"\w", before[d]) is None for d in before.keys() - after.keys())
    lined = C.lines(spark, kept, sf_dir)
    want = {d: t for d, t in lines_brute(list(after.items())).items() if t.strip(" \t\n\r\x0b\x0c")}
    after = rows(lined)
    assert after == want and lined.columns == C.COLUMNS
    single = C.near_duplicates(spark, lined, sf_dir)
    want = {d: after[d] for d, (_, c) in join_brute(list(after.items())).items() if c == d}
    after = rows(single)
    assert after == want and single.columns == C.COLUMNS
    safe = C.personal_data(spark, single, sf_dir)
    masked = rows(safe)
    assert masked.keys() == after.keys() and safe.columns == C.COLUMNS
    assert not any(m in masked[d] for d, t in after.items() for m in re.findall(r"[\w.]+@mail\d\.example\.com", t))
    assert all(masked[d] == t for d, t in after.items() if not re.search(r"\d|@|(?i:password|token|key|secret)", t))
    check(C.packed(spark, safe, sf_dir).collect(), list(masked.items()))


def test_run_and_awkward(spark, awkward, empty, tmp_path):
    df, _ = awkward
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    out = C.run(spark, str(tmp_path / "a")).collect()
    ids = {r["doc_id"] for r in out}
    assert 1 in ids and 2 not in ids and 4 not in ids
    empty.write.parquet(str(tmp_path / "b/documents.parquet"))
    assert C.run(spark, str(tmp_path / "b")).collect() == []
    assert len(C.STAGES) == 5 and langid.UND == "und"


def test_near_duplicates_take_five_words_and_four_fifths(spark):
    r = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        # 20 percent more text appended, and one word changed in 50, 40 and 30
        texts += [base, base + [f"a{r.randrange(10**6)}" for _ in range(40)]]
        texts += [[w if i % k else f"e{k}" for i, w in enumerate(base)] for k in (50, 40, 30)]
    texts = [(i, " ".join(w)) for i, w in enumerate(texts)]
    s = {d: shingles(t, 5) for d, t in texts}
    up = {d: d for d in s}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in s:
        for b in range(a + 1, len(s)):
            if 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"] for x in C.near_duplicates(spark, docs, "").collect()}
    assert got == {d for d in s if root(d) == d} and 1 not in got
