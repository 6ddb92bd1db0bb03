import random
import unicodedata
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import langid as L


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs, ~L.held_out(), ["doc_id", "lang"]).withColumn("held", L.held_out()).collect()
    assert len(got) == docs.count()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_does_not_read_the_label(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = L.identify(docs, ~L.held_out(), ["doc_id"])
    b = L.identify(docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang"))), ~L.held_out(), ["doc_id"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_awkward(awkward, empty, spark):
    df, texts = awkward
    by = {r["doc_id"]: r for r in L.identify(df, F.lit(True), ["doc_id"]).collect()}
    assert len(by) == len({d for d, _ in texts})
    assert all((by[d]["lang_pred"], by[d]["score"]) == (L.UND, 0.0) for d in (4, 5, 6, 15)) and by[1]["lang_pred"] == "en"
    assert L.identify(empty, F.lit(True), ["doc_id"]).collect() == []
    assert {r["lang_pred"] for r in L.identify(df, F.lit(False), ["doc_id"]).collect()} == {L.UND}


def test_masks_hold_all_languages_of_a_gram():
    f = L.fit({f"l{i:02}": [f"common word{chr(97 + i // 26)}{chr(97 + i % 26)}zz only"] for i in range(70)}, {})
    assert len(f.bits) == 2
    h, of = L.grams(*L.code_points(*L._text.utf8(pa.array(["common"]))))
    for plane, want in ((0, (1 << 64) - 1), (1, (1 << 6) - 1)):
        assert all(int(m) & want == want for m in f.masks(plane, h))
    assert L.predict(pa.array(["wordaczz", "nothing known", None, "12 3"]), f)[0][0] == "l02"


def test_grams_stay_in_their_row():
    one = lambda t: L.grams(*L.code_points(*L._text.utf8(pa.array([t]))))[0].tolist()
    texts = ["abc Def", "", "x", "12", "  déjà--vu ", "ab"]
    h, of = L.grams(*L.code_points(*L._text.utf8(pa.array(texts))))
    assert [h[of[i] : of[i + 1]].tolist() for i in range(len(texts))] == [one(t) for t in texts]
    assert one("ABC  def") == one("abc, Def")


M64 = (1 << 64) - 1


def plain_grams(t):
    """Four letters or gaps in a row, of which two are letters at least, as hashes; without arrays."""
    low = []
    for c in t or "":
        if unicodedata.category(c)[0] == "L":
            low.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
        elif not low or low[-1]:
            low.append(0)
    # one gap before, one after
    low = [0, *low, 0] if low else []
    out = []
    for i in range(len(low) - 3):
        four = low[i : i + 4]
        if sum(x > 0 for x in four) >= 2:
            h = 0
            for x in four:
                h = (h * 0x100000001B3 + x + 1) & M64
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
            out.append(h ^ (h >> 31))
    return out


def plain(learned, texts):
    """Languages and scores by a filter of plain sets."""
    langs = sorted(learned)
    top = {}
    for lang in langs:
        n = Counter(g for t in learned[lang] for g in plain_grams(t))
        top[lang] = sorted(n, key=lambda g: (-n[g], g))[: L.GRAMS]
    size = 1 << 14
    while size < L.HASHES * 8 * max(1, *(len(v) for v in top.values())):
        size *= 2
    size = min(size, 1 << 20)
    places = lambda g: [(g >> 20 * j) % size for j in range(L.HASHES)]
    bits = {lang: {p for g in top[lang] for p in places(g)} for lang in langs}
    out = []
    for t in texts:
        g = plain_grams(t)
        if not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out.append((L.UND, 0.0))
            continue
        score = {}
        for lang in langs:
            false = (len(bits[lang]) / size) ** L.HASHES
            hits = sum(all(p in bits[lang] for p in places(x)) for x in g)
            score[lang] = min(1.0, max(0.0, (hits / len(g) - false) / (1 - false))) if g else 0.0
        best = max(langs, key=lambda x: score[x])
        out.append((best, score[best]) if score[best] else (None, 0.0))
    return out


def test_against_brute_force(spark, sf_dir):
    """All documents, learned from all labelled rows that are not held out (fewer than the sample's bound)."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = {}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learned.setdefault(r["lang"], set()).add(r["text"])
    assert max(map(len, learned.values())) <= L.SAMPLE
    odd = [(-1, None, "en"), (-2, "", "en"), (-3, "x", None), (-4, "12 34", None), (-5, "ab cd", None), (-6, "日本語", None), (-7, "À la carte--déjà vu", None)]
    df = spark.createDataFrame([tuple(r) for r in rows] + odd, "doc_id long, text string, lang string").withColumn("mine", F.col("doc_id") >= 0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(df, ~L.held_out() & F.col("mine"), ["doc_id"]).collect()}
    texts = [(r["doc_id"], r["text"]) for r in rows] + [(d, t) for d, t, _ in odd]
    for (d, t), (lang, score) in zip(texts, plain(learned, [t for _, t in texts])):
        assert abs(got[d][1] - score) < 1e-9 and (lang is None or got[d][0] == lang), (d, t)


@pytest.mark.parametrize("ids", ["null", "equal", "repeated"])
def test_what_is_learned_does_not_hang_on_ids(spark, ids):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new = {"null": F.lit(None).cast("long"), "equal": F.lit(5).cast("long"), "repeated": F.col("doc_id") % 7}[ids]
    learn = F.col("own") % 4 != 2
    got = L.identify(docs.withColumn("own", F.col("doc_id")).withColumn("doc_id", new), learn, ["own", "lang"]).where("own % 4 = 2").collect()
    want = {r["own"]: (r["lang_pred"], r["score"]) for r in L.identify(docs.withColumn("own", F.col("doc_id")), learn, ["own"]).collect()}
    assert all(want[r["own"]] == (r["lang_pred"], r["score"]) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.97 * len(got)


def test_the_sample_has_its_size(spark):
    r = random.Random(3)
    rows = [(None, "a copy", "en")] * 500 + [(i, f"text {r.random()}", "en") for i in range(3000)] + [(i, f"texte {i % 50}", "fr") for i in range(400)] + [(1, "x" * (L.LONGEST_BYTES + 1), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, counts = L.sampled(docs, F.lit(True), 200)
    assert counts == {"en": 3500, "fr": 400, "de": 1} and {k: len(v) for k, v in texts.items()} == {"en": 200, "fr": 50}
    assert all(len(set(v)) == len(v) for v in texts.values())
