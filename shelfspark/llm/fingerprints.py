"""Document fingerprints: MinHash over five-word shingles, and near-duplicate classes from signature bands.

Each shingle's hash x goes through K universal permutations h(x) = (a x + b) mod 2**64, of which the
upper 32 bits count; a signature holds the K least values. All of it is vectorised numpy over Arrow buffers.

Near-duplicate classes: signatures are cut into bands of ROWS values; documents of an equal band are candidates. A
band's documents are compared with two of them first, the least and the greatest by digest, so that a group of copies
makes two candidates for each member and not all pairs; exact Jaccard similarity of PERCENT percent confirms them, and
links are contracted to components. Then, in bands that still hold more than one component, documents of different
components are compared (bitmaps bound the overlap, what passes is verified), and links are contracted again. So every
pair that shares a band is compared or already connected; a pair of PERCENT percent shares one with a chance of over
99.99 percent.

A-Z count as a-z. Nulls, empty texts and texts without words have no shingle and the constant empty signature, whose
likeness to itself is 1 and to any other 0. Texts with one to four words have one shingle, all their words.
Equal texts have equal fingerprints. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text, ngram_join

K, WORDS, SEED = 128, 5, 20260101
BANDS, ROWS, PERCENT = 25, 5, 80
NONE = np.uint32(0xFFFFFFFF)
BLOCK = 1 << 16
#: So many bands are looked through before all are.
SAMPLED = 2


def permutations(k: int = K, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, k, dtype=np.uint64)


def least(x: np.ndarray, first: np.ndarray, ab: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The K least hashes of each run first[i]:first[i+1] of x; a run without elements has NONE."""
    n, k = len(first) - 1, len(ab[0])
    out = np.full((n, k), NONE, np.uint32)
    if not len(x):
        return out
    x = x >> np.uint64(32)
    cuts = np.unique(np.concatenate([first[:-1][np.diff(first) > 0], np.arange(0, len(x), BLOCK)]))
    mins = np.empty((k, len(cuts)), np.uint64)
    h = np.empty(BLOCK, np.uint64)
    for at in range(0, len(x), BLOCK):
        piece = x[at : at + BLOCK]
        lo, hi = np.searchsorted(cuts, [at, at + BLOCK])
        local, into = cuts[lo:hi] - at, h[: len(piece)]
        for i in range(k):
            np.multiply(piece, ab[0][i], out=into)
            np.add(into, ab[1][i], out=into)
            mins[i, lo:hi] = np.minimum.reduceat(into, local)
    full = np.flatnonzero(np.diff(first) > 0)
    out[full] = (np.minimum.reduceat(mins, np.searchsorted(cuts, first[full]), axis=1) >> np.uint64(32)).T
    return out


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and first index by row; ends of the words, and each row's first word."""
    data, off = _text.utf8(col)
    data = _text.lower(data)
    s, e, first = _text.words(data, off)
    x, of, _ = _text.ngrams(_text.spans(data, s, e), first, WORDS)
    return x, of, e - np.repeat(off[:-1], np.diff(first)), first


def signatures(texts: list[str | None], ab: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    x, of, _, _ = shingles(pa.array(texts, pa.large_string()))
    return least(x, of, ab or permutations())


def written(sig: np.ndarray) -> list[str]:
    """The lower 16 bits of each value, in hexadecimal."""
    return [bytes(r).hex() for r in (sig & 0xFFFF).astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal values, as it can be read off two written fingerprints; empty is like empty only."""
    void_a, void_b = (a == NONE).all(1), (b == NONE).all(1)
    share = ((a & 0xFFFF) == (b & 0xFFFF)).mean(1)
    return np.where(void_a | void_b, (void_a & void_b).astype(float), share)


FINGERPRINT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each followed by the next document; the last row of a partition is only that."""
    ab = permutations()
    ids: list = []
    texts: list[str] = []
    over = False
    for batch in _text.pieces(batches, "text"):
        if over:
            continue
        halo = batch.column("halo").to_pylist()
        if True in halo:
            batch, over = batch.slice(0, halo.index(True) + 1), True
        ids, texts = ids + batch.column("doc_id").to_pylist(), texts + [t or "" for t in batch.column("text").to_pylist()]
        if len(ids) > 1:
            yield _block(ids, texts, ab)
            ids, texts = ids[-1:], texts[-1:]


def _block(ids: list, texts: list[str], ab: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    m = len(ids) - 1
    keep = [len(t) - len(t) // 3 for t in texts[:m]]
    heads = [t[:k] for t, k in zip(texts, keep)]
    edited = [h + n[: len(t) - k] for h, n, t, k in zip(heads, texts[1:], texts, keep)]
    x, of, end, first = shingles(pa.array(texts, pa.large_string()))
    ex, eof, _, _ = shingles(pa.array(edited, pa.large_string()))
    # shingles of words that end, and are followed by white space, before the edit are in both texts
    cut = np.array([len(h.encode()) for h in heads] + [0])
    whole = np.add.reduceat(np.append((end < np.repeat(cut, np.diff(first))).astype(np.int64), 0), first[:-1]) * (np.diff(first) > 0)
    same = np.maximum(0, whole - WORDS + 1)
    low = least(x, _cuts(of, same), ab)
    shared, sig = low[0::2], np.minimum(low[0::2], low[1::2])
    tail = least(ex, _cuts(eof, same[:m]), ab)[1::2] if m else sig[:0]
    esig = np.minimum(shared[:m], tail)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids[:m], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts[:m]], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": written(sig[:m]),
        "edited_fingerprint": written(esig),
        "near_edited": likeness(sig[:m], esig),
        "near_next": likeness(sig[:m], sig[1:]),
    })


def _cuts(of: np.ndarray, same: np.ndarray) -> np.ndarray:
    return np.append(np.stack([of[:-1], of[:-1] + same], 1).ravel(), of[-1])


def _bounds(rows: DataFrame, n: int) -> list:
    """Places in the order that cut the rows into about n runs of like size, greatest first: a sample of 200 rows a run tells."""
    rate = min(1.0, 200 * n / max(1, rows.count()))
    drawn = (F.xxhash64(F.lit("bounds"), "doc_id", "tie").bitwiseAND((1 << 52) - 1) / float(1 << 52)) < rate
    sample = sorted((tuple(r[0]) for r in rows.where(drawn).select(F.expr(ORDER)).distinct().collect()), reverse=True)
    return [sample[len(sample) * i // n] for i in range(1, n)] if len(sample) >= n else sample[1:]


#: The order of documents, descending: those without a doc_id last, equal ones by their text's hash.
ORDER = "named_struct('k', doc_id is not null, 'doc', coalesce(doc_id, 0L), 'tie', tie)"


def in_sequence(docs: DataFrame) -> DataFrame:
    """Partitions of consecutive documents by descending doc_id, each ending with its successor's copy (halo).

    The first document of each partition is sent to the one before it too (the first of all: to the last). Nulls come
    last; repeated doc_ids follow the hash of their text. One shuffle of the texts. The driver sees a bounded sample of
    the ids, and one row for each partition.
    """
    n = _io.parts(docs.sparkSession)
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    cuts = sorted(set(_bounds(df.select("doc_id", "tie"), n)), reverse=True) if n > 1 else []
    long = lambda v: f"({v}L)" if v != -(1 << 63) else "long('-9223372036854775808')"
    place = lambda c: f"named_struct('k', {str(c[0]).lower()}, 'doc', {long(c[1])}, 'tie', {long(c[2])})"
    bucket = "0"
    if cuts:
        steps = max(1, len(cuts).bit_length())
        bounds, middle = "array(" + ",".join(map(place, cuts)) + ")", "int((s.lo + s.hi) div 2)"
        # the number of bounds that are greater than the row's place, by bisection
        bucket = (
            f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> "
            f"if(s.lo >= s.hi, s, if(element_at({bounds}, {middle} + 1) > place, named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle}))), s -> s.lo)"
        )
    df = df.withColumn("place", F.expr(ORDER)).withColumn("bucket", F.expr(bucket).cast("int"))
    heads = {r["bucket"]: tuple(r["m"]) for r in df.groupBy("bucket").agg(F.max("place").alias("m")).collect()}
    if not heads:
        return df.select("doc_id", "text", F.lit(False).alias("halo"))
    there = sorted(heads)
    before = dict(zip(there, [there[-1], *there[:-1]]))
    size = max(there) + 1
    head = "array(" + ",".join(place(heads.get(i, (False, 0, 0))) for i in range(size)) + ")"
    previous = "array(" + ",".join(str(before.get(i, 0)) for i in range(size)) + ")"
    own, copy = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("halo")), F.struct(F.expr(f"element_at({previous}, bucket + 1)").alias("to"), F.lit(True).alias("halo"))
    dealt = df.withColumn("x", F.explode(F.when(F.expr(f"place = element_at({head}, bucket + 1)"), F.array(own, copy)).otherwise(F.array(own))))
    return (
        dealt.select("doc_id", "text", "tie", "x.to", "x.halo")
        .repartitionById(size, F.col("to"))
        .sortWithinPartitions("halo", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
        .select("doc_id", "text", "halo")
    )


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document."""
    _io.ship(docs.sparkSession)
    return in_sequence(docs).mapInArrow(_pairs, FINGERPRINT_SCHEMA)


def _banding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ab = permutations()
    for b in _text.pieces(batches, "text"):
        x, of = ngram_join.sets(b.column("text"), WORDS)
        c, d = ngram_join.digests(x, of)
        sig = least(x, of, ab)[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, ROWS)
        bands = _text.spans(sig.ravel(), np.arange(len(sig)) * ROWS, (np.arange(len(sig)) + 1) * ROWS).view(np.int64)
        at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(of).astype(np.int32)), pa.array(c), pa.array(d), pa.ListArray.from_arrays(at, pa.array(bands))], ["doc_id", "n", "c", "d", "bands"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _text.pieces(batches, "text"):
        x, of = ngram_join.sets(b.column("text"), WORDS)
        yield pa.RecordBatch.from_arrays([pa.array(ngram_join.digests(x, of)[0]), pa.array(np.diff(of).astype(np.int32)), ngram_join.bitmaps(x, of)], ["c", "n", "bits"])


def _with_bits(member: DataFrame, tiles: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """member with size and bitmap of each class that shares a band with another component; null for the others."""
    placed = tiles.select("x", "tile", "c").join(member, "c")
    split = placed.groupBy("x", "tile").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("x", "tile")
    open_ = placed.join(split, ["x", "tile"], "left_semi").select("c").distinct()
    ids = _io.bounded(classes.join(open_, "c", "left_semi").select(F.col("doc").alias("doc_id")), "open")
    # a doc_id may stand on several texts: those of other classes do not count, since c is of the text
    made = docs.join(ids, "doc_id", "left_semi").mapInArrow(_bitmaps, "c long, n int, bits array<long>")
    out = _io.settled(member.join(made.dropDuplicates(["c"]), "c", "left"), "members")
    _io.discarded(member, ids)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and class_id: the smallest doc_id of the document's near-duplicate class. One row for each doc_id.

    Documents without a word are classes of their own; those without a doc_id are left out.
    """
    _io.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    signed = _io.settled(docs.mapInArrow(_banding, "doc_id long, n int, c long, d long, bands array<long>"), "bands")
    rows = _io.saved(signed.select("doc_id", "n", "c"), "rows")
    banding = _io.settled(signed.where("n > 0").groupBy("c", "d").agg(F.min("doc_id").alias("doc"), F.any_value("bands").alias("bands")), "classes")
    classes = _io.saved(banding.select("c", "doc"), "classes")
    _io.discarded(signed)
    banded = banding.select("c", F.posexplode("bands").alias("band", "h"))
    ends = banded.groupBy("band", "h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    tiles = _io.settled(banded.join(ends, ["band", "h"]).select(F.col("h").alias("x"), F.col("band").alias("tile"), "c", "low", "high", F.lit(True).alias("own")), "tiles")
    _io.discarded(banding)
    stars = tiles.select("c", F.explode(F.array("low", "high")).alias("p")).where("c <> p")
    stars = _io.saved(stars.select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct(), "stars")
    links = ngram_join._verified(stars, classes, docs, WORDS, PERCENT)
    comp = _io.components(links)
    member = tiles.select("c").distinct().join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    member = _with_bits(_io.settled(member, "members"), tiles, classes, docs)
    _io.discarded(links, comp)
    # in a few bands first, which joins most of a group whose members share many of them, and then in all
    for bands in (SAMPLED, BANDS):
        member = ngram_join.contracted(tiles.where(F.col("tile") < bands), member, stars, "tile", classes, docs, WORDS, PERCENT)
    of_class = classes.select("c", "doc").join(member.select("c", "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    of_class = _io.settled(of_class, "components")
    _io.discarded(tiles, stars, member, classes)
    first = of_class.groupBy("component").agg(F.min("doc").alias("class_id"))
    named = rows.where("n > 0").select("doc_id", "c").join(of_class.join(first, "component").select("c", "class_id"), "c").select("doc_id", "class_id")
    return named.unionByName(rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"))).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """fingerprints_with_edits and the documents' near-duplicate classes."""
    classes = _io.bounded(near_duplicates(docs), "classes")
    _io.collected(docs.sparkSession)
    return fingerprints_with_edits(docs).join(classes, "doc_id", "left")
