"""Exact Jaccard self-join of documents' word n-gram sets, with size-banded tiles and bitmap signatures.

Two documents link when 100 * |x and y| >= percent * |x or y|. The join is exact:

* Documents of equal sets are one class, named by the digest of the set; all that follows is on classes.
* Sets that link share k of the first |x| - ceil(percent |x| / 100) + k shingles of any global order (prefix
  filter), with k about a twentieth of |x|. The order here is by hash, except that the most frequent shingles of the
  corpus come last. So if less than k shingles of a prefix are common ones (in SEVERAL prefixes or more), its class
  meets every partner on another shingle, and the common ones are left out for it: passages which unlike documents
  share bring none of them together. Classes with more common ones keep them all.
* A tile holds the classes of two neighbouring size bands that share such a shingle: sets that link are in one band
  or in neighbouring ones.
* First each class is compared with two pivots of each of its tiles, which is linear in a group's size, and links are
  contracted to components. Then, in tiles that still hold more than one component (a few tiles of each class first, to
  contract groups that share many), classes of different components are compared: bitmaps of hashed shingles bound the overlap from above by |x| less the bits that y lacks, and what
  passes is verified by intersecting the sorted sets. Links inside a component are already known to connect. A large
  tile is cut into blocks of classes; two blocks at a time meet, so that no task holds the whole tile.

So no link between components is lost, and a group of copies is never expanded into its pairs.

Cases: null texts and texts without words have the empty set, link with nothing and are their own component; fewer
words than n are one shingle; repeated rows have equal sets; rows without a doc_id link as others do, and a component's
name is null only if all of it are without one; an empty table gives an empty result; columns other than doc_id and text are ignored. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text

N, PERCENT = 4, 85
LONGS = 16
#: Shingles of so many documents, at least, may come last in the order; so many of them at most.
FREQUENT, MOST_FREQUENT = 200, 50_000
#: A shingle in the prefixes of so many classes is common.
SEVERAL = 6
#: Of each class the first shingle of its prefix, so many of the last, which are the most common ones, and one in SAMPLED
#: of all are looked through before the rest is.
LAST, SAMPLED = 4, 12
#: Classes in a block of a large tile.
BLOCK = 256
#: What a text is fetched by: two texts may share a key, since digests tell which one is meant.
KEY = "coalesce(doc_id, xxhash64(text))"
SETS = "doc_id long, key long, n int, k int, c long, d long, prefix array<long>, bits array<long>"


def sets(col: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles, sorted, one row after another, and the rows' offsets."""
    data, off = _text.utf8(col)
    data = _text.lower(data)
    s, e, first = _text.words(data, off)
    x, of, _ = _text.ngrams(_text.spans(data, s, e), first, n)
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[keep], row[keep]
    return x, np.searchsorted(row, np.arange(len(of)))


def digests(x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each row's set."""
    c, d = (_text.spans(x, of[:-1], of[1:], lane).view(np.int64) for lane in (0, 1))
    return c, d


def bitmaps(x: np.ndarray, of: np.ndarray) -> pa.ListArray:
    """Each row's parity bitmap of hashed shingles, as LONGS longs."""
    size = np.diff(of)
    bits = np.zeros((len(size), LONGS), np.uint64)
    h = _text.mix(x ^ np.uint64(0x5BD1E995))
    np.bitwise_xor.at(bits.ravel(), np.repeat(np.arange(len(size)), size) * LONGS + (h % np.uint64(LONGS)).astype(np.int64), np.uint64(1) << ((h >> np.uint64(32)) & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * LONGS), pa.array(bits.ravel().view(np.int64)))


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap that a set of n shingles has with any set it links with."""
    return (percent * n + 99) // 100


def _counting(n: int):
    """Shingles that occur often in a task, with their counts; the tally drops single ones when it grows large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in _text.pieces(batches, "text"):
            x, k = np.unique(sets(b.column("text"), n)[0], return_counts=True)
            both, at = np.unique(np.concatenate([v, x]), return_inverse=True)
            v, c = both, np.bincount(at, np.concatenate([c, k]), len(both)).astype(np.int64)
            if len(v) > 500_000:
                v, c = v[c > 1], c[c > 1]
        often = c >= 4
        yield pa.RecordBatch.from_arrays([pa.array(v[often].view(np.int64)), pa.array(c[often])], ["x", "times"])

    return run


def frequent(docs: DataFrame, n: int = N) -> np.ndarray:
    """The shingles to come last, rarest first: a list of bounded length, counted over all documents."""
    counted = docs.select("text").mapInArrow(_counting(n), "x long, times long").groupBy("x").agg(F.sum("times").alias("times"))
    rows = counted.where(F.col("times") >= FREQUENT).orderBy(F.desc("times"), "x").limit(MOST_FREQUENT).collect()
    return np.array([r["x"] for r in reversed(rows)], np.int64).view(np.uint64)


def _signing(last: np.ndarray, n: int, percent: int):
    by_value = np.argsort(last)
    values = last[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.pieces(batches, "text"):
            x, of = sets(b.column("text"), n)
            size = np.diff(of)
            c, d = digests(x, of)
            rank = np.zeros(len(x), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, x), len(values) - 1)
                rank = np.where(values[at] == x, by_value[at] + 1, 0)
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((x, rank, row)) if len(values) else np.arange(len(x))
            k = 1 + size // 20
            length = np.where(size > 0, np.minimum(size, size - needed(size, percent) + k), 0)
            prefix = x[order][_text.ragged(of[:-1], length)].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("key"), pa.array(size.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(c), pa.array(d),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix)),
                    bitmaps(x, of),
                ],
                ["doc_id", "key", "n", "k", "c", "d", "prefix", "bits"],
            )

    return run


def _once(keys: pa.Array, ties: pa.Array, texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets of texts of which neighbouring rows may be the same (by key and hash), and each row's number among them."""
    k, h = keys.to_numpy(), ties.to_numpy()
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    return *sets(texts.take(pa.array(np.flatnonzero(new))), n), np.cumsum(new) - 1


def _verifying(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text.pieces(batches, "text_a"):
            for b in _text.pieces([batch], "text_b"):
                ca, cb = b.column("a").to_numpy(), b.column("b").to_numpy()
                xa, oa, ia = _once(b.column("doc_a"), b.column("tie_a"), b.column("text_a"), n)
                xb, ob, ib = _once(b.column("doc_b"), b.column("tie_b"), b.column("text_b"), n)
                # a key may stand on several texts: only the class's own counts
                right = np.flatnonzero((digests(xa, oa)[0][ia] == ca) & (digests(xb, ob)[0][ib] == cb))
                ok = []
                for i in right.tolist():
                    x, y = xa[oa[ia[i]] : oa[ia[i] + 1]], xb[ob[ib[i]] : ob[ib[i] + 1]]
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    common = int((y[at] == x).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        ok.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(ca[ok]), pa.array(cb[ok])], ["a", "b"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) of classes that link. Only texts of classes in a pair are read into a shuffle."""
    doc = classes.select("c", "doc")
    p = pairs.join(doc.withColumnsRenamed({"c": "a", "doc": "doc_a"}), "a").join(doc.withColumnsRenamed({"c": "b", "doc": "doc_b"}), "b")
    p = _io.bounded(p, "pairs")
    ids = _io.bounded(p.select(F.col("doc_a").alias("doc")).union(p.select("doc_b")).distinct(), "wanted")
    texts = docs.select("doc_id", F.expr(KEY).alias("doc"), F.xxhash64("text").alias("tie"), "text").join(ids, "doc", "left_semi")
    # rows without a doc_id have a key for each text: one row of each is enough
    texts = texts.where("doc_id is not null").drop("doc_id").unionByName(texts.where("doc_id is null").drop("doc_id").dropDuplicates(["doc", "tie"]))
    side = lambda x: texts.withColumnsRenamed({c: f"{c}_{x}" for c in ("doc", "tie", "text")})
    both = p.join(side("a"), "doc_a").join(side("b"), "doc_b")
    ok = both.sortWithinPartitions("doc_b", "tie_b", "doc_a", "tie_a").mapInArrow(_verifying(n, percent), "a long, b long").distinct()
    links = _io.saved(ok, "links")
    _io.discarded(p, ids)
    return links


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    _io.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = _io.settled(docs.withColumn("key", F.expr(KEY)).mapInArrow(_signing(frequent(docs, n), n, percent), SETS), "sets")
    # equal sets have equal columns
    classes = _io.saved(
        signed.where("n > 0").groupBy("c", "d").agg(F.min("key").alias("doc"), F.any_value("n").alias("n"), F.any_value("k").alias("k"), F.any_value("prefix").alias("prefix"), F.any_value("bits").alias("bits")),
        "classes",
    )
    rows = _io.saved(signed.select("doc_id", "n", "c"), "rows")
    _io.discarded(signed)
    at = classes.select("c", "n", "k", F.size("prefix").alias("size"), F.posexplode("prefix").alias("i", "x"))
    listed = at.select("c", "n", "k", "x", F.expr(f"i = 0 or i >= size - {LAST} or pmod(xxhash64(x), {SAMPLED}) = 0").alias("pick"))
    # a band ends where sets are too large to link with its smallest; of two classes only neighbouring bands can meet
    band = f"cast(floor(ln(n) / {1e-9 - float(np.log(percent / 100))!r}) as int)"
    many = listed.groupBy("x").agg(F.count("*").alias("times"), F.expr(f"max({band}) - min({band})").alias("apart"))
    met = _io.saved(listed.join(many.where("times > 2 or times = 2 and apart < 2").select("x", "times"), "x"), "met")
    full_of = met.where(F.col("times") >= SEVERAL).groupBy("c", "k").agg(F.count("*").alias("common")).where("common >= k").select("c", F.lit(True).alias("keeps"))
    keys = met.join(full_of, "c", "left").where((F.col("times") < SEVERAL) | F.col("keeps")).select("c", "n", "x", "pick")
    # a class is in its own tile and the one below; classes of one band meet in their own, so a tile needs one that it is the own of
    tiles = keys.withColumn("tile", F.explode(F.expr(f"array({band}, {band} - 1)"))).withColumn("own", F.expr(f"tile = {band}"))
    tiles = _io.settled(tiles, "tiles")
    prefixes, classes = classes, _io.saved(classes.select("c", "doc", "n", "bits"), "sizes")
    _io.discarded(met, prefixes)
    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    pivots = tiles.groupBy("x", "tile").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.bool_or("own").alias("some")).where("low <> high and some").drop("some")
    stars = tiles.join(pivots, ["x", "tile"]).select("c", "n", F.explode(F.array("low", "high")).alias("p")).where("c <> p").distinct()
    sizes = classes.select(F.col("c").alias("p"), F.col("n").alias("m"), F.col("bits").alias("other"))
    stars = stars.join(sizes, "p").where(near).join(classes.select("c", "bits"), "c").where(_bound("n", "m", "bits", "other", percent))
    stars = _io.settled(stars.select(F.least("c", "p").alias("a"), F.greatest("c", "p").alias("b")).distinct(), "stars")
    links = _verified(stars, classes, docs, n, percent)
    comp = _io.components(links)
    member = classes.select("c", "n", "bits").join(comp.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    member = _io.settled(member, "members")
    _io.discarded(links, comp)
    # classes of different components: first in a few tiles of each class, where those of a group that shares many tiles
    # meet as well but each pair only once or twice, and then in all tiles that still hold more than one component
    for some in (tiles.where("pick"), tiles):
        member = contracted(some, member, stars, band, classes, docs, n, percent)
    _io.discarded(tiles, stars, classes)
    of = member.select("c", "component")
    named = rows.where("n > 0").select("c", "doc_id").join(of, "c")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of.join(least, "component").select("c", "component_id")
    out = rows.join(of_class, "c", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.expr("if(n = 0, doc_id, component_id)").alias("component_id"))


def contracted(tiles: DataFrame, member: DataFrame, known: DataFrame, band: str, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """member with those components made one between which classes of one tile link; pairs in ``known`` were compared before."""
    found = _between(tiles, member, band, percent)
    if found is None:
        return member
    more = _verified(found.join(known, ["a", "b"], "left_anti"), classes, docs, n, percent)
    _io.discarded(found)
    if not more.limit(1).count():
        return member
    of = member.select("c", "component")
    ends = more.join(of.withColumnsRenamed({"c": "a", "component": "p"}), "a").join(of.withColumnsRenamed({"c": "b", "component": "q"}), "b")
    comp = _io.components(ends, "p", "q")
    top = comp.withColumnsRenamed({"component": "top", "node": "component"})
    new = _io.settled(member.join(top, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top"), "members")
    _io.discarded(more, comp, member)
    return new


def _between(tiles: DataFrame, member: DataFrame, band: str, percent: int) -> DataFrame | None:
    """Pairs (a, b) of classes that share a tile, are in different components and may link; None if no tile holds two components."""
    names = _io.bounded(member.select("c", "component"), "names")
    placed = tiles.select("x", "tile", "c", "own").join(names, "c")
    split = placed.groupBy("x", "tile").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.bool_or("own").alias("some")).where("low <> high and some")
    # a row for each tile, written, so that the rows of a large one can be split among tasks where they meet it
    split = _io.bounded(split.select("x", "tile", F.expr(f"cast(ceil(size / {BLOCK}) as int)").alias("blocks")), "split")
    if not split.limit(1).count():
        _io.discarded(names, split)
        return None
    # a class is in one block of its tile and meets all blocks; a tile of one block is joined as it is
    open_ = tiles.select("x", "tile", "c").join(split, ["x", "tile"]).join(member, "c").withColumns({"band": F.expr(band), "block": F.expr("pmod(xxhash64(c), blocks)")})
    open_ = open_.withColumn("other_block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("block", "other_block"), "hi": F.greatest("block", "other_block")})
    open_ = _io.settled(open_.select("x", "tile", "lo", "hi", "block", "band", "c", "n", "component", "bits"), "open")
    one = open_.withColumnsRenamed({"c": "a"})
    two = open_.withColumnsRenamed({"c": "b", "block": "block_b", "band": "band_b", "n": "m", "component": "of", "bits": "other"})
    # two of one block meet where it meets itself, two of one band in two tiles: one is enough
    apart = f"a < b and (block <> block_b or lo = hi) and component <> of and tile = least(band, band_b) and 100 * least(n, m) >= {percent} * greatest(n, m)"
    pairs = _io.saved(one.join(two, ["x", "tile", "lo", "hi"]).where(apart).where(_bound("n", "m", "bits", "other", percent)).select("a", "b").distinct(), "between")
    _io.discarded(open_, split, names)
    return pairs


def _bound(n: str, m: str, x: str, y: str, percent: int) -> str:
    """Whether two sets may link: each bit in which they differ is a shingle that is not shared."""
    differ = " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(LONGS))
    return f"{100 + percent} * ({n} + {m} - ({differ})) >= {2 * percent} * ({n} + {m})"
