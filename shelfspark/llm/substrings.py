"""Substring deduplication with repeated-phrase automata.

A window is ``length`` consecutive words of a document. Each word goes that is in a window whose words also start
earlier: in a document with a smaller doc_id, or before it in the same one. Windows are judged on the input.

1. Seeds. Of each window's phrases of ``PHRASE`` words the one with the least hash is chosen (winnowing), so that equal
   windows have equal seeds at equal places, and about one word in seven begins a seed.
2. Confirmation. Seeds that occur twice or more are counted over all documents; the earliest occurrence owns the seed.
   The owner's words around it, in pieces of ``PIECE`` words, are the recurring passages.
3. Automata. Each document is brought together with the pieces that own its seeds. For each shard (a run of documents)
   one Aho-Corasick automaton over word codes holds a phrase for every window of the shard's pieces; all documents of
   the shard stream through it, and each hit is extended on both sides, word by word, to all windows in common.
4. Rest. A window that shares a seed with an owner's passage but differs from it may still be in another copy. Such
   windows are few; their digests are aggregated to their earliest occurrence. A window's earliest occurrence is
   either an owner's or among the rest itself, so that nothing is missed.

A seed that holds more than its share of all occurrences is dealt to several tasks where occurrences meet their owner.
Words are compared by their 64-bit hashes, windows of the rest by two hashes of their words'.

Cases: null and empty texts have no words and keep the digest of the empty text; a text of fewer than ``length`` words
has no window and keeps all; rows of equal doc_id are documents of their own, each judged against documents with smaller
ids and itself (so equal rows have equal results); rows with a null doc_id come after doc_ids below 2 ** 62, in the order
of a hash of their texts; an empty table gives an empty result; columns other than doc_id and text are ignored. Very long
texts are streamed in whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text

LENGTH, PHRASE, PIECE = 20, 8, 64
#: Text of the documents and passages of one automaton.
SHARD_BYTES = 1 << 20
#: A document's place in the order; its texts' hash tells rows of equal doc_id apart.
DOC = "coalesce(doc_id, 4611686018427387904L + (xxhash64(coalesce(text, '')) & 4611686018427387903L))"
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = _text.utf8(col)
    s, e, first = _text.words(data, off)
    return data, s, e, first, _text.spans(data, s, e)


def _least(x: np.ndarray, k: int, f=np.minimum) -> np.ndarray:
    """The least (or, by f, greatest) of each k consecutive elements."""
    out, width = x, 1
    while 2 * width <= k:
        out = f(out[:-width], out[width:])
        width *= 2
    return f(out[: len(out) - (k - width)], out[k - width :]) if k > width else out


def seeds(w: np.ndarray, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of the seeds of all windows; words are given by their hashes."""
    span = length - PHRASE + 1
    none = np.zeros(0, np.int64)
    if len(w) < length:
        return none, none, np.zeros(0, np.uint64)
    at = np.arange(len(w) - PHRASE + 1)
    g = _text.Rolling(w, 0xC2B2AE3D27D4EB4F).spans(at, at + PHRASE)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = _least(g, span)
    starts = len(w) - length + 1
    low = np.where(row[:starts] == row[length - 1 :], low[:starts], np.uint64(0))  # no window runs over a row's end
    # a phrase is a seed if it is the least of any window around it
    padded = np.zeros(len(g) + span - 1, np.uint64)
    padded[span - 1 : span - 1 + starts] = low
    top = _least(padded, span, np.maximum)
    chosen = np.flatnonzero((top[: len(g)] == g) & (g > 0))
    return row[chosen], chosen - first[row[chosen]], g[chosen]


def _seeding(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.pieces(batches, "text"):
            _, _, _, first, w = _words(b.column("text"))
            row, at, h = seeds(w, first, length)
            order = np.lexsort((at, h, row))
            once = np.ones(len(row), bool)
            once[order[1:]] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            doc = b.column("doc").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[row]), pa.array(at.astype(np.int32)), pa.array(once)], ["h", "doc", "at", "once"])

    return run


def _cutting(length: int):
    """The wanted pieces of each text, with the words around them that windows on their seeds need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = length - PHRASE, length
        for b in _text.pieces(batches, "text"):
            data, s, e, first, _ = _words(b.column("text"))
            out: list[tuple] = []
            for i, (doc, tie, wanted) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc", "tie", "wanted")))):
                for j in wanted:
                    lo, hi = max(0, j * PIECE - before), min(first[i + 1] - first[i], (j + 1) * PIECE + after)
                    if lo < hi:
                        out.append((doc, tie, j, lo, data[s[first[i] + lo] : e[first[i] + hi - 1]].tobytes().decode()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["owner", "tie", "piece", "start", "text"])

    return run


Name = tuple[int, int, int]


def located(docs: list[tuple[int, int, np.ndarray]], passages: dict[Name, tuple[int, np.ndarray]], length: int = LENGTH) -> list[np.ndarray]:
    """For each document (id, its text's hash, word hashes), whether the window at each word is in an earlier passage.

    passages: by owner (id, hash) and piece, where it starts in its owner, and its word hashes. One automaton holds all.
    """
    import ahocorasick

    found = [bytearray(max(0, len(w) - length + 1)) for _, _, w in docs]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    step = length - PHRASE + 1
    places: dict[tuple, list[tuple[Name, int]]] = {}
    for name, (_, w) in passages.items():
        codes = (w >> np.uint64(33)).astype(np.int64).tolist()
        # any window of a passage holds a phrase that starts at a multiple of step
        for at in range(0, len(codes) - PHRASE + 1, step):
            places.setdefault(tuple(codes[at : at + PHRASE]), []).append((name, at))
    if places:
        for phrase, where in places.items():
            automaton.add_word(phrase, where)
        automaton.make_automaton()
    for (doc, tie, w), flags in zip(docs, found):
        if not places or not flags:
            continue
        known: dict[tuple, int] = {}  # up to which word of the document a passage at a shift has been compared
        for end, where in automaton.iter(tuple((w >> np.uint64(33)).astype(np.int64).tolist())):
            at_doc = end - PHRASE + 1
            for name, at in where:
                # nothing is left to find where all windows around the phrase are known already
                if flags.find(0, max(0, at_doc - step + 1), at_doc + 1) < 0:
                    break
                shift = at_doc - at  # the passage's first word would be the document's word ``shift``
                if known.get((name, shift), -1) > end:
                    continue
                start, p = passages[name]
                if not (name[0] < doc or (name[:2] == (doc, tie) and start < shift)):
                    continue
                lo, hi = max(0, shift), min(len(w), shift + len(p))
                same = (w[lo:hi] == p[lo - shift : hi - shift]).tobytes()
                # the run of equal words around the phrase
                a = same.rfind(0, 0, at_doc - lo) + 1
                b = same.find(0, at_doc - lo)
                b = len(same) if b < 0 else b
                known[name, shift] = lo + max(b, end + 1 - lo)
                if b - a >= length:
                    flags[lo + a : lo + b - length + 1] = b"\1" * (b - length + 1 - a)
    return [np.frombuffer(f, bool) for f in found]


def covered(windows: np.ndarray, n: int, length: int = LENGTH) -> np.ndarray:
    """Which of n words are in one of the windows."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.flatnonzero(windows), 1)
    np.add.at(step, np.flatnonzero(windows) + length, -1)
    return np.cumsum(step[:n]) > 0


LOCATED = "doc long, tie long, doc_id long, n_words long, n_removed long, kept_sha256 string, found array<int>, rest array<struct<s:int,u:long,v:long>>, text string"


def _kept(data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray, gone: np.ndarray) -> list[str]:
    """The digest of each row's words that stay, joined by one space."""
    stay = np.flatnonzero(~gone)
    size = e[stay] - s[stay] + 1
    flat = np.append(data, np.uint8(32))[_text.ragged(s[stay], size)]
    ends = np.cumsum(size)
    flat[ends - 1] = 32
    ends = np.concatenate([[0], ends])
    cut = ends[np.searchsorted(stay, first)].tolist()
    raw = flat.tobytes()
    return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1], cut[1:])]


def _streaming(length: int):
    def shard(rows: list[dict]) -> pa.RecordBatch:
        """rows: in order of doc; kind 0 is a text, 1 the places of its seeds that others own, 2 a passage."""
        texts = [r for r in rows if r["kind"] == 0]
        marked = {r["doc"]: r["places"] for r in rows if r["kind"] == 1}
        owned = {(r["owner"], r["tie"], r["piece"]): r for r in rows if r["kind"] == 2}
        data, s, e, first, w = _words(pa.array([r["text"] for r in texts], pa.large_string()))
        _, ps, _, pfirst, pw = _words(pa.array([r["text"] for r in owned.values()], pa.large_string()))
        passages = {k: (r["start"], pw[pfirst[i] : pfirst[i + 1]]) for i, (k, r) in enumerate(owned.items())}
        docs = [(r["doc"], r["tie"], w[first[i] : first[i + 1]]) for i, r in enumerate(texts)]
        found = [f.copy() for f in located(docs, passages, length)]
        gone = np.zeros(len(w), bool)
        rests = []
        for i, (r, windows) in enumerate(zip(texts, found)):
            own, rest = docs[i][2], []
            if len(windows) and (places := marked.get(r["doc"])):
                at = np.unique((np.array(places)[:, None] - np.arange(length - PHRASE + 1)).ravel())
                at = at[(at >= 0) & (at < len(windows))]
                at = at[~windows[at]]
                u = _text.Rolling(own, 0xC2B2AE3D27D4EB4F).spans(at, at + length).view(np.int64)
                v = _text.Rolling(_text.mix(own + np.uint64(7))).spans(at, at + length).view(np.int64)
                # what the document itself holds earlier goes here and now
                order = np.lexsort((at, v, u))
                again = np.zeros(len(at), bool)
                again[order[1:]] = (u[order][1:] == u[order][:-1]) & (v[order][1:] == v[order][:-1])
                windows[at[again]] = True
                rest = [{"s": a, "u": x, "v": y} for a, x, y in zip(at[~again].tolist(), u[~again].tolist(), v[~again].tolist())]
            rests.append(rest)
            if windows.any():
                gone[first[i] : first[i + 1]] = covered(windows, len(own), length)
        digests = _kept(data, s, e, first, gone)
        out = []
        for i, (r, windows, rest) in enumerate(zip(texts, found, rests)):
            out.append((r["doc"], r["tie"], r["doc_id"], len(docs[i][2]), int(gone[first[i] : first[i + 1]].sum()), digests[i], np.flatnonzero(windows).tolist() if rest else [], rest, r["text"] if rest else None))
        kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.struct([("s", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 9, kinds)], ["doc", "tie", "doc_id", "n_words", "n_removed", "kept_sha256", "found", "rest", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for b in _text.pieces(batches, "text", 1 << 20):
            for r in b.to_pylist():
                if size > SHARD_BYTES and r["doc"] != rows[-1]["doc"]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["text"] or "")
        if rows:
            yield shard(rows)

    return run


def _finishing(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text.pieces(batches, "text"):
            removed, digest = b.column("n_removed").to_pylist(), b.column("kept_sha256").to_pylist()
            data, s, e, first, _ = _words(b.column("text"))
            gone = np.zeros(len(s), bool)
            changed = []
            for i, more in enumerate(b.column("more").to_pylist()):
                if more:
                    n = int(first[i + 1] - first[i])
                    windows = np.zeros(n, bool)
                    windows[[*b.column("found")[i].as_py(), *more]] = True
                    gone[first[i] : first[i + 1]] = own = covered(windows, n, length)
                    changed.append(i)
                    removed[i] = int(own.sum())
            if changed:
                new = _kept(data, s, e, first, gone)
                for i in changed:
                    digest[i] = new[i]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def owned(found: DataFrame) -> DataFrame:
    """(doc, at, owner, home) of the occurrences of recurring seeds, but for those of the owners themselves.

    Each seed's occurrences meet its one owner in a join. A seed with more than half a task's share of all occurrences
    is dealt to as many tasks as it has such shares; there are 2 * tasks of these seeds at most.
    """
    parts = _io.parts(found.sparkSession)
    seeds = found.groupBy("h").agg(F.count("*").alias("times"), F.min("doc").alias("owner"), F.expr("min_by(at, doc) filter (where once)").alias("home"))
    recurring = _io.settled(seeds.where("times > 1"), "recurring")
    total = recurring.agg(F.sum("times")).first()[0] or 0
    share = max(1, total // (2 * parts))
    salts = F.expr(f"cast(ceil(times / {share}) as int)")
    hot = _io.bounded(recurring.where(f"times > {share}").select("h", salts.alias("salts")), "hot")
    dealt = found.join(hot, "h", "left").withColumn("salt", F.expr("if(salts is null, 0, pmod(xxhash64(doc, at), salts))").cast("int"))
    owners = recurring.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(owners, ["h", "salt"]).select("doc", "at", "owner", "home").where("doc <> owner or at <> home")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    spark = docs.sparkSession
    _io.ship(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.expr(DOC).alias("doc")).withColumn("tie", F.xxhash64("text"))
    found = texts.select("doc", "text").mapInArrow(_seeding(length), "h long, doc long, at int, once boolean")
    shared = _io.settled(owned(found), "shared")
    pairs = shared.select("doc", "owner", F.expr(f"cast(home div {PIECE} as int)").alias("piece")).distinct()
    wanted = _io.bounded(pairs.select("owner", "piece").distinct().groupBy(F.col("owner").alias("doc")).agg(F.collect_set("piece").alias("wanted")), "wanted")
    # of rows of equal doc_id each gives the piece
    pieces = texts.join(wanted, "doc").select("doc", "tie", "text", "wanted").mapInArrow(_cutting(length), "owner long, tie long, piece int, start int, text string")
    pieces = _io.saved(pieces, "passages")
    places = shared.groupBy("doc").agg(F.collect_set("at").alias("places"))
    columns = {"doc": "long", "kind": "int", "tie": "long", "doc_id": "long", "text": "string", "places": "array<int>", "owner": "long", "piece": "int", "start": "int"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in columns.items()])

    together = rows(texts, 0).unionByName(rows(places, 1)).unionByName(rows(pairs.join(pieces, ["owner", "piece"]), 2))
    together = together.repartition(_io.parts(spark), "doc").sortWithinPartitions("doc", "kind")
    done = _io.settled(together.mapInArrow(_streaming(length), LOCATED), "located")
    _io.discarded(shared, pieces, wanted)
    rest = done.select("doc", "tie", F.explode("rest").alias("r")).select("doc", "tie", "r.s", "r.u", "r.v")
    first = rest.groupBy("u", "v").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("u", "v", "first")
    later = rest.join(first, ["u", "v"]).where("doc > first").groupBy("doc", "tie").agg(F.collect_set("s").alias("more"))
    out = done.join(_io.bounded(later, "later"), ["doc", "tie"], "left")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "found", "text", "more").mapInArrow(_finishing(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")
