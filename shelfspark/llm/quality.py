"""Quality rules as weak supervision.

Each rule votes for a document (1), against it (-1), or abstains (0). Expectation-maximisation over the counts of
vote patterns (a bounded table: 3 to the power of the number of rules, counted in Spark over all documents that the base
rule lets through) estimates how often each rule votes and errs in good and in bad documents, and the share of good
ones. A document's posterior probability of being good, not an all-must-pass filter, decides.

Cases: null, empty and blank texts have no words, fail the base rule, and get the posterior of their votes as every
document does; repeated rows count as often as they occur; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text

SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_ended long, n_lines long, long_words long, plain_words long"


def _by_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which elements are, in their row, not the first or not the only one of their hash: (later, any)."""
    key = _text.mix(h ^ _text.mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, found = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return np.stack([later, found])


def features(col: pa.Array) -> dict[str, np.ndarray]:
    data, off = _text.utf8(col)
    s, e, first = _text.words(data, off)
    n = np.diff(first)
    start = np.ones(len(data), bool)
    start &= (data & 0xC0) != 0x80
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(start, out=before[1:])
    width = before[e] - before[s]
    # lines with a word, by their start and end
    breaks = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([off[:-1], breaks + 1]))
    ls = ls[ls < len(data)]
    le = np.searchsorted(breaks, ls)
    ends = np.append(breaks, len(data))[le]
    row = np.searchsorted(off, ls, "right") - 1
    le = np.minimum(ends, off[row + 1])
    worded = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le, row = ls[worded], le[worded], row[worded]
    dup = _repeats(row, _text.spans(data, ls, le))[0]
    last = e[np.maximum(np.searchsorted(s, le) - 1, 0)] - 1
    ended = np.isin(data[last], np.frombuffer(b'.!?":;', np.uint8)) if len(last) else np.zeros(0, bool)
    # words of letters alone, but for one mark at the end
    mark = ~(((data | 32) - np.uint8(97) < 26) | (data >= 128))
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mark, out=marks[1:])
    odd = marks[e] - marks[s]
    plain = (odd == 0) | ((odd == 1) & (width > 1) & np.isin(data[e - 1], np.frombuffer(b".,;:!?\"'", np.uint8)))
    # words in three-word windows that recur
    long = np.where(n >= 3, n - 2, 0)
    of = np.zeros(len(n) + 1, np.int64)
    np.cumsum(long, out=of[1:])
    at = np.arange(of[-1]) - np.repeat(of[:-1], long) + np.repeat(first[:-1], long)
    w = _text.Rolling(_text.spans(data, s, e), 0xC2B2AE3D27D4EB4F)
    twice = _repeats(np.repeat(np.arange(len(n)), long), w.spans(at, at + 3))[1]
    covered = np.zeros(len(s) + 3, bool)
    for j in range(3):
        covered[at[twice] + j] = True
    return {
        "n_words": n,
        "word_chars": _by_row(width, first),
        "n_symbols": _by_row(np.isin(data, SYMBOLS), off),
        "n_dup_lines": np.bincount(row[dup], minlength=len(n)),
        "n_repeat_words": _by_row(covered[: len(s)], first),
        "n_upper": _by_row((data - np.uint8(65)) < 26, off),
        "n_ended": np.bincount(row[ended], minlength=len(n)),
        "n_lines": np.bincount(row, minlength=len(n)),
        "long_words": _by_row(width > 25, first),
        "plain_words": _by_row(plain, first),
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _text.pieces(batches, "text"):
        f = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in f.values()]], ["doc_id", *f])


#: A rule's name, where it speaks against a document, and where it speaks for it; else it abstains.
RULES = [
    ("symbols", "n_symbols > 0.1 * n_words", "n_words > 0 and n_symbols <= 0.01 * n_words"),
    ("capitals", "n_upper > 0.3 * word_chars", "n_words > 0 and n_upper <= 0.1 * word_chars"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_lines >= 2 and n_dup_lines = 0"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "n_words >= 50 and n_repeat_words <= 0.05 * n_words"),
    ("length", "n_words < 30", "n_words >= 100"),
    ("width", "n_words > 0 and (word_chars < 2.5 * n_words or word_chars > 12 * n_words)", "n_words > 0 and word_chars between 3.5 * n_words and 7 * n_words"),
    ("endings", "n_lines >= 3 and n_ended < 0.3 * n_lines", "n_lines > 0 and n_ended >= 0.9 * n_lines"),
    ("plain words", "plain_words < 0.6 * n_words", "n_words > 0 and plain_words >= 0.85 * n_words"),
]

#: Votes (against, none, for) that each rule is taken to have cast before any is counted, on bad and on good documents: a
#: rule is right rather than wrong. A few documents outweigh it.
PRIOR_VOTES = np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good by pattern, the prior, and P(vote | class) as rules x classes (bad, good) x votes (-1, 0, 1).

    Abstaining is a vote of its own here: whether a rule speaks at all may depend on the class. Starts from the sum of
    the votes; nothing binds the estimates but PRIOR_VOTES. A pattern with count 0 takes its posterior from the others.
    """
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    post = 1 / (1 + np.exp(-patterns.sum(1, dtype=float)))
    table, prior = np.tile(PRIOR_VOTES / PRIOR_VOTES.sum(1, keepdims=True), (patterns.shape[1], 1, 1)), 0.5
    for _ in range(rounds):
        for c, p in enumerate((1 - post, post)):
            votes = np.einsum("n,nrv->rv", counts * p, hot) + PRIOR_VOTES[c]
            table[:, c] = votes / votes.sum(1, keepdims=True)
        prior = float((counts @ post + 1) / (counts.sum() + 2))
        like = np.einsum("nrv,rcv->nc", hot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -700, 700)))
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    return post, prior, table


def scored(docs: DataFrame) -> DataFrame:
    """All features by document, posterior, base_failed and kept."""
    _io.ship(docs.sparkSession)
    spark = docs.sparkSession
    vote = lambda bad, good: F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0))
    code = sum(((vote(b, g) + 1) * 3**i for i, (_, b, g) in enumerate(RULES)), F.lit(0))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    f = docs.select("doc_id", "text").mapInArrow(_features, FEATURES)
    f = _io.saved(f.withColumn("pattern", code.cast("int")).withColumn("base_failed", failed), "features")
    found = sorted((r["pattern"], r["n"]) for r in f.groupBy("pattern").agg(F.count_if(~F.col("base_failed")).alias("n")).collect())
    votes = np.array([[p // 3**i % 3 - 1 for i in range(len(RULES))] for p, _ in found], np.int64).reshape(len(found), len(RULES))
    post, _, _ = expectation_maximisation(votes, np.array([n for _, n in found], float))
    table = spark.createDataFrame([(p, float(q)) for (p, _), q in zip(found, post)], "pattern int, posterior double")
    out = f.join(F.broadcast(table), "pattern")  # 3 ** len(RULES) rows at most
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
