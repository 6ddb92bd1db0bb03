"""Line deduplication by a deletion-neighbourhood join, in DataFrame and SQL functions alone.

A line goes if an equal line, or one within one edit (a character inserted, deleted or replaced), comes earlier:
in a document with a smaller doc_id, or before it in the same document. All lines are judged on the input.

Lines are first made distinct, so that a line that every document holds is one row. Each distinct line then emits
its variants as hashed keys, coarse ones first, so that only what has a partner at one level goes on to the next:

1. with one half deleted: what is within one edit of another line shares one such key with it;
2. with one eighth deleted;
3. with one character of that eighth deleted. Lines that replace a character share the variant and its place; a longer
   line's variant equals a shorter line.

For each key only its earliest line is kept by an aggregation, so that no group is joined with itself. That line is
then verified by edit distance. A line of n characters takes part with lines of n and n + 1 as the shorter one, and
of n - 1 as the longer.

Cases: blank lines are no duplicates and stay; null text stays null, empty text stays empty; rows without a doc_id
come last; rows of equal doc_id and different texts are in the order of their texts' hash; a repeated row keeps what the
first keeps; a document whose lines all go has empty text; other columns are passed through, whatever their names; an
empty table gives an empty result. Line breaks are \\n. Very long texts take time in proportion to their lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io

EIGHTH = 8
#: A document's name and place in the order: a missing doc_id sorts last, equal ones by their text's hash.
DOC = "named_struct('id', coalesce(doc_id, 9223372036854775807L), 'text', xxhash64(text))"


def _lines(docs: DataFrame) -> DataFrame:
    """doc, its line numbers i (from 0) and lines that are not blank."""
    # a document's name is made before its lines are, once, so that no line carries the text
    named = docs.where("text is not null").select(F.expr(DOC).alias("doc"), "text")
    d = named.select("doc", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return d.where("line rlike '[^ \\\\t-\\\\r]'")


def _halves(n: str = "n") -> str:
    """Keys with the latter or the former half deleted, for a shorter length q of n and of n - 1."""
    keys = [f"xxhash64({q}, {k}, {s})" for q in (n, f"{n} - 1") for k, s in ((0, f"left(line, ({q}) div 2)"), (1, f"right(line, ({q}) - ({q}) div 2)"))]
    return f"array({', '.join(keys)})"


def _eighths() -> str:
    """(q, j, key, middle) for each eighth j of a shorter length q: the key is of what is outside of it."""
    bound = lambda j: f"cast((q * ({j})) div {EIGHTH} as int)"
    row = (
        f"named_struct('q', q, 'j', j, 'key', xxhash64(q, j, left(line, {bound('j')}), right(line, q - {bound('j + 1')})), "
        f"'middle', substr(line, {bound('j')} + 1, n - {bound('j')} - (q - {bound('j + 1')})))"
    )
    return f"flatten(transform(filter(array(n, n - 1), q -> q >= 0), q -> transform(sequence(0, {EIGHTH} - 1), j -> {row})))"


def _recurring(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another row has: a count with map-side combine, and a join that can be split."""
    many = rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1").select(key)
    return rows.join(many, key, "left_semi")


def near(lines: DataFrame) -> DataFrame:
    """Of distinct lines (doc, i, line), those with an earlier line within one edit."""
    e = _recurring(lines.withColumn("n", F.length("line")).withColumn("x", F.explode(F.expr(_eighths()))).select("doc", "i", "n", "x.*").withColumn("key", F.xxhash64("key", "q")), "key")
    pos = "named_struct('doc', doc, 'i', i, 'middle', middle)"
    cut = "concat(left(middle, t - 1), substr(middle, t + 1))"
    # variant: its hash; side 0 has a character replaced, 1 is the shorter line, 2 the longer one
    same = f"transform(if(length(middle) = 0, cast(array() as array<int>), sequence(1, length(middle))), t -> named_struct('v', xxhash64(key, 0, n, t, {cut}), 'side', 0))"
    longer = f"if(n > q, transform(if(length(middle) = 0, cast(array() as array<int>), sequence(1, length(middle))), t -> named_struct('v', xxhash64(key, 1, {cut}), 'side', 2)), array(named_struct('v', xxhash64(key, 1, middle), 'side', 1)))"
    v = e.select("doc", "i", "middle", F.explode(F.expr(f"concat({same}, {longer})")).alias("x")).select("doc", "i", "middle", "x.v", "x.side").distinct()
    # the earliest of the group, or of its other side
    other = "case side when 1 then 2 when 2 then 1 else 0 end"
    first = v.groupBy("v", F.expr(other).alias("side")).agg(F.min(F.expr(pos)).alias("first"))
    found = v.join(first, ["v", "side"]).where("named_struct('doc', first.doc, 'i', first.i) < named_struct('doc', doc, 'i', i)")
    return found.where("levenshtein(middle, first.middle, 1) >= 0").select("doc", "i").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, i) of all lines that go."""
    lines = _lines(docs)
    n = F.length("line")
    hashed = lines.select("doc", "i", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"), n.alias("n"), F.expr(_halves("length(line)")).alias("halves"))
    distinct = _io.settled(hashed.groupBy("h", "g", "n").agg(F.min(F.struct("doc", "i")).alias("at"), F.any_value("halves").alias("halves")), "lines")
    keys = distinct.select("h", "g", "n", "at", F.explode("halves").alias("half"))
    some = _recurring(keys, "half").select("at.doc", "at.i").distinct()
    # the candidates' own text, once more from the documents
    lists = _io.bounded(some.groupBy("doc").agg(F.collect_set("i").alias("wanted")), "candidates")
    found = docs.select(F.expr(DOC).alias("doc"), "text").join(lists, "doc")
    # a text is split once, and each line taken by its number
    taken = "element_at(transform(array(split(text, '\n')), ls -> transform(wanted, k -> named_struct('i', k, 'line', ls[k]))), 1)"
    wanted = found.select("doc", F.explode(F.expr(taken)).alias("x")).select("doc", "x.i", "x.line").dropDuplicates(["doc", "i"])
    gone = _io.settled(near(wanted), "near")
    # every occurrence but the earliest of a line, and all of a line with an earlier neighbour
    whole = distinct.select("h", "g", "n", "at").join(gone.select(F.struct(F.col("doc"), F.col("i")).alias("at"), F.lit(True).alias("gone")), "at", "left")
    occurrences = hashed.select("doc", "i", "h", "g", "n")
    return occurrences.join(whole, ["h", "g", "n"]).where("gone or at.doc <> doc or at.i <> i").select("doc", "i")


def _left_over(text: str, gone: str) -> str:
    """SQL for text without the lines of the ascending numbers ``gone``: what is between two of them is taken in one piece."""
    start, end = f"if(j = 0, 0, {gone}[j - 1] + 1)", f"if(j = size({gone}), size(ls), {gone}[j])"
    runs = f"flatten(transform(sequence(0, size({gone})), j -> slice(ls, {start} + 1, {end} - {start})))"
    return f"element_at(transform(array(split({text}, '\n')), ls -> array_join({runs}, '\n')), 1)"


def deduplicated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs without the lines that go; ``counts`` adds n_lines and n_removed, in place of columns of these names."""
    doc, lines = _io.unused("lines_doc", docs), _io.unused("lines_gone", docs)
    gone = removed_lines(docs.select("doc_id", "text")).groupBy(F.col("doc").alias(doc)).agg(F.array_sort(F.collect_set("i")).alias(lines))
    df = docs.withColumn(doc, F.expr(DOC)).join(_io.bounded(gone, "gone"), doc, "left")
    kept = F.expr(f"if({lines} is null or text is null, text, {_left_over('text', lines)})")
    more = [F.expr("coalesce(size(split(text, '\n')), 0)").cast("long").alias("n_lines"), F.expr(f"if({lines} is null or text is null, 0, size({lines}))").cast("long").alias("n_removed")]
    names = [c for c in docs.columns if not (counts and c.lower() in ("n_lines", "n_removed"))]
    out = [kept.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names]
    return df.select(*out, *(more if counts else []))
