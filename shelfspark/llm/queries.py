"""The queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import bpe, curve, fingerprints, langid, linededup, ngram_join, packing, pii, pq, quality, sessions, substrings, warc
from shelfspark.llm._io import documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = langid.identify(docs, ~langid.held_out(), ["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coded(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymised(docs, counted="n_values")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.deduplicated(docs, counts=True)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.packed(documents(spark, sf_dir))


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.merged(sessions.conversation_events(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("vector"))
    coded, codebooks = pq.compressed(vectors)
    return pq.with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(pq.codebooks_digest(codebooks)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_substrings": op2_substrings,
    "op3_warc": op3_warc,
    "op4_language": op4_language,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_pii": op7_pii,
    "op8_ngram_join": op8_ngram_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_curve_packing": op11_curve_packing,
    "op12_sessions": op12_sessions,
    "op13_vector_codes": op13_vector_codes,
}
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * g + 1, 5))::int >> {0}) & 31) + 1, 1)"


def _crc32(text: str) -> str:
    """The CRC-32 of ASCII text in SQL: bit by bit, each character entering with its first bit."""
    byte = f"case when k % 8 = 0 then ascii(substr({text}, (k // 8 + 1)::int, 1)) else 0 end"
    step = f"xor(xor(a, {byte}) >> 1, 3988292384 * (xor(a, {byte}) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, range(0, 8 * length({text}))), lambda a, k: {step}), 4294967295)"


def _pq_round(n: int) -> str:
    """The codebooks after round n of those of round n - 1: parts are assigned, entries become their floored means."""
    return f"""a{n} as materialized (select vec_id, p, {_NEAREST} as e from x join c{n - 1} using (p) group by all),
  m{n} as (select p, e, list(floor(s::double / k)::bigint order by j) as w from (select x.p, a.e, j, sum(x.v[j]) as s, count(*) as k from x join a{n} a on a.vec_id = x.vec_id and a.p = x.p cross join (select unnest(range(1, (select len(v) + 1 from x limit 1))) as j) group by 1, 2, 3) group by 1, 2),
  c{n} as materialized (select c.p, c.e, coalesce(m.w, c.w) as w from c{n - 1} c left join m{n} m on m.p = c.p and m.e = c.e)"""


_DISTANCE = "list_sum(list_transform(list_zip(x.v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"
_NEAREST = f"min(({_DISTANCE}, e))[2]"

ORACLE_SQL: dict[str, str] = {
    # a window goes if it is not the first of its words; a word goes if it is in such a window
    "op2_substrings": f"""with d as (select doc_id, {_WORDS.format("text")} as ws from documents),
  win as (select doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') as k from (select doc_id, ws, unnest(range(0, len(ws) - 19)) as s from d where len(ws) >= 20)),
  later as (select doc_id, s from (select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from win) where r > 1),
  gone as (select distinct doc_id, unnest(range(s, s + 20)) as i from later),
  w as (select doc_id, unnest(ws) as word, unnest(range(0, len(ws))) as i from d),
  kept as (select w.doc_id, string_agg(word, ' ' order by w.i) as t, count(*) as n from w anti join gone on gone.doc_id = w.doc_id and gone.i = w.i group by 1)
select d.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id""",
    # five hexadecimal digits are four digits of base 32
    "op3_warc": f"""select page_id, strlen(p)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: {" || ".join(_DIGIT.format(k) for k in (15, 10, 5, 0))}), '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from (select page_id, coalesce(html, '') as p, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as top from pages)""",
    "op8_ngram_join": f"""with recursive d as (select doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} as ws from documents),
  s as (select doc_id, unnest(case when len(ws) >= 4 then list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' '))) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from d),
  n as (select doc_id, count(*) as n from s group by 1),
  l as (select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2) p
    join n p1 on p1.doc_id = x join n p2 on p2.doc_id = y where 100 * c >= 85 * (p1.n + p2.n - c)),
  reach as (select doc_id as x, doc_id as y from d union select r.x, l.y from reach r join l on l.x = r.y)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, (select min(y) from reach where reach.x = d.doc_id) as component_id from d left join n on n.doc_id = d.doc_id""",
    # each snapshot on its own, in full: sessions of all events up to each batch of each user
    "op12_sessions": f"""with i as (select conv_id, turn, conv_id::varchar as one, conv_id || ':' || turn as two from conversations where turn is not null and conv_id is not null),
  k as (select conv_id, turn, {_crc32("one")} as c, {_crc32("two")} as h from i),
  t as (select (2 * floor(conv_id / 8) + c % 2)::bigint as u, (c // 2) % 7200 + 300 * turn + h % 600 as s, h, h // 600 as g from k),
  ev as (select u, s, h, (floor(s / 900) + case when g % 5 = 0 then g % 4 else 0 end)::bigint as b from t),
  bs as (select u, b, lag(b) over (partition by u order by b) as prev from (select distinct u, b from ev)),
  marked as (select bs.u, bs.b as upto, ev.s, ev.h, ev.b, case when ev.s - lag(ev.s) over (partition by bs.u, bs.b order by ev.s) <= 600 then 0 else 1 end as brk from bs join ev on ev.u = bs.u and ev.b <= bs.b),
  numbered as (select *, sum(brk) over (partition by u, upto order by s) as sid from marked),
  ses as (select u, upto, sid, min(s) as lo, max(s) as hi, count(*) as n, count(*) filter (where b = upto) as n_new, sum(h) as h_sum, max(b) as last from numbered group by 1, 2, 3),
  v as (select * from ses where n_new > 0),
  gone as (select v.u, v.upto as by_at, v.lo as by_lo, o.last, o.lo from v join bs on bs.u = v.u and bs.b = v.upto join ses o on o.u = v.u and o.upto = bs.prev and o.lo between v.lo and v.hi)
select v.u as user, v.upto as batch, v.lo as start_s, v.hi as end_s, v.n as n_events, v.n_new,
  (select count(*) from gone g where g.u = v.u and g.by_at = v.upto and g.by_lo = v.lo) as n_retracted, v.h_sum::bigint as h_sum, r.by_at as retracted_batch, r.by_lo as retracted_start_s
from v left join gone r on r.u = v.u and r.last = v.upto and r.lo = v.lo""",
    "op13_vector_codes": f"""with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  x as materialized (select vec_id, p, q[p * len(q) // 16 + 1 : (p + 1) * len(q) // 16] as v from kept cross join (select unnest(range(0, 16)) as p)),
  c0 as (select p, e, v as w from x join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 64) using (vec_id)),
  {_pq_round(1)}, {_pq_round(2)},
  a as (select vec_id, p, min(({_DISTANCE}, e)) as b from x join c2 using (p) group by all),
  codes as (select vec_id, string_agg(printf('%02x', b[2]), '' order by p) as code, sum(b[1])::bigint as error from a group by 1),
  book as (select sha256(string_agg(array_to_string(w, ','), ',' order by p, e)) as d from c2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, d as codebooks_sha256 from codes join kept using (vec_id) cross join book""",
}
