import base64
import hashlib

import pyarrow as pa
import pytest
from pyarrow import fs

from shelfspark.llm import _io, warc

PAGES = [(1, "http://a/é x", "<p>1</p>"), (2, "http://b", "<p>1</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nX: y", "é" * 100_000), (6, "u", "<p>6</p>\r\n\r\nWARC/1.1"), (7, "http://a", "<p>1</p>")]


def brute(pages, least=0):
    out = {}
    for p, _, h in pages:
        raw = (h or "").encode()
        top = max(q for q, _, k in pages if (k or "") == (h or ""))
        revisit = len(raw) >= least and top != p
        out[p] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None)
    return out


def rows(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


@pytest.mark.parametrize("least", [0, 5, 10**6])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, bundle string, frame int")
    assert rows(warc.round_trip(df, least)) == brute(PAGES, least)


def test_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    out = warc.round_trip(df)
    assert rows(out) == brute(pages)
    html = {p: h for p, _, h in pages}
    assert all(r["html"] == html[r["page_id"]] for r in out.where("record_type = 'response'").collect())


def test_empty_and_missing_ids(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, None, "b"), (1, None, "b")], "page_id long, url string, html string")
    assert warc.round_trip(df.limit(0)).collect() == []
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.round_trip(df).collect()) == [("1", "response", "None"), ("None", "response", "None"), ("None", "revisit", "1")]


def test_frames_and_seek_table(spark):
    folder = _io.fresh(spark, "warc-test")
    local, base = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    local.create_dir(base, recursive=True)
    b = warc.Bundle(local.open_output_stream(f"{base}/x", compression=None))
    records = [warc.record(i, f"http://{i}", bytes([i]) * 50_000, None) for i in range(40)]
    places = [b.add(r) for r in records]
    b.close()
    assert places[-1][0] > 3
    reader = warc.Reader(local.open_input_file(f"{base}/x"))
    for i in (39, 0, 17):
        assert reader.record(*places[i]) == records[i]
    # any Zstandard reader takes the whole bundle: frames one after another, the table is skipped
    whole = pa.CompressedInputStream(local.open_input_file(f"{base}/x"), "zstd").read()
    assert whole == b"".join(records)
    with pytest.raises(ValueError):
        warc.parse(records[3].replace(b"\3", b"\4"))


def test_a_payload_of_most_pages_is_dealt(spark, monkeypatch):
    """One payload in nine of ten pages: its pages are written by many tasks, without help from adaptive execution."""
    monkeypatch.setattr(warc, "MANY", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else the small table here leaves pages where they are
    try:
        pages = [(i, f"http://h/{i}", "<p>same</p>" if i % 10 else f"<p>{i % 70}</p>") for i in range(2000)]
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
        assert rows(warc.round_trip(df)) == brute(pages)
        index = warc.write(df, _io.fresh(spark, "warc"))
        per = [r["count"] for r in index.groupBy("bundle").count().collect()]
        assert len(per) == 8 and max(per) < 2 * len(pages) / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
