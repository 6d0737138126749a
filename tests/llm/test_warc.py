import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringStartsWith

from listingloom.llm import queries, warc

PAGES = [
    (5, "http://a/5", "<p>é same</p>"), (2, "http://a/2", "<p>é same</p>"), (9, None, "<p>é same</p>"), (1, "http://b/\r\nx", None),
    (3, "http://b", ""), (4, "u", "only"), (7, "u", "<p>\r\n\r\nWARC/1.1\r\n\r\n" * 9), (8, "u", "z" * 3_000_000), (8, "u", "z" * 3_000_000),
    (None, "n", "lonely"), (None, "n", "lonely"), (None, "n", "only"),
]


def brute(rows):
    by = {}
    for key, _, html in rows:
        if key is not None:
            by[html or ""] = min(by.get(html or "", key), key)
    for key, _, html in rows:
        raw = (html or "").encode()
        first = by.get(html or "")
        revisit = first is not None and key != first
        yield key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], PAGES])
def test_query_agrees_with_brute_force(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    df.repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    assert ordered(queries.op4_warc(spark, str(tmp_path)).collect()) == ordered(brute(rows))


def test_pages_of_the_test_tables(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert ordered(queries.op4_warc(spark, "/root/testdata/sf0.001").collect()) == ordered(brute(rows))


def test_payloads_and_predicates(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    warc.write_warc(df, f"{tmp_path}/w")
    back = warc.read_warc(spark, f"{tmp_path}/w")
    html = {r.record_id: bytes(r.payload).decode() for r in back.filter("record_type = 'response'").collect()}
    assert html["urn:record:7"] == PAGES[6][2] and html["urn:record:2"] == "<p>é same</p>" and html["urn:record:1"] == ""
    assert back.filter("record_type = 'revisit'").filter(F.col("payload").isNotNull()).count() == 0
    some = back.filter("record_type = 'revisit' and payload_bytes > 5 and url like 'http%'")
    assert [r.record_id for r in some.collect()] == ["urn:record:5"]
    assert [r.url for r in back.filter("record_id = 'urn:record:1'").collect()] == ["http://b/%0D%0Ax"]


def test_unwanted_payloads_are_not_decoded():
    raw = b"".join(gzip.compress(warc.record(k, f"http://x/{k}", b"p" * k, warc.payload_digest(b"p" * k), None)) for k in range(50))
    seen = {}
    tests = [EqualTo(("record_type",), "response"), StringStartsWith(("url",), "http://x/4")]
    found = list(warc.records(io.BytesIO(raw), ["record_id", "payload"], tests, seen))
    assert [len(r["payload"]) for r in found] == [4, *range(40, 50)] and seen["payloads"] == 11
    assert len(list(warc.records(io.BytesIO(raw), ["record_id"], [], seen))) == 50 and seen["payloads"] == 11


def test_payloads_that_fail_are_not_unpacked():
    payload = b"p" * 3_000_000
    raw = b"".join(warc.member(warc.record(k, "http://x", payload, warc.payload_digest(payload), None), 0) for k in range(20))
    assert gzip.decompress(raw).count(b"WARC-Type") == 20
    seen = {}
    assert len(list(warc.records(io.BytesIO(raw), ["record_id", "payload_bytes"], [], seen))) == 20
    assert seen["unpacked"] <= 20 * 2 * warc.HEAD_BYTES
    found = list(warc.records(io.BytesIO(raw), ["payload"], [EqualTo(("record_id",), "urn:record:7")], seen))
    assert [r["payload"] == payload for r in found] == [True] and seen["unpacked"] < len(payload) + 20 * 2 * warc.HEAD_BYTES
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(raw[:-9]), ["record_id"], []))


def other(kind, content_type, block, *more):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}>", *([f"Content-Type: {content_type}"] if content_type else []), *more, f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("together", [True, False])
def test_archives_of_other_makers(spark, tmp_path, together):
    whole = [
        other("warcinfo", "application/warc-fields", b"software: x\r\n\r\n"),
        other("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "WARC-Target-URI: <http://x/>"),
        other("response", "application/http;msgtype=response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n", "WARC-Payload-Digest: sha1:" + "A" * 32),
        other("resource", "text/dns", b"", "WARC-Target-URI: dns:x"),
        other("metadata", None, b"\xff no fields"),
        other("revisit", "application/http", b"HTTP/1.1 304 Not Modified\r\n\r\n"),
        other("conversion", "application/http", b"no head at all"),
    ]
    (tmp_path / "w").mkdir()
    raw = gzip.compress(b"".join(whole)) if together else b"".join(map(gzip.compress, whole))
    (tmp_path / "w" / "a.warc.gz").write_bytes(raw)
    back = warc.read_warc(spark, f"{tmp_path}/w")
    got = {r.record_type: (r.url, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in back.collect()}
    payloads = {"warcinfo": b"software: x\r\n\r\n", "request": b"", "response": b"3\r\nabc\r\n0\r\n\r\n", "resource": b"", "metadata": b"\xff no fields", "conversion": b"no head at all"}
    urls = {"request": "http://x/", "resource": "dns:x"}
    assert got == {k: (urls.get(k), len(p), p) for k, p in payloads.items()} | {"revisit": (None, None, None)}
    assert [r.payload_bytes for r in back.filter("record_type = 'metadata' and payload_bytes > 3").select("payload_bytes").collect()] == [len(payloads["metadata"])]


def test_damage_is_an_error():
    whole = gzip.compress(warc.record(1, "u", b"payload", warc.payload_digest(b"other"), None))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(whole), ["payload"], []))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(whole[:-20]), ["payload"], []))


def test_least_bytes_and_file_size(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "tiny" if i < 3 else "larger payload") for i in range(6)], "page_id long, url string, html string")
    warc.write_warc(df, f"{tmp_path}/w", least_bytes=10)
    kinds = {r.record_id[-1]: r.refers_to for r in warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert kinds == {"0": None, "1": None, "2": None, "3": None, "4": "urn:record:3", "5": "urn:record:3"}
