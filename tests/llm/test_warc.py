import base64
import hashlib

from pyspark.sql import functions as F

from tapeforge.llm import warc


def sha(p):
    return base64.b32encode(hashlib.sha1(p).digest()).decode()


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "http://a/\r\nb é", ""), (7, "again", "same"), (7, "again", "same"), (3, "u", "same"),
             (None, "n", "solo"), (None, "n", "same"), (200, "long", "ä" * 3_000_000), (201, "crlf", "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, 0, 0) for r in rows], "page_id long, url string, html string, digest int, size int").repartition(3)
    index = warc.write(pages, str(tmp_path), frame_bytes=2000)
    got = warc.read(spark, index, str(tmp_path)).collect()
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    keeper = {}
    for i, p in payloads:
        if i is not None:
            keeper[p] = max(keeper.get(p, i), i)
    want = [(i, len(p), sha(p), "response" if keeper.get(p) in (i, None) else "revisit",
             None if keeper.get(p) in (i, None) else keeper[p]) for i, p in payloads]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert index.groupBy("bundle", "frame").count().count() > 3
    one = warc.lookup(index, str(tmp_path), F.col("page_id") == 33).first().record
    headers, body, end = warc.parse(one, 0)
    assert headers["WARC-Record-ID"] == "<urn:page:33>" and end == len(one)
    assert warc.read(spark, warc.write(pages.limit(0), str(tmp_path)), str(tmp_path)).count() == 0


def test_small_payloads_need_not_be_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "x" * 50), (4, "u", "x" * 50)], "page_id long, url string, html string")
    got = warc.read(spark, warc.write(pages, str(tmp_path), min_revisit_bytes=10), str(tmp_path)).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
