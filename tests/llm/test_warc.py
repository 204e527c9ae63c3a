from __future__ import annotations

import gzip
import io

from tracemill.llm import warc


def read(raw):
    return list(warc.records(io.BytesIO(raw)))


def test_round_trip_with_odd_rows(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (None, "u v\n", ""), (3, "", "é" * 400_000), (3, "", "é" * 400_000), (-5, "http://b/", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS path", "2 AS payload", "3 AS offset")
    got = sorted(((r.page_id, r.url, r.html, r.digest_ok) for r in warc.round_trip(spark, df).collect()), key=str)
    want = [(i, u.replace(" ", "%20").replace("\n", "%0A") if u else u, h, True) for i, u, h in rows]
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, df.where("false")).collect() == []


def test_members_are_read_one_by_one():
    a, b = warc.record(b"one", uri="u", record_id="x"), warc.record(b"two" * 500_000, uri="v", record_id="y")
    got = read(a + b)
    assert [(r["payload"][:3], r["offset"], r["digest_ok"], r["target_uri"]) for r in got] == [(b"one", 0, True, "u"), (b"two", len(a), True, "v")]
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\n") and gzip.decompress(a).endswith(b"\r\n\r\none\r\n\r\n")
    assert read(b"") == []


def test_damage_is_told_and_passed_over():
    a, b, c = (warc.record(x, uri="u", record_id="i") for x in (b"one", b"two", b"three"))
    bad = bytearray(b)
    bad[len(b) // 2] ^= 0xFF
    got = read(a + bytes(bad) + c)
    assert got[0]["payload"] == b"one" and got[-1]["payload"] == b"three" and any("error" in r for r in got)
    assert "cut off" in read(a + b[:-4])[-1]["error"]
    assert "error" in read(b"junk that is no gzip")[0]


def test_framing_and_digests():
    def one(head, body):
        return read(gzip.compress(b"WARC/1.0\r\n" + head + b"\r\n\r\n" + body))[0]

    assert one(b"Content-Length: 3\r\nWARC-Block-Digest: sha1:AAAA", b"abc\r\n\r\n")["digest_ok"] is False
    assert one(b"Content-Length: 3\r\nWARC-Block-Digest: md5:900150983cd24fb0d6963f7d28e17f72", b"abc\r\n\r\n")["digest_ok"] is True
    assert one(b"Content-Length: 3\r\nWARC-Block-Digest: sha1:a9993e364706816aba3e25717850c26c9cd0d89d", b"abc\r\n\r\n")["digest_ok"] is True
    assert one(b"X: " + b"y" * 300_000 + b"\r\nContent-Length: 3", b"abc\r\n\r\n")["payload"] == b"abc"
    assert "line ends" in one(b"Content-Length: 3", b"abc\r\n\r\n" + b"z" * 5_000_000)["error"]
    assert "digest_ok" not in one(b"Content-Length: 3", b"abc\r\n\r\n")
    assert "shorter" in one(b"Content-Length: 9", b"abc\r\n\r\n")["error"]
    assert "line ends" in one(b"Content-Length: 2", b"abc\r\n\r\n")["error"]
    assert "content length" in one(b"X: y", b"")["error"]
    assert one(b"content-length: 1\r\nWARC-Target-URI: a\r\n b", b"x\r\n\r\n")["target_uri"] == "a b"


def test_files_are_split_by_size(spark):
    df = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 50) AS html").coalesce(1)
    files = warc.write_warc(df, file_bytes=2000)
    assert files.count() > 3
    got = warc.read_warc(files.union(spark.createDataFrame([(None,)], "path string"))).collect()
    assert len(got) == 50 and all(r.digest_ok and r.error is None for r in got)
