"""WARC round trip, and the reader on archives full of false gzip magics at any split."""

import gzip
import hashlib
import random
import zlib

import pytest

from tritmarts.llm import warc


def plain(rows):
    """(page_id, bytes, digest, kind, refers_to) of (page_id, html) rows."""
    first = {}
    for page_id, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and page_id is not None:
            first[p] = min(page_id, first.get(p, page_id))
    out = []
    for page_id, html in rows:
        p = (html or "").encode()
        again = p in first and sum((h or "").encode() == p for _, h in rows) > 1 and page_id != first[p]
        out.append((page_id, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response",
                    first[p] if again else None))
    return out


def test_round_trip(spark):
    long = "ä<p>x\r\n\r\nWARC/1.1</p>" * 30
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (9, long), (7, long), (8, long), (7, long), (None, long),
            (11, "y" * 99), (12, "y" * 99), (13, "z" * 100), (14, "z" * 100), (-5, "\x1f\x08\x00" * 400)]
    draw = random.Random(1)
    rows += [(100 + i, "".join(chr(draw.randrange(32, 0x2000)) for _ in range(draw.randrange(3000)))) for i in range(40)]
    df = spark.createDataFrame([(i, "http://a/\r\nb", h, "q", 5) for i, h in rows],
                               "page_id long, url string, html string, digest string, revisit int")
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_files_are_plain_gzip(spark, tmp_path):
    df = spark.createDataFrame([(i, "http://a/", "page %d " % i * 50) for i in range(30)], "page_id long, url string, html string")
    warc.write_archives(df.coalesce(2), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 30
    assert all(("page %d " % i * 50).encode() in text for i in range(30))


@pytest.mark.parametrize("size", [400, 3000, 100000])
def test_false_magics_at_any_split(spark, tmp_path, size):
    """Stored blocks keep the payload's bytes, so every magic in it is a false find."""
    draw = random.Random(size)
    want, files = {}, []
    for f in range(2):
        data = b""
        for i in range(12):
            page = f * 100 + i
            payload = b"".join(draw.choice([warc.MAGIC, warc.MAGIC + b"\x00" * 7, b"abc", b"\x00\xff"]) for _ in range(draw.randrange(300)))
            record = warc.Record("response", f"<urn:page:{page}>", "http://a/", None, "", len(payload), payload)
            whole = zlib.decompress(warc.member(record), 31)
            pack = zlib.compressobj(0, zlib.DEFLATED, 31)
            data += pack.compress(whole) + pack.flush()
            want[f"<urn:page:{page}>"] = payload
        path = tmp_path / f"{f}.warc"
        path.write_bytes(data)
        files.append(str(path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = warc.read_archives(spark, str(tmp_path / "*.warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(want)
    assert {r.record_id: bytes(r.payload) for r in got} == want


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
