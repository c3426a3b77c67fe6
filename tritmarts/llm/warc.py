"""WARC archives: one gzip member per record, written by Spark and read back by byte ranges.

Writing: each record is compressed to a member of its own.  Spark's text writer
puts the members into files through its commit protocol, so it reaches any store
and survives lost executors; the line separator it needs is an empty gzip member, which
decodes to nothing, so a file is a plain sequence of members.

Reading: Spark's text reader splits files into byte ranges, and with the gzip magic
as its line separator a task finds the magics of its range, owns what starts there
and reads the last one past the range's end.  The magic also occurs inside
compressed data, so a find is only a candidate: its header is decoded, then the
member.  A member cut by a false find is put together again from the pieces behind
it; where that crosses a range, the loose pieces of both ranges (one in many
megabytes) are joined in a small second step.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tritmarts.llm.tables import in_small_batches, scratch_path, written

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
#: equal payloads of fewer bytes are stored each
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    kind: str
    record_id: str
    uri: str
    refers_to: str | None
    digest: str
    size: int
    payload: bytes | None


def _id(page_id: int | None) -> str:
    return "<urn:page:unknown>" if page_id is None else f"<urn:page:{page_id}>"


def member(record: Record) -> bytes:
    """A gzip member of one WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {record.size}\r\n\r\n").encode()
    block = head + (record.payload if record.kind == "response" else b"")
    uri = re.sub(r"[\r\n]", "", record.uri)
    fields = [("WARC-Type", record.kind), ("WARC-Record-ID", record.record_id), ("WARC-Date", DATE),
              ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{record.digest}")]
    if record.refers_to:
        fields += [("WARC-Refers-To", record.refers_to), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> Record | None:
    """The record of one decoded member; None if it is no WARC record with an HTTP response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields.get("content-length", "0"))]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return Record(fields.get("warc-type", ""), fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""),
                  fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha256:"),
                  int(size[1]) if size else len(payload), payload)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "first_id", "revisit")))
        members = []
        for page_id, url, html, digest, first_id, revisit in rows:
            payload = (html.as_py() or "").encode()
            members.append(member(Record("revisit" if revisit.as_py() else "response", _id(page_id.as_py()),
                                         url.as_py() or "", _id(first_id.as_py()) if revisit.as_py() else None,
                                         digest.as_py(), len(payload), payload)))
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) to archives below ``path``.

    A null html is an empty payload.  Of rows with equal payloads of ``least`` bytes or more
    the one with the smallest page_id is a response and the others revisit it; rows
    that repeat that page_id are responses too, and a null page_id revisits if any id is
    known.  Payloads are told apart by SHA-256; only digests that occur more than once
    are joined back.
    """
    rows = in_small_batches(pages).select(F.col("page_id").cast("long"), "url", "html",
                        F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    long = F.octet_length(F.coalesce("html", F.lit(""))) >= least
    shared = (rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1 and first_id is not null").select("digest", "first_id"))
    revisit = F.coalesce(long & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    marked = rows.join(shared, "digest", "left").withColumn("revisit", revisit)
    members = marked.select("page_id", "url", "html", "digest", "first_id", "revisit").mapInArrow(_packed, "member binary")
    (members.select(F.col("member").cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path))


def _inflated(pieces: list[bytes]) -> tuple[bytes | None, bool]:
    """(content, more): content of the member that ``pieces`` make up, None if they make none; more: it may go on."""
    unpack = zlib.decompressobj(31)
    try:
        out = unpack.decompress(MAGIC.join([b"", *pieces]))
    except zlib.error:
        return None, False
    if not unpack.eof:
        return None, True
    return (None if unpack.unused_data.strip(b"\r\n\0") else out), False


_FIELDS = [("kind", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
           ("digest", pa.string()), ("size", pa.int64()), ("payload", pa.binary()),
           ("file", pa.string()), ("range_start", pa.int64()), ("seq", pa.int32()), ("loose", pa.binary())]
_SCHEMA = ("kind string, record_id string, uri string, refers_to string, digest string, size long, payload binary, "
           "file string, range_start long, seq int, loose binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), _FIELDS)],
                                      names=[n for n, _ in _FIELDS])


def _read(content: bytes, with_payload: bool) -> Record | None:
    """The record of a decoded member; a response's size and digest are those of the payload as it was read."""
    record = parse(content)
    if record and record.kind == "response":
        record = record._replace(size=len(record.payload), digest=hashlib.sha256(record.payload).hexdigest())
    return record and record._replace(payload=record.payload if with_payload else None)


def _records(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """Records of a task's ranges, and the pieces at a range's ends that belong to no member inside it."""
    at, held, seq, found_one = None, [], 0, False
    out: list[tuple] = []

    def loose(pieces: list[bytes]) -> None:
        nonlocal seq
        for p in pieces:
            out.append((None,) * 7 + (*at, seq, p))
            seq += 1

    def settle() -> None:
        """Decode as many held pieces as make whole members."""
        nonlocal held, found_one
        while held:
            for n in range(1, len(held) + 1):
                content, more = _inflated(held[:n])
                if not more:
                    break
            else:
                return
            if content is None:
                if not found_one:
                    loose(held[:1])  # before the first member: the end of one that began in an earlier range
                held = held[1:]
                continue
            found_one = True
            if content and (record := _read(content, with_payload)):
                out.append((*record, *at, -1, None))
            held = held[n:]

    def close() -> None:
        nonlocal held
        if at:
            settle()
            loose(held)  # the start of a member that goes on in a later range
            held = []

    for batch in batches:
        for value, file, start in zip(batch.column("value"), batch.column("file").to_pylist(),
                                      batch.column("range_start").to_pylist()):
            if (file, start) != at:
                close()
                at, held, seq, found_one = (file, start), [], 0, False
                if start == 0:
                    continue  # what stands before the file's first magic
            held.append(value.as_py())
            settle()
        if out:
            yield _batch(out)
            out.clear()
    close()
    if out:
        yield _batch(out)


def _mended(table: pa.Table, with_payload: bool) -> pa.Table:
    """Records of one file's loose pieces, in file order."""
    table = table.sort_by([("range_start", "ascending"), ("seq", "ascending")])
    held = table.column("loose").to_pylist()
    rows = []
    while held:
        for n in range(1, len(held) + 1):
            content, more = _inflated(held[:n])
            if not more:
                break
        if content and (record := _read(content, with_payload)):
            rows.append((*record, None, None, None, None))
        held = held[n if content is not None else 1:]
    return pa.Table.from_batches([_batch(rows)] if rows else [], schema=pa.schema(_FIELDS))


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (kind, record_id, uri, refers_to, digest, size, payload) of the archives below ``path``, as a written table.

    Files must not end in a compression suffix, or Spark decodes them whole before
    anything is split.  Members that are no WARC record are passed over.
    """
    found = written(
        spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
        .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("range_start"))
        .mapInArrow(lambda batches: _records(batches, with_payload), _SCHEMA), "warc_records")
    mended = found.where("loose is not null").groupBy("file").applyInArrow(
        lambda table: _mended(table, with_payload), _SCHEMA)
    names = ["kind", "record_id", "uri", "refers_to", "digest", "size", "payload"]
    return found.where("loose is null").select(names).union(mended.select(names))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row, as read back from archives."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    return read_archives(spark, path, with_payload=False).select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"),
        F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.when(number("refers_to") != "", number("refers_to").cast("long")).alias("refers_to"))
