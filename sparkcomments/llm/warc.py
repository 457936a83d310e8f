"""WARC: archives written by Spark's text writer, and a reader that salvages what it can.

Writing. Every record is a gzip member of its own. Spark's text writer puts the members into files, through whatever
file system the path names, with an empty member as separator; so a lost or repeated task leaves no half file. Archives
hold a bounded number of records.

Reading. A file is read member by member (or, uncompressed, record by record). Where a check fails (gzip CRC, version
line, Content-Length, block digest), the reader searches for the next valid member or version line, goes on there, and
reports the bytes in between as a gap. Uncompressed records that claim more bytes than the file holds, or that do not
end in the two line ends, are gaps up to the next version line.

Payloads equal to one of another record become revisits. Null payloads are empty ones. Repeated rows are records of
their own. An archive is one row of Spark's binary reader, which bounds it at 2 GB; writers here stay far below.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .common import shared_folder, table

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member, which readers of concatenated members pass over.
EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"

SCHEMA = ("file string, start long, length long, gap string, record_type string, record_id string, uri string, "
          "refers_to string, payload_digest string, payload_bytes long, payload binary")


def record(kind: str, key: str, uri: str | None, payload: bytes, digest: str, refers: str | None, date: str) -> bytes:
    """One record. digest: SHA-1 of the full payload in hexadecimal; a revisit names the payload and does not hold it."""
    code = base64.b32encode(bytes.fromhex(digest)).decode()
    block = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", date),
            ("WARC-Target-URI", re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", uri or "")),
            ("WARC-Payload-Digest", f"sha1:{code}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/octet-stream"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def revisits(df: DataFrame, payload: Column, key: str, least: int = 1000) -> DataFrame:
    """df with record_type, refers_to, payload_digest, payload_bytes and the payload in UTF-8: of equal payloads of at
    least that many bytes, the one with the greatest key is the response. Null keys never are, unless all are null."""
    body = F.coalesce(payload.cast("string"), F.lit("")).cast("binary")
    rows = df.withColumns({"payload": body}).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    same = ["payload_digest", "payload_bytes"]
    groups = (rows.where(F.col("payload_bytes") >= least).groupBy(*same)
              .agg(F.max(key).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    first = F.col("__first")
    is_first = first.isNull() | first.eqNullSafe(F.col(key))
    return (rows.join(groups, same, "left")
            .withColumn("record_type", F.when(is_first, "response").otherwise("revisit"))
            .withColumn("refers_to", F.when(~is_first, first)).drop("__first"))


def write(rows: DataFrame, path: str, key: str, uri: str, date: str = "2024-01-01T00:00:00Z",
          most_records: int = 5000) -> None:
    """Archives of the rows of revisits(), with that many records at most."""

    def members(kinds, keys, uris, payloads, digests, refers):
        none = lambda x: None if pd.isna(x) else x
        return pd.Series([gzip.compress(record(kind, k, none(u), bytes(p), d, none(r), date), 6, mtime=0)
                          for kind, k, u, p, d, r in zip(kinds, keys, uris, payloads, digests, refers)], dtype=object)

    member = pandas_udf(members, "binary")
    columns = [F.col("record_type"), F.coalesce(F.col(key).cast("string"), F.lit("none")), F.col(uri).cast("string"),
               F.col("payload"), F.col("payload_digest"), F.col("refers_to").cast("string")]
    # the writer puts out a string's bytes as they are; the option gives the separator its bytes
    (rows.select(member(*columns).cast("string").alias("value")).write.option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY.decode("ISO-8859-1")).option("maxRecordsPerFile", most_records).text(path))


#: Bytes that a member's inflation is fed at a time.
CHUNK = 1 << 16
#: Where a member or an uncompressed record may begin.
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/1\.")


def _inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """The content of the member at that place and where it ends; None if it is damaged. Reads no further than the
    chunk in which the member ends."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        for k in range(at, len(data), CHUNK):
            out.append(z.decompress(view[k:k + CHUNK]))
            if z.eof:
                return b"".join(out), min(k + CHUNK, len(data)) - len(z.unused_data)
    except zlib.error:
        pass
    return None


HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n:]+:[^\r\n]*\r\n)*)\r\n")


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int] | None:
    """The record at that place: headers, block and where it ends; None if a check fails."""
    m = HEAD.match(data, at)
    if not m:
        return None
    head = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace")
            for k, _, v in (line.partition(b":") for line in m[1].split(b"\r\n") if line)}
    size = head.get("content-length", "")
    if not size.isdigit():
        return None
    end = m.end() + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = data[m.end():end]
    digest = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and digest.startswith("sha1:") and \
            digest[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return None
    return head, block, end + 4


def salvage(data: bytes):
    """(start, length, reason, None) for gaps and (start, length, None, (headers, block)) for records, in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        found = []
        if data.startswith(MAGIC, at):
            got, why = _inflate(data, at), "damaged member"
            if got:
                inner, end = got
                place, fine = 0, True
                while place < len(inner) and fine:
                    x = parse(inner, place)
                    fine = x is not None
                    if x:
                        found.append((at, end - at, None, x[:2]))
                        place = x[2]
                if not fine:  # what the member holds is searched like a file of its own
                    found = [(at, end - at, r, x) for _, _, r, x in salvage(inner)] if HEAD.search(inner) else []
                    got = got if found else None
                    why = "member without a record"
            valid = got is not None
        elif data.startswith(b"WARC/", at):
            x, why = parse(data, at), "damaged record"
            valid = x is not None
            if x:
                end = x[2]
                found = [(at, end - at, None, x[:2])]
        else:
            valid, why = False, "no record"
        if valid:
            if gap is not None:
                yield gap, at - gap, reason, None
                gap = None
            yield from found
            at = end
        else:
            if gap is None:
                gap, reason = at, why
            m = NEXT.search(data, at + 1)
            at = m.start() if m else len(data)
    if gap is not None:
        yield gap, len(data) - gap, reason, None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records and gaps of all archives of a folder."""
    urn = re.compile(r"<urn:page:(.*)>")

    def name(x):
        m = urn.fullmatch(x or "")
        return m[1] if m else x

    def run(batches):
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("gap", pa.string()),
                            ("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
                            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for k in range(batch.num_rows):
                file, rows, size = batch.column(0)[k].as_py(), [], 0
                for start, length, reason, got in salvage(batch.column(1)[k].as_py()):
                    head, block = got or ({}, None)
                    digest = head.get("warc-payload-digest", "")
                    rows.append((file, start, length, reason, head.get("warc-type"), name(head.get("warc-record-id")), head.get("warc-target-uri"),
                                 name(head.get("warc-refers-to")), base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None,
                                 int(head.get("x-payload-length") or len(block or b"")) if got else None, block))
                    size += len(block or b"")
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = f"{shared_folder(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex}"
    write(revisits(pages, F.col("html"), "page_id"), path, "page_id", "url")
    records = read(spark, path).where("gap IS NULL")
    number = lambda c: F.when(F.col(c) != "none", F.col(c)).cast("long").alias(c)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))
