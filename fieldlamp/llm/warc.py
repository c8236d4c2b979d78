"""WARC archives without repeated payloads: revisit records are resolved by a shuffle of payload digests.

``resolve_revisits`` decides with headers alone: (digest, smallest page_id and its url) of every payload that occurs twice
or more, pre-aggregated before its shuffle. The records then meet their original through a salted join, so a payload that
a third of all pages share is spread over SALTS tasks. Each task of the join writes one archive, so payloads are shuffled
once; the number of tasks follows from the bytes of all payloads and ``file_bytes``.

Archives are WARC 1.1 with fresh headers: a warcinfo record, then one gzip member a record, so that each can be read
alone. Spark's text writer writes the members as they are: a row is a member without its last byte, which is the high
byte of the length and thus zero, and the zero is the line end; behind a record of 16 MB or more an empty member gives
it. Record ids are hashes of page_id, url, digest and a number for rows that repeat all three. ``read_archives`` parses the
members of a file one after the other.

Defined results: a null html is an empty payload; payloads shorter than ``min_bytes`` are never revisited; of equal
payloads the smallest page_id is the response, and rows that repeat that page_id are captures of the same record, so
responses too; a revisit refers to the one with the smallest url; a null page_id revisits if any page with an id has the
payload; line ends in urls are percent-encoded; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded, small_batches

SALTS = 32
#: Fixed values of the format.
CRLF = b"\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def resolve_revisits(pages: DataFrame, min_bytes: int = 100, files: int | None = None) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, record_type, refers_to and refers_to_url."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256)
    )
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    firsts = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    if files:
        salted = salted.repartition(files, "payload_digest", "salt")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return salted.join(firsts, ["payload_digest", "salt"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first.page_id")).alias("refers_to"), F.when(revisits, F.col("first.url")).alias("refers_to_url"),
    )


def record_id(page_id: int | None, url: str, digest: str, repeat: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr((page_id, url, digest, repeat)).encode()).digest())}>"


def member(headers: dict[str, object], block: bytes) -> bytes:
    """The gzip member of a record, without the zero byte at its end."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + CRLF + CRLF
    out = packer.compress(data) + packer.flush()
    return (out if out[-1] == 0 else out + EMPTY_MEMBER)[:-1]


def _members(date: str):
    plain = lambda url: (url or "").replace("\r", "%0D").replace("\n", "%0A")

    def run(batches):
        seen: dict[str, int] = {}
        first = True
        for piece in small_batches(batches, "payload"):
            out = []
            if first:
                info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}
                out, first = [member(info, b"format: WARC File Format 1.1\r\n")], False
            for page, url, payload, n, digest, kind, to, to_url in zip(*(c.to_pylist() for c in piece.columns)):
                own = record_id(page, plain(url), digest, 0)
                seen[own] = k = seen.get(own, -1) + 1
                own = own if not k else record_id(page, plain(url), digest, k)
                revisit = kind == "revisit"
                headers = {
                    "WARC-Type": kind, "WARC-Record-ID": own, "WARC-Target-URI": plain(url), "WARC-Date": date, "WARC-Payload-Digest": f"sha256:{digest}",
                    "WARC-Profile": REVISIT_PROFILE if revisit else None, "WARC-Refers-To": record_id(to, plain(to_url), digest, 0) if revisit else None,
                    "WARC-Refers-To-Target-URI": plain(to_url) if revisit else None, "WARC-Refers-To-Date": date if revisit else None,
                    "X-Page-ID": page, "X-Refers-To-Page-ID": to, "Content-Type": "application/http; msgtype=response",
                }
                out.append(member(headers, HTTP % n + (b"" if revisit else payload.encode())))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100, file_bytes: int = 64 << 20, date: str | None = None) -> None:
    """Archives of about file_bytes of payload each (fewer if there are cores for more files of a megabyte). date: of all
    captures, as pages have none; the time of writing by default."""
    spark = bounded(pages.sparkSession)
    total = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    files = max(-(-total // file_bytes), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20))), 1)
    date = date or f"{datetime.datetime.now(datetime.timezone.utc):%Y-%m-%dT%H:%M:%SZ}"
    members = resolve_revisits(pages, min_bytes, files).mapInArrow(_members(date), "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").text(path)


def parse_records(stream):
    """(headers, block) of each record of an archive, read from a stream of its uncompressed bytes."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record was expected, not {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != CRLF:
            name, _, value = line.decode("utf-8").removesuffix("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block, end = stream.read(size), stream.read(4)
        if len(block) != size or end != CRLF + CRLF:
            raise ValueError(f"record {headers['WARC-Record-ID']} has a wrong length")
        yield headers, block


def records_of(archive: memoryview):
    """The records of an archive, one gzip member after the other."""
    at = 0
    while at < len(archive):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof and at < len(archive):
            step = archive[at : at + (1 << 14)]
            parts.append(unpacker.decompress(step))
            at += len(step) - len(unpacker.unused_data)
        yield from parse_records(io.BytesIO(b"".join(parts)))


def _read(with_payload: bool):
    number = lambda x: int(x) if x else None

    def read(batches):
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for h, block in records_of(memoryview(content.as_buffer())):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(CRLF + CRLF)
                    stated = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    n = int(next(x.split(b": ")[1] for x in http.split(CRLF) if x.startswith(b"Content-Length")))
                    if h["WARC-Type"] == "response":
                        if len(payload) != n or hashlib.sha256(payload).hexdigest() != stated:
                            raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                    else:
                        payload = None
                    kept = payload.decode("utf-8") if with_payload and payload is not None else None
                    rows.append((number(h.get("X-Page-ID")), h["WARC-Target-URI"], n, stated, h["WARC-Type"], number(h.get("X-Refers-To-Page-ID")), kept))
                    held += n if kept else 0
                    if held > 8 << 20 or len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives; a response's payload is checked against its digest. Revisits have none."""
    files = bounded(spark).read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), READ_SCHEMA)
