"""Dictionary-compressed WARC archives (operator 2).

An archive is one file: a skippable frame that holds a Zstandard dictionary built
from the records of this archive, then one Zstandard frame a record, made with
that dictionary, so that any record can be read alone, given its offset. A last,
empty skippable frame ends the file.

Files are written by Spark's text writer, one row a file, with that empty frame as
the line separator; so the commit protocol of the session's file system holds and
a lost executor's archive is written anew.

Of records with equal payloads of at least min_bytes bytes, the one with the
smallest identifier is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path

#: Fixed by the formats: magic numbers of skippable frames (any of 16), here one for dictionaries and one for the end.
DICT_MAGIC = 0x184D2A5D
END_FRAME = b"P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(number: int | None, uri: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{number} {uri}')}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(uri: str | None, number: int | None) -> str:
    """The URI with white space and controls percent-encoded; a null or empty one becomes urn:page:<identifier>."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in uri or "") or f"urn:page:{number}"


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(number: int | None, uri: str | None, payload: bytes, refers_to: int | None, revisit: bool, refers_uri: str | None = None) -> bytes:
    """One WARC record; a revisit names its response by record id, target and date. X-Page-Id, X-Refers-To-Page-Id and X-Payload-Length are extension fields."""
    target, digest = clean_uri(uri, number), digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(number, target)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if number is not None:
        fields.append(("X-Page-Id", str(number)))
    if revisit:
        first = clean_uri(refers_uri, refers_to)
        fields += [("WARC-Refers-To", record_id(refers_to, first)), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", DATE)]
        fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers_to)), ("X-Payload-Length", str(len(payload)))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return _headers(fields) + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (lower-case names) and the block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def pack(records: list[bytes], dict_bytes: int = 1 << 16, level: int = 3, sample_bytes: int = 2 << 20) -> bytes:
    """An archive without its end frame. The dictionary is trained on records at even distances, sample_bytes of them at most; too few to train on serve as raw content."""
    import zstandard

    every = max(1, -(-sum(min(len(r), 1 << 15) for r in records) // sample_bytes))
    samples = [r[: 1 << 15] for r in records[::every]]
    try:
        trained = zstandard.train_dictionary(dict_bytes, samples, k=512, d=8, f=18, accel=4, steps=1, threads=0, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        trained = b"".join(samples)[-dict_bytes:]
    coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICT_MAGIC, len(trained)) + trained + b"".join(map(coder.compress, records))


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive in turn."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        if struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        reader, out = decoder.decompressobj(), []
        while not reader.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            part = view[at : at + (1 << 14)]
            out.append(reader.decompress(part))
            at += len(part)
        at -= len(reader.unused_data)
        yield b"".join(out)


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 0, archive_bytes: int = 16 << 20, dict_bytes: int = 1 << 16, level: int = 3) -> None:
    """Archives page_id, url and html of every row of pages below path, a null html as an empty payload.

    Rows with equal identifier and payload that come first are all responses. A null
    identifier never comes first while there is another; among null ones alone all are
    responses. Rows that repeat identifier and URL share a record id. Null URLs are
    urn:page:<identifier>. Payloads may be of any length that a row can hold; one beyond
    archive_bytes is an archive of its own. Further columns are ignored, whatever their names.
    An empty table writes no archive. A task holds about archive_bytes of records.
    """
    number, payload = F.col("page_id").cast("long"), F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(number.alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).cast("long").alias("size"))
    firsts = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).getField("url").alias("first_url"))
    marked = rows.join(firsts, ["digest", "size"], "left").select("page_id", "url", "payload", "first", "first_url", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))).alias("revisit"))

    def archive(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for number, missing, url, payload, first, first_url, revisit in zip(*(batch[c] for c in ("page_id", "missing", "url", "payload", "first", "first_url", "revisit")), strict=True):
                held.append(record(None if missing else int(number), url, bytes(payload), int(first) if revisit else None, bool(revisit), first_url))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"value": [pack(held, dict_bytes, level)]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"value": [pack(held, dict_bytes, level)]})

    # identifiers without nulls, as pandas would turn a column with nulls into floats
    plain = marked.select(F.coalesce("page_id", F.lit(0)).alias("page_id"), F.col("page_id").isNull().alias("missing"), "url", "payload", F.coalesce("first", F.lit(0)).alias("first"), "first_url", "revisit")
    packed = plain.mapInPandas(archive, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("lineSep", END_FRAME.decode()).text(path)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row a record below path: page_id, url, record_type, payload (null for revisits, or if not asked for), payload_bytes and payload_digest of the full payload, refers_to. A payload that doesn't match its digest raises."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = []
                for raw in unpack(content):
                    fields, block = parse(raw)
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and digest_of(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                    size = int(fields["x-payload-length"]) if payload is None else len(payload)
                    number, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    found.append((number and int(number), fields["warc-target-uri"], kind, payload if payloads else None, size, digest, refers and int(refers)))
                yield pd.DataFrame(found, columns=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInPandas(rows, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def op2_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archives pages and returns what the archives hold: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
