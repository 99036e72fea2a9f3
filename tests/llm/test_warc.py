from __future__ import annotations

import struct

import zstandard

from tessera.llm import warc
from tessera.llm.common import shared_dir
from tessera.llm.common import new_path


def _rows():
    page = "<html><body>" + "<p>common text of the page</p>" * 20
    rows = [(i, f"http://host/{i % 7}", f"{page}{i % 40}" if i % 9 else "", "x") for i in range(300)]
    return rows + [(-3, None, None, "x"), (400, "", "é 日本 \r\n\r\n WARC/1.1", "x"), (401, "http://a b\r\nWARC-Type: x", "P*M\x18\x00\x00\x00\x00", "x"), (402, "u", "long" * 100000, "x"), (5, "again", f"{page}5", "x"), (None, "u", "only null", "x"), (None, "u", f"{page}7", "x")]


def _truth(rows):
    first = {}
    for number, _, html, _ in rows:
        if number is not None:
            first[html or ""] = min(number, first.get(html or "", number))
    for number, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = (html or "") in first and first[html or ""] != number
        yield number, len(raw), warc.digest_of(raw), "revisit" if revisit else "response", first[html or ""] if revisit else None


def test_round_trip(spark):
    rows = _rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, warc.op2_warc(spark, pages).collect()), key=key) == sorted(_truth(rows), key=key)


def test_archive_format(spark):
    pages = spark.createDataFrame(_rows(), "page_id long, url string, html string, payload string")
    path = new_path(spark, "t")
    warc.write_archives(pages, path, archive_bytes=40000, min_bytes=1)
    files = [bytes(f.content) for f in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) > 3
    for data in files:
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICT_MAGIC and data.endswith(warc.END_FRAME)
        for raw in warc.unpack(data):
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        if len(list(warc.unpack(data))) > 20:  # a trained dictionary is needed to read the first frame
            try:
                zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + size :])
                raise AssertionError("read without its dictionary")
            except zstandard.ZstdError:
                pass
    back = warc.read_archives(spark, path).collect()
    assert sum(r.record_type == "response" and r.payload_bytes == 0 for r in back) == sum(not r[2] for r in _rows())
    assert {r.page_id: bytes(r.payload).decode() for r in back if r.page_id in (400, 401)} == {r[0]: r[2] for r in _rows() if r[0] in (400, 401)}


def test_empty(spark):
    assert warc.op2_warc(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_revisits_resolve_by_standard_fields(spark):
    """A reader that knows no extension field finds the response of each revisit."""
    rows = [(5, "http://x/five", "same"), (2, "http://x/two", "same"), (9, None, "same"), (7, "http://x/7", "other"), (2, "http://x/2b", "same")]
    path = f"{shared_dir(spark)}/standard"
    warc.write_archives(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int"), path)
    found = [warc.parse(raw)[0] for f in spark.read.format("binaryFile").load(path).where("length > 0").collect() for raw in warc.unpack(f.content)]
    responses = {f["warc-record-id"]: f for f in found if f["warc-type"] == "response"}
    revisits = [f for f in found if f["warc-type"] == "revisit"]
    assert len(revisits) == 2
    for f in revisits:
        first = responses[f["warc-refers-to"]]
        assert first["warc-target-uri"] == f["warc-refers-to-target-uri"] == "http://x/2b" and first["warc-date"] == f["warc-refers-to-date"]
        assert first["warc-payload-digest"] == f["warc-payload-digest"]
