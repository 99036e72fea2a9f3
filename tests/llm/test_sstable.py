from __future__ import annotations

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import sstable, tokens
from tessera.llm.common import new_path, small_batches, tidy
from tessera.llm.tokens import Encoder

TEXTS = ["", "a", "It's  they'll\n\n x \t", "  two", "Ééa ß ñandú — “quoted” … 12 345", "\x1c\x1d odd\x85", "日本語 text", "<|endoftext|> in a text", "tabs\t\tand\r\nlines", "word " * 500, "nul\x00", "é̀ combining", "😀 x"]


def test_encoder_equals_the_untouched_library():
    library = Tokenizer.from_file(sstable.tokenizer_path())
    coder = Encoder(sstable.tokenizer_path(), special=True)
    assert coder.ids("<|endoftext|>").tolist() == [50256]
    for text in TEXTS:
        ids = coder.ids(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert coder.text(ids) == text


def test_encoder_equals_library():
    coder = Encoder(sstable.tokenizer_path(), kept=20)
    for _ in range(2):
        for text in TEXTS:
            assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert coder.packed(None) == b""
    assert sum(coder.byte_lengths[i] for i in coder.ids(TEXTS[4])) == len(TEXTS[4].encode())


def _truth(rows):
    library, at, found = Tokenizer.from_file(sstable.tokenizer_path()), 0, []
    for number, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(library.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4")
        found.append((number, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return found


def test_round_trip(spark):
    rows = [(i * 7 % 101 - 50, t, i) for i, t in enumerate(TEXTS * 6)] + [(None, "null id", 1), (3, None, 2), (3, "twice", 3), (3, "twice", 4)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, number long, missing string")
    found = [tuple(r) for r in sstable.op10_sstable(spark, docs).collect()]
    assert sorted(found, key=lambda r: r[1]) == _truth([r[:2] for r in rows])


def test_empty(spark):
    assert sstable.op10_sstable(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lookup_and_many_shards(spark):
    docs = spark.createDataFrame([(i * 3, f"text number {i} " * 20) for i in range(400)], "doc_id long, text string")
    path = new_path(spark, "t")
    sstable.write_shards(docs, path, sstable.tokenizer_path(), shard_bytes=3000, block_bytes=500)
    files = sstable._files(spark, path).collect()
    assert len(files) > 12
    shards = [sstable.Shard(bytes(f.content)) for f in files]
    coder = Encoder(sstable.tokenizer_path())
    for i in (0, 7, 200, 399):
        hits = [ids for s in shards for ids in s.get(i * 3)]
        assert [h.tolist() for h in hits] == [[*coder.ids(f"text number {i} " * 20), 0]]
        assert not any(s.get(i * 3 + 1) for s in shards)
    back = sstable.read_shards(spark, path).orderBy("doc_id").collect()
    assert [r.doc_id for r in back] == [i * 3 for i in range(400)]
    assert np.frombuffer(back[5].ids, "<u4").tolist() == [*coder.ids("text number 5 " * 20), 0]


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = [tuple(r) for r in sstable.op10_sstable(spark, docs).collect()]
    assert sorted(found, key=lambda r: r[1]) == _truth([(r.doc_id, r.text) for r in docs.collect()])


def test_classes_of_plain_characters():
    import regex

    for c in map(chr, range(0x2100)):
        if not tokens.OTHER.search(c):
            assert bool(regex.match(r"\p{L}", c)) == bool(tokens.re.match(f"[{tokens.L}]", c)), c
            assert bool(regex.match(r"\p{N}", c)) == bool(tokens.re.match(f"[{tokens.N}]", c)), c
            assert bool(regex.match(r"\s", c)) == bool(tokens.re.match(f"[{tokens.S}]", c)), c
    coder, r = Encoder(sstable.tokenizer_path()), random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice(" \t\n\r''aZé×÷²½19.…—!sdtmlvre_ªǀɏ¡") for _ in range(r.randrange(1, 14)))
        assert coder.ids(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_batches_are_small_only_within(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 7):
        rows = spark.range(0, 100, 1, 1).mapInPandas(tidy(lambda batches: (b.head(1).assign(id=len(b)) for b in batches)), "id long").collect()
    assert max(r.id for r in rows) <= 7 and sum(r.id for r in rows) == 100
    assert spark.conf.get(name) == before
