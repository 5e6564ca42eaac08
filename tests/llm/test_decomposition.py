import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import decomposition, queries
from sheafwork.llm import textbytes as tb
from sheafwork.llm.common import shared_folder, table

FILE = queries.tokenizer_file("byte_bpe_50k.json")


def encoded(text):
    from tokenizers import Tokenizer

    encoded.t = getattr(encoded, "t", None) or Tokenizer.from_file(FILE)
    return encoded.t.encode(text or "", add_special_tokens=False).ids


def test_segments_encode_as_whole_texts():
    random.seed(5)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", " ", " ", "　", "​", "﻿", "it's", "'ll", "'", "word", "Wörter", "12", "3.5", "日本", "é", "<|endoftext|>", "<|", "🙂", "x" * 40]
    texts = ["", None, *("".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(3000)), "a" * 50_000, " " * 5000, "a \n<|endoftext|> b"]
    for a in range(0, len(texts), 100):
        some = texts[a : a + 100]
        flat, off = tb.flatten(some)
        ids, counts = decomposition.token_ids(flat, off, FILE)
        own = np.split(ids, np.cumsum(counts)[:-1])
        for t, got in zip(some, own, strict=True):
            assert got.tolist() == encoded(t), repr(t)


def test_lengths_are_binary():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 40_961):
        got = decomposition.binary_lengths(n, 2048)
        assert sum(got) == n and got == sorted(got, reverse=True) and all(x & (x - 1) == 0 and x <= 2048 for x in got)
        assert len([x for x in got if x < 2048]) == len({x for x in got if x < 2048})


def test_query_against_the_tokenizer(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_decomposition(spark, sf).collect()
    want = {}
    for r in table(spark, sf, "documents").collect():
        ids, s = [*encoded(r.text), 1], 0
        for n in decomposition.binary_lengths(len(ids), 2048):
            want[r.doc_id, s] = (n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), len(ids))
            s += n
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (3, "a b"), (3, "a b"), (2**53 + 1, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("z"), "start": F.lit(1), "ids": F.lit(None)})
    got = decomposition.decompose(docs, FILE, keep_ids=True).collect()
    assert sorted(r.length for r in got if r.doc_id is None) == [1, 1] and all(r.ids == [1] for r in got if r.doc_id is None)
    assert sorted((r.start, r.length) for r in got if r.doc_id == 3) == [(0, 2), (0, 2), (2, 1), (2, 1)]
    long = sorted((r for r in got if r.doc_id == 2**53 + 1), key=lambda r: r.start)
    assert [i for r in long for i in r.ids] == [*encoded("x " * 3000), 1] and long[0].length == 2048
    assert len({r.sequence_id for r in got}) == len(got)
    assert decomposition.decompose(docs.limit(0), FILE).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        decomposition.decompose(docs, FILE, longest=1000)


def test_buckets_hold_one_length_each(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pieces = decomposition.decompose(docs, FILE, longest=256, keep_ids=True)
    folder = f"{shared_folder(spark)}/buckets-{random.random()}"
    back = decomposition.write_buckets(pieces, folder, tokens_per_file=1 << 14)
    assert {p.name for p in Path(folder.removeprefix("file://")).glob("bucket=*")} == {f"bucket={1 << k}" for k in range(9)}
    assert len(list(Path(folder.removeprefix("file://")).glob("bucket=256/*.parquet"))) > 1
    assert back.where("size(ids) <> bucket or length <> bucket").count() == 0
    joined = {}
    for r in back.orderBy("doc_id", "start").collect():
        joined.setdefault(r.doc_id, []).extend(r.ids)
    assert joined == {r.doc_id: [*encoded(r.text), 1] for r in docs.collect()}


def test_staged_tables_can_be_released(spark):
    from sheafwork.llm import common

    common.release_staged(spark)
    t = common.stage(spark.range(5).toDF("id"), "mine")
    other = common.stage(spark.range(5).toDF("id"), "other")
    common.discard(other)
    assert t.count() == 5 and common.release_staged(spark) == 1 and common.release_staged(spark) == 0
    assert not Path(t.staged_at.removeprefix("file://")).exists()
