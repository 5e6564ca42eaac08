import zlib

import numpy as np
import pytest

from sheafwork.llm import packing, queries

PATH = queries.tokenizer_file()


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, texts, capacity):
    """Pieces give back every document, sequences are gapless and hold no more than they can."""
    ids = {i: x for i, x in zip(texts, whole(texts.values()))}
    at = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.start == r.piece * capacity
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert len(rows) == sum(-(-len(x) // capacity) for x in ids.values())
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return at


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_packing(spark, sf).collect()
    at = check(rows, texts, 2048)
    assert len(at) <= -(-sum(r.length for r in rows) // 2048) * 1.01 + 1


def test_odd_texts(spark):
    texts = {1: None, 2: "", 3: " \n ", 4: "Ünïcode space ΣΑΣ <|endoftext|> it's 'LL 12,3 ", 5: "word " * 9000, 6: "x" * 5000, 7: "é ́e", 8: "a" + " " + "b"}
    df = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "doc_id long, text string, bucket long")
    check(packing.pack(df, PATH, capacity=64).collect(), texts, 64)
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(df.union(df), PATH, capacity=64).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_every_limit_holds(score):
    rng = np.random.default_rng(3)
    histogram = {int(k): int(n) for k, n in zip(range(1, 301), rng.integers(0, 400, 300))}
    bins = packing.best_fit(histogram, 512, max_docs=6, max_cost=120_000, score=score)
    count = {}
    for n, lengths in bins:
        assert sum(lengths) <= 512 and len(lengths) <= 6 and sum(x * x for x in lengths) <= 120_000
        for x in lengths:
            count[x] = count.get(x, 0) + n
    assert count == {k: n for k, n in histogram.items() if n}
    plain = packing.best_fit(histogram, 512, score=score)
    assert sum(n for n, _ in plain) <= sum(k * n for k, n in histogram.items()) / 512 * 1.01 + 1


def test_small_plan_matches_one_by_one_best_fit():
    lengths = [7, 6, 5, 5, 3, 3, 2, 2, 1]
    bins = packing.best_fit({k: lengths.count(k) for k in set(lengths)}, 10)
    free = []
    for x in lengths:
        fit = [i for i, f in enumerate(free) if f >= x]
        i = min(fit, key=lambda i: free[i]) if fit else len(free)
        free[i:i + 1] = [(free[i] if fit else 10) - x]
    assert sum(n for n, _ in bins) == len(free)


def test_workers_hold_little(spark, monkeypatch):
    """Ids that a worker keeps are bounded by their own number too, not only by words; tables go when all is encoded; results stay the same."""
    from sheafwork.llm import textbytes as tb

    texts = [" ".join(f"w{i}x{'ab12' * 40}{j}" for j in range(20)) for i in range(6)]
    flat, off = tb.flatten(texts)
    want, n = packing.token_ids(flat, off, PATH)
    monkeypatch.setattr(packing, "IDS", 50)
    packing._forget()
    assert PATH not in packing._TOKENIZERS
    got = [packing.token_ids(*tb.flatten([t]), PATH) for t in texts]
    assert np.concatenate([g for g, _ in got]).tolist() == want.tolist() and [int(c[0]) for _, c in got] == n.tolist()
    assert len(packing._TOKENIZERS[PATH][1].pool) <= int(n[-1])  # only the last text's
    packing._forget()


def test_batches_are_bounded(spark):
    """A staged table's batches for Python hold so many bytes at most, about, and the session's own option stays."""
    import pyarrow as pa

    from sheafwork.llm import common

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(400, numPartitions=1).selectExpr("repeat('x', 1000) AS text")
    before = spark.conf.get(common.BATCH)
    n = [r.n for r in common.stage(rows.mapInArrow(sizes, "n long"), "sizes", "64k").collect()]
    assert sum(n) == 400 and max(n) <= 100 and spark.conf.get(common.BATCH) == before
