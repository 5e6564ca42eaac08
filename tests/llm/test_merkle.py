import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheafwork.llm import merkle, queries
from sheafwork.llm.common import table

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def proofs(nodes, fanout):
    """(root, for each node its (left, right) siblings up to it) of a list of digests."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for s, a in zip(steps, at, strict=True):
            run = level[a // fanout * fanout : a // fanout * fanout + fanout]
            s.append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
        level, at = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)], [a // fanout for a in at]
    return level[0], steps


def brute(rows, fanout=2, tamper=lambda r: False):
    """Rows (doc_id, source, lang, n_chars, text) to sorted results, as text."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    made = {}
    for k in order:
        own = sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        made[k] = (own, *proofs([leaf_of(r) for r in own], fanout))
    root, tops = proofs([made[k][1] for k in order], fanout)
    out = []
    for k, top in zip(order, tops, strict=True):
        own, sub, steps = made[k]
        for r, s in zip(own, steps, strict=True):
            now = leaf_of(r if not tamper(r) else (*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            for a, b in s + top:
                now = h(a, now, b)
            out.append((r[0], leaf_of(r), sub, root, h(*[x for p in s + top for x in p]), now, now == root))
    return sorted(map(str, out))


def results(df):
    return sorted(str(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in df.collect())


def tampered(r):
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0


def test_query_against_a_plain_tree(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r[c] for c in COLUMNS) for r in table(spark, sf, "documents").collect()]
    got = results(queries.op12_merkle(spark, sf))
    assert got == brute(rows, tamper=tampered)
    assert any("False" in r for r in got) and any("True" in r for r in got)


def test_query_matches_its_sql(spark, duck):
    got = sorted(map(repr, (tuple(r) for r in queries.op12_merkle(spark, "/root/testdata/sf0.01").collect())))
    assert got == sorted(map(repr, duck.sql(queries.oracle_sql()["op12_merkle"]).fetchall()))


@pytest.mark.parametrize("fanout,block", [(2, 4), (2, 8), (3, 9), (3, 4096), (5, 5)])
def test_blocks_make_one_tree(spark, fanout, block):
    rows = [(i, "s", f"l{i % 11 if i % 3 else 0}", i, f"text {i}") for i in range(150)] + [(1000 + i, "s", f"own {i}", 1, "") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    seen = {"n_chars": F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    assert results(merkle.manifest(docs, COLUMNS, fanout=fanout, block=block, seen=seen)) == brute(rows, fanout, lambda r: r[0] % 4 == 0)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "a", "", None, "é|1:x"), (2**60, "s", "日本", 7, "x" * 300_000), (-3, None, "日本", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"key": F.lit(1), "pos": F.lit("p"), "n": F.lit(0), "digest": F.lit("d")})
    assert results(merkle.manifest(docs, COLUMNS)) == brute(rows)
    one = docs.where("doc_id = -3")
    assert results(merkle.manifest(one, COLUMNS)) == brute(rows[-1:])
    assert merkle.manifest(docs.limit(0), COLUMNS).collect() == []
