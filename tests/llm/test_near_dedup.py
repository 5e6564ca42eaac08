import itertools
import random
import re

import numpy as np
import pytest

from sheafwork.llm import near_dedup, queries
from sheafwork.llm import textbytes as tb


def sets_of(text):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, num, den):
    sets = {i: sets_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    seen = {p for ids in index.values() for p in itertools.combinations(sorted(set(ids)), 2)}
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(120)]
    out = []
    for i in range(260):  # one chain of near copies, further and further away from its first, and copies
        w = list(base)
        for j in range(i % 40):
            w[(j * 7) % 120] = f"x{j // 3}"
        out.append((i, " ".join(w)))
    out += [(1000 + i, " ".join(rng.choices("abcdefghij", k=rng.randint(1, 9)))) for i in range(60)]
    out += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One Two"), (2004, "one  two"), (2005, "é" * 40), (2006, "word " * 30_000), (2007, "Word\n" * 20_000)]
    return out


def test_chains_edges_and_ties(spark, rows):
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, root long").repartition(7)
    assert got(near_dedup.near_duplicates(df, threshold=(85, 100))) == brute(rows, 85, 100)


def test_lower_threshold(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(df)) == brute(rows, 80, 100)


def test_pieces_of_a_large_bucket(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIECE", 5)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_dedup.near_duplicates(df, threshold=(85, 100))) == brute(rows, 85, 100)


def test_empty_table_and_null_id(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (4, "A b c d e"), (4, "A b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=str) == [(4, 1, 4, True)] * 2 + [(None, 1, 4, False)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op1_minhash_dedup(spark, sf)) == brute(rows, 85, 100)


def test_signature_is_the_minimum_over_its_elements():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**52, 700).astype(np.uint64)
    whole = near_dedup.superminhash(np.sort(x), np.array([700]), 60)
    single = near_dedup.superminhash(x, np.ones(700, np.int64), 60)
    assert (single.min(axis=0) == whole[0]).all()
    assert ((single >> np.uint64(48)).astype(int).sum(axis=1) == 59 * 30).all()  # each element has every rank once
    a, b = np.sort(x[:600]), np.sort(x[100:])
    sig = near_dedup.superminhash(np.concatenate([a, b]), np.array([600, 600]), 4000)
    assert abs((sig[0] == sig[1]).mean() - 500 / 700) < 0.03


def test_shingles_of_short_and_long_texts():
    flat, off = tb.flatten(["a b c d e f", "a b", None, "A B", "  "])
    _, _, h, n = tb.words(flat, off)
    sets, many = near_dedup.distinct_sets(h, n, 5)
    assert n.tolist() == [6, 2, 0, 2, 0] and many.tolist() == [2, 1, 0, 1, 0] and sets[2] == sets[3]


def test_blocks_settle_what_pivots_leave_open(spark, monkeypatch):
    """Texts near the threshold to each other, most of them not linked: pieces of a bucket meet, with and without signatures ruling pairs out."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 4000)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in rng.sample(range(150), 2):
            w[j] = f"y{i}{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for unsure in (near_dedup.UNSURE, None):
        assert got(near_dedup.near_duplicates(df, threshold=(88, 100), unsure=unsure)) == brute(rows, 88, 100)
