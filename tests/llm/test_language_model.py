import math
import re
import zlib
from collections import Counter

import numpy as np

from sheafwork.llm import language_model, queries

SF = "/root/testdata/sf0.01"


def tokens(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_query_against_counts(spark):
    docs = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    count = Counter(w for i, t in docs.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    rows = queries.op6_lm_scoring(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in count for w in t), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "A a", 1), (3, "A a", 1)], "doc_id long, text string, chunk int")
    out = language_model.score(df, train=df.doc_id > 1).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 3, 3] and {r.train_tokens for r in out} == {7}
    assert language_model.score(df.limit(0), train=df.doc_id > 1).count() == 0


def test_query_uses_contexts_of_two_words(spark, tmp_path):
    # Both held-out texts have the same words, and pairs of equal counts; only the word two places before tells which is likelier.
    learn = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(1, 200) if not zlib.crc32(str(i).encode()) % 10][:2]
    rows = [(i, "a b c" if k % 2 else "d b e") for k, i in enumerate(learn[:100])] + [(held[0], "a b c d b e"), (held[1], "a b e d b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op6_lm_scoring(spark, str(tmp_path)).collect()}
    assert math.isclose(got[held[0]].base_score, got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 1


def test_totals_of_trigrams_do_not_depend_on_chunks(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0")
    train = df.doc_id % 7 > 0
    one, many = ({r.doc_id: (r.n_known, round(r.score, 6)) for r in language_model.score(df, train, order=4, chunk_bytes=c).collect()} for c in (1 << 30, 20_000))
    assert one == many


def interpolated(docs, train, order=3, rounds=60, steps=None):
    """Scores by plain counting: maximum-likelihood estimates of all orders, mixed by weights from expectation-maximisation on leave-one-out estimates."""
    texts = {i: ["<s>"] * (order - 1) + t for i, t in docs.items()}
    gram = lambda t, p, k: tuple(t[q] if q >= 0 else "before" for q in range(p - k, p + 1))
    counts = [Counter(gram(t, p, k) for i, t in texts.items() if i in train for p in range(len(t))) for k in range(order)]
    n = sum(c for (w,), c in counts[0].items() if w != "<s>")
    v = sum(1 for (w,) in counts[0] if w != "<s>")

    def parts(t, p, less):
        out, context = [1 / (v + 1), max(counts[0][gram(t, p, 0)] - less, 0) / max(n - less, 1)], 0
        for k in range(1, order):
            context = max(counts[k - 1][gram(t, p - 1, k - 1)] - less, 0)
            out.append(max(counts[k][gram(t, p, k)] - less, 0) / context if context else 0.0)
        return (context.bit_length() if context else 0), out

    places = lambda t: range(order - 1, len(t))
    seen = Counter()
    for i in train:
        for p in places(texts[i]):
            bucket, x = parts(texts[i], p, 1)
            if steps:  # the statistics behind the weights, as the operator rounds them
                x[1:] = [2 ** (round(steps * math.log2(e)) / steps) if e else 0.0 for e in x[1:]]
            seen[bucket, tuple(x)] += 1
    b = np.array([k[0] for k in seen])
    x, w = np.array([k[1] for k in seen]), np.array(list(seen.values()), float)
    lam = np.full((40, order + 1), 1 / (order + 1))
    for _ in range(rounds):
        p = lam[b] * x
        p *= (w / p.sum(axis=1))[:, None]
        total = np.full((40, order + 1), 1 / (order + 1))
        np.add.at(total, b, p)
        lam = total / total.sum(axis=1, keepdims=True)
    score = lambda t: sum(math.log10(np.dot(lam[(got := parts(t, p, 0))[0]], got[1])) for p in places(t))
    return {i: score(t) for i, t in texts.items()}


def test_scores_against_plain_interpolation(spark):
    """Only the statistics behind the weights are rounded, to quarter powers of two: scores differ from those of exact weights by less than one in fifty."""
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0")
    docs = {r.doc_id: tokens(r.text) for r in df.collect()}
    train = {i for i in docs if i % 7}
    rounded, exact = interpolated(docs, train, steps=language_model.STEPS), interpolated(docs, train)
    got = {r.doc_id: r.score for r in language_model.score(df, df.doc_id % 7 != 0, chunk_bytes=200_000).collect()}
    assert exact.keys() == got.keys()
    for i in got:
        assert math.isclose(got[i], rounded[i], rel_tol=1e-6) and math.isclose(got[i], exact[i], rel_tol=0.02)


def test_null_ids_long_texts_and_clashing_columns(spark):
    rows = [(None, "a b", 1, "x"), (None, "a b", 1, "x"), (2**60 + 1, "w " * 100_000, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, level long, shard string")
    got = sorted(((r.doc_id or 0), r.n_tokens) for r in language_model.score(df, df.level > 0).collect())
    assert got == [(0, 3), (0, 3), (2**60 + 1, 100_001)]
