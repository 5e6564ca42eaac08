from collections import defaultdict
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import queries, whitening
from sheafwork.llm.common import table


def brute(vectors, components=8):
    """Plain Python integers: (n, deviations, eigenvalues, unit vectors, trace) of (id, vector) rows of one length."""
    x = [[floor(1024 * float(c)) + 100_000 for c in v] for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    a = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    cov = np.array([[v / (n * n) for v in row] for row in a])
    e, v = np.linalg.eigh(cov)
    deviation = {i: sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for (i, _), r in zip(vectors, x, strict=True)}
    centred = {i: np.array([(n * c - t) / n for c, t in zip(r, s, strict=True)]) for (i, _), r in zip(vectors, x, strict=True)}
    return n, deviation, centred, e[::-1][:components], v.T[::-1][:components], sum(a[i][i] for i in range(d)) / (n * n)


def check(rows, vectors, components=8):
    n, deviation, centred, e, v, trace = brute(vectors, components)
    k = min(components, len(e))
    assert len(rows) == k * len(vectors)
    by = defaultdict(dict)
    for r in rows:
        by[r.component][r.vec_id] = r
        assert (r.n, int(r.deviation)) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-8)
        assert 0 <= r.identity_error < 1e-6
    for c in range(1, k + 1):
        want = {i: centred[i] @ v[c - 1] / np.sqrt(e[c - 1]) for i in centred}
        sign = 1 if sum(want[i] * by[c][i].whitened for i in want) > 0 else -1
        assert all(abs(by[c][i].whitened - sign * want[i]) < 1e-6 for i in want)


def test_query_against_plain_integers(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    check(queries.op11_whitening(spark, sf).collect(), vectors)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * [1, 1e3, 1e6, 1e9, 3e10] + [1e9, 0, -1e12, 5, 1e13]]) for i in range(200)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whiten(docs).collect()
    n, deviation, _, e, _, trace = brute(rows)
    assert all((r.n, int(r.deviation)) == (n, deviation[r.vec_id]) for r in got)
    assert all(r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-6) for r in got if r.component <= 2)


def test_scatter_is_exact_in_digits():
    rng = np.random.default_rng(1)
    z = np.array([[int(v) for v in row] for row in rng.integers(-(2**62), 2**62, (50, 4))], object) * 3**40
    s = whitening.Scatter(4)
    s.add(z)
    s.add(z[:7])
    both = [*z.tolist(), *z[:7].tolist()]
    assert s.n == 57 and s.sums.tolist() == [sum(r[i] for r in both) for i in range(4)]
    assert s.cross.tolist() == [[sum(r[i] * r[j] for r in both) for j in range(4)] for i in range(4)]
    back = defaultdict(int)
    for _, i, k, values in s.rows(4):
        for j, v in enumerate(values):
            back[i, j] += v << (whitening.PART * k)
    assert back[-2, 0] == 57 and all(back[i, j - i] == s.cross[i, j] for i in range(4) for j in range(i, 4))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (2, [0.0, 1.0, -0.5]), (3, [0.25, -1.0, 4.0]), (3, [0.25, -1.0, 4.0]), (None, [2.0, 0.0, 1.0])]
    bad = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [nan, 1.0, 1.0]), (14, [1.0, inf, 0.0])]
    flat = [(20, [3.0, 3.0]), (21, [3.0, 3.0])]
    docs = spark.createDataFrame(good + bad + flat, "vec_id long, embedding array<float>").withColumns({"n": F.lit("x"), "length": F.lit(9), "w": F.lit(1)}).repartition(4)
    got = whitening.whiten(docs).collect()
    three = [r for r in got if r.vec_id is None or r.vec_id < 10]
    assert len(three) == 15 and {r.n for r in three} == {5} and len([r for r in three if r.vec_id is None]) == 3
    assert all(r.identity_error < 1e-9 for r in three)
    two = [r for r in got if r.vec_id in (20, 21)]
    assert len(two) == 4 and len(got) == 19 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in two} == {(2, 0, 0.0, 0.0, 0.0)}
    assert whitening.whiten(docs.limit(0)).collect() == []


def test_joined_models_are_those_that_are_sent(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "embeddings")
    model = whitening.fit(docs)
    sent = {r.id: (r.deviation, r.w) for r in whitening.whitened(docs, model).collect()}
    monkeypatch.setattr(whitening, "MODEL_BYTES", 0)
    assert {r.id: (r.deviation, r.w) for r in whitening.whitened(docs, model).collect()} == sent
