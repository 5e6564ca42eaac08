"""Queries and operators against plain Python, and odd rows."""

import base64
import hashlib
import math
import re
import uuid
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import chat, common, embedding_dedup, exact_dedup, mixing, packing, quality, queries, warc

SF = "/root/testdata/sf0.01"


def plain_mix(rows, weights, budget):
    """Copies of each row (id, source, tokens, unsigned order): whole passes, then a prefix of the order; rows of equal order are taken together."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    out = {}
    for source, own in by.items():
        n = sum(r[2] for r in own)
        quota = math.floor(weights[source] * budget)
        passes, rest = divmod(quota, n) if n else (1, 0)
        level, more = 0, set()
        order = defaultdict(list)
        for r in own:
            order[r[3]].append(r)
        for u in sorted(order):
            level += sum(r[2] for r in order[u])
            if level > rest or not rest:
                break
            more.add(u)
        for r in own:
            out[r[0]] = passes + (r[3] in more)
    return out


def exponent(shares, want):
    low, high = 0.0, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        p = np.array(shares) ** mid
        p /= p.sum()
        if -(p * np.log(p)).sum() >= want:
            low = mid
        else:
            high = mid
    return low


@pytest.mark.parametrize("few", [mixing.FEW, 0])
def test_op4_against_plain_python(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("u", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(17)))
    rows = [(r.doc_id, r.source, len(re.findall(r"[^ \t-\r]+", r.text or "")), r.u % 2**64) for r in docs.collect()]
    got = queries.op4_mixing(spark, SF).collect()
    tokens, total = defaultdict(int), sum(r[2] for r in rows)
    for r in rows:
        tokens[r[1]] += r[2]
    assert {(r.doc_id, r.source, r.tokens) for r in got} == {r[:3] for r in rows} and len(got) == len(rows)
    shares = {s: n / total for s, n in tokens.items() if n}
    x = exponent(list(shares.values()), 0.95 * math.log(len(shares)))
    z = sum(s**x for s in shares.values())
    # the largest source is repeated most where the exponent is above 1, the smallest below; four passes are enough here
    weights = {r.source: r.weight for r in got}
    for s, share in shares.items():
        assert math.isclose(weights[s], share**x / z, rel_tol=1e-4) and weights[s] * total <= 4 * tokens[s] * (1 + 1e-6)
    assert {r.doc_id: r.copies for r in got} == plain_mix(rows, weights, total)


def test_mix_of_hot_sources_nulls_and_bad_budgets(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else None) for i in range(400)] + [(None, "w " * 100_000, "long"), (None, None, "long"), (None, "a", "long")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, weight int, u int")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and sum(r.tokens for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    total = sum(r.tokens for r in out)
    assert sum(r.tokens * r.copies for r in out) <= total + 3
    with pytest.raises(ValueError):
        mixing.mix(df, budget_tokens=5 * total, max_epochs=4.0)
    assert sum(r.tokens * r.copies for r in mixing.mix(df, budget_tokens=4 * total, max_epochs=4.0).collect()) <= 4 * total
    # rates of all sources stay within the limit, those of large ones too
    skewed = spark.createDataFrame([(i, "w " * 50, "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    for r in mixing.mix(skewed, max_epochs=1.2, target_entropy=0.1).groupBy("source").agg((F.sum(F.col("tokens") * F.col("copies")) / F.sum("tokens")).alias("rate")).collect():
        assert r.rate <= 1.2


def test_op5_against_plain_python(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {}
    for i, p in pages.items():
        last[p] = max(last.get(p, i), i)
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    want = sorted((i, len(p), digest(p), "response" if last[p] == i else "revisit", None if last[p] == i else last[p]) for i, p in pages.items())
    assert sorted(tuple(r) for r in queries.op5_warc(spark, SF).collect()) == want


def test_archive_with_a_changed_payload_is_an_error():
    data = warc.record(1, "u", b"<p>payload</p>", None, "2020-01-01T00:00:00Z")
    assert warc.parse(data)["payload"] == b"<p>payload</p>"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload</p>", b"pay1oad</p>"))


def test_hot_payloads_are_spread(spark):
    rows = [(i, "u", "same") for i in range(300)] + [(i, "u", f"p{i}") for i in range(300, 320)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.refers_to for r in warc.plan_records(df).collect()}
    assert out == {i: (None if i >= 299 else 299) for i in range(320)}


def test_spread_join_keeps_rows_and_nulls(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None) for i in range(100)] + [(200, "rare"), (201, "none")], "x long, k string")
    dim = spark.createDataFrame([("hot", 50, "H"), (None, 50, "N"), ("rare", 1, "R")], "k string, n long, name string")
    got = {r.x: r.name for r in common.spread_join(rows, dim, "k", "n", "x", ["name"]).collect()}
    assert got == {i: "H" if i % 2 else "N" for i in range(100)} | {200: "R", 201: None}


def test_logs_of_tables_fold_back(spark):
    rows = [(1, 0, "user", "hello wörld \U0001f600!"), (1, 1, "assistant", ""), (1, 2, "assistant", None), (1, 3, "user", "a\\n<|im_end|>"), (1, 3, "user", "a\\n<|im_end|>"), (1, 3, "tool", "x"), (None, 5, None, "z"), (2, None, "assistant", "w " * 50_000)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, nth int")
    log = chat.table_events(df)
    assert {r.kind for r in log.collect()} == {"open", "delta", "edit", "regenerate"}
    got = {r.conv: [tuple(t) for t in r.turns] for r in chat.format_conversations(log).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {1: [("user", rows[0][3]), ("assistant", ""), ("assistant", ""), ("tool", "x"), ("user", rows[3][3]), ("user", rows[3][3])], None: [("", "z")], 2: [("assistant", rows[-1][3])]}


def test_null_ids_of_exact_groups(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == [(0, 0, 1, True), (0, 3, 3, False), (0, 3, 3, False), (3, 3, 3, True)]


def test_packing_limits_weigh_in_and_cost_no_sequence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lengths = {r.length: r.n for r in queries.op9_packing(spark, SF).groupBy("length").agg(F.count("*").alias("n")).collect()}
    plain, full = packing.best_fit(lengths, 2048), packing.best_fit(lengths, 2048, **queries.PACKING)
    assert sum(n for n, _ in full) <= sum(n for n, _ in plain) and full != plain
    tight = packing.pack(docs, queries.tokenizer_file(), max_docs=3).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("length").alias("t")).agg(F.max("n"), F.max("t")).first()
    assert tight[0] <= 3 and tight[1] <= 2048


def test_packing_of_one_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    df = spark.createDataFrame([(None if i % 5 == 0 else i, "a b c") for i in range(200)] + [(999, None), (998, "")], "doc_id long, text string")
    out = packing.pack(df, queries.tokenizer_file(), capacity=16).collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(out) == 202
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 16


def test_vectors_of_many_lengths(spark):
    rows = [(d, [1.0] * d, 1) for d in range(1, 1105)] + [(5000, [1.0] * 7, 1), (5001, [1.0, 1.0, 1.1], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[5000] == (1, 7) and got[7] == (1, 7) and got[5001] == (1, 3) and got[1104] == (0, 1104) and len(got) == len(rows)


def test_no_link_below_the_threshold(spark):
    t = 0.93
    near, below = [t, math.sqrt(1 - t * t)], [t - 1e-13, math.sqrt(1 - (t - 1e-13) ** 2)]
    rows = [(1, [1.0, 0.0], 1), (2, below, 1), (3, [1.0, 0.0, 0.0], 1), (4, [*near[:1], 0.0, near[1] * 0.999], 1)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_null_ids_and_two_labels_of_quality(spark):
    docs = spark.createDataFrame([(i, ("good fine text " if i % 2 else "bad $$ ### ") * 5) for i in range(60)] + [(None, "good fine text"), (None, None)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    one = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    two = quality.fit(docs, spark.createDataFrame([*labels, (1, 0), (2, 0), (None, 1)], "doc_id long, quality int"))
    for model in (one, two):
        out = quality.score(docs, model).collect()
        assert len(out) == 62 and sum(r.doc_id is None for r in out) == 2
        assert np.mean([r.score for r in out if r.doc_id is not None and r.doc_id % 2]) > np.mean([r.score for r in out if r.doc_id is not None and not r.doc_id % 2])


def test_a_shared_folder_is_asked_for():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("Sc", (), {"getCheckpointDir": staticmethod(lambda: type("None_", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(ValueError):
        common.shared_folder(Session)


def test_staged_tables_can_be_discarded(spark):
    t = common.stage(spark.range(5).repartition(2), f"x-{uuid.uuid4().hex}")
    assert t.count() == 5
    common.discard(t, None)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t.staged_at).count()
