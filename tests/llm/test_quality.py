import zlib

import numpy as np

from sheafwork.llm import quality, queries
from sheafwork.llm import textbytes as tb

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = queries.op10_quality(spark, SF).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and rows.doc_id.is_unique
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    order = np.searchsorted(np.sort(bad), good)
    print("AUC", order.mean() / len(bad), "kept good", (good >= 0.7).mean(), "kept bad", (bad >= 0.7).mean())
    assert order.mean() / len(bad) > 0.93
    assert (good >= 0.7).mean() > 0.93 and (bad >= 0.7).mean() < 0.3


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (4, "word " * 20000, 1), (4, "word " * 20000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.fit(docs, labels.limit(0)).temperature == 1.0


def test_units_depend_on_each_text_alone():
    texts = ["Abc DEF!! x9", "", None, "Überzähl %%% abc", "abc"]
    flat, off = tb.flatten(texts)
    words, counts = quality.units(flat, off)
    assert counts.tolist() == [3, 0, 0, 3, 1]
    at = 0
    for t, n in zip(texts, counts):
        w, c = quality.units(*tb.flatten([t]))
        assert (w == words[:, at : at + n]).all()
        at += n


def test_probabilities_follow_the_real_shares():
    rng = np.random.default_rng(2)
    y = (rng.random(6000) < 0.85).astype(float)
    x = rng.normal(0, 1, (6000, 4)) + y[:, None] * 0.5
    w, b, v, c, temperature = quality.train_network(x[:4000], y[:4000])
    p = 1 / (1 + np.exp(-(np.tanh(x[4000:] @ w + b) @ v + c) / temperature))
    assert abs(p.mean() - y[4000:].mean()) < 0.05


def test_learning_stays_in_tasks(spark, monkeypatch):
    """The driver trains nothing and gets no rows that are learnt from, only the word vectors and one row of the network."""

    def never(*_, **__):
        raise AssertionError("in the driver")

    monkeypatch.setattr(type(spark.range(0)), "toPandas", never)
    monkeypatch.setattr(quality, "train_network", never)
    sf = "/root/testdata/sf0.01"
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert model.vectors.shape == (2, quality.BUCKETS, len(model.out)) and len(model.bias) == len(model.out) > 1
    none = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("false"))
    assert not none.vectors.any() and none.empty == 0.5
