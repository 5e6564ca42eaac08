import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheafwork.llm import common, mixing, queries

LONG = " ".join(f"w{i}" for i in range(60))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def best(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


def exact(rows):
    return [best([r for r in rows if (r[1] or "") == t]) for t in {r[1] or "" for r in rows}]


def near(rows):
    groups, sets = [], {t: shingles(t) for _, t in rows}
    for r in rows:
        s = sets[r[1]]
        own = [g for g in groups if any(s and len(s & (o := sets[x[1]])) * 100 >= 80 * len(s | o) for x in g)]
        groups = [g for g in groups if g not in own] + [[r, *(x for g in own for x in g)]]
    return [best(g) for g in groups]


def fixture(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "only without an id"), (None, "only without an id"), (None, "a b c")]
    rows += [(5, "x y z"), (5, LONG), (6, LONG), (7, LONG + " more"), (None, LONG + " other"), (8, None), (9, ""), (None, "q r s t u v w"), (4, "q r s t u v w")]
    return rows, spark.createDataFrame([(*r, i, 0) for i, r in enumerate(rows)], "doc_id long, text string, row_number int, component_id int")


def test_exact_stage_against_brute_force(spark):
    rows, df = fixture(spark)
    out = corpus_pipeline.drop_exact_copies(spark, df, "")
    assert rows_of(out) == sorted(exact(rows), key=repr) and out.columns == df.columns
    assert corpus_pipeline.drop_exact_copies(spark, df.limit(0), "").count() == 0


def test_near_stage_against_brute_force(spark):
    rows, df = fixture(spark)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert rows_of(out) == sorted(near(rows), key=repr) and out.columns == df.columns
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A small folder of documents: real ones, and odd rows beside them."""
    sf, folder = "/root/testdata/sf0.01", str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 260")
    real = docs.orderBy("doc_id").limit(3).collect()
    odd = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real] + [(None, real[0].text + " and some more words", None, None, 1), (None, real[1].text, "en", "s", 1), (9000, None, None, "s", 0), (9001, "", "", "s", 0), (9002, real[2].text * 40, "en", None, 5)]
    docs.union(spark.createDataFrame(odd, docs.schema)).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_against_a_brute_force_version_of_each_stage(spark, small):
    from tokenizers import Tokenizer

    from sheafwork.llm import quality

    docs = common.table(spark, small, "documents")
    model = quality.fit(docs, common.table(spark, small, "labels"), learn=queries.remainder("doc_id", 4) != 2)
    texts = [r.text for r in docs.collect()]
    flat, off = quality.tb.flatten(texts)
    score = dict(zip(texts, model.scores(flat, off), strict=True))
    good = [(r.doc_id, r.text) for r in docs.collect() if score[r.text] >= 0.7]
    assert rows_of(corpus_pipeline.keep_quality(spark, docs, small)) == sorted(good, key=repr) and 0 < len(good) < len(texts)
    kept = sorted(near(exact(good)), key=repr)

    staged = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        staged = common.stage(stage(spark, staged, small), "test")
    assert rows_of(staged) == kept
    by_id = Counter()
    for r in mixing.mix(staged).collect():
        by_id[r.doc_id] += r.copies
    mixed = rows_of(corpus_pipeline.mix_sources(spark, staged, small))
    assert Counter(i for i, _ in mixed) == +by_id and set(mixed) <= set(kept)

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    tokenizer.no_truncation()
    want = Counter()
    for i, t in mixed:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), queries_crc(part)] += 1
    out = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(r.length for r in out)
    assert len(places) <= -(-tokens // 2048) * 1.1 + 1


def queries_crc(ids):
    import zlib

    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_stages_and_sha_are_stable(spark, small):
    """A stage that runs again, as after a lost executor, gives the same rows."""
    docs = common.table(spark, small, "documents")
    one, two = (sorted(hashlib.sha256(repr(tuple(r)).encode()).hexdigest() for r in corpus_pipeline.mix_sources(spark, docs, small).collect()) for _ in range(2))
    assert one == two


@pytest.mark.parametrize("few", [mixing.FEW, 0])
def test_realised_tokens_are_those_that_were_planned(spark, monkeypatch, few):
    """Ids that are null or stand in two sources of different weight: each row is there as often as its own source's plan says."""
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(None, "w " * 40, "x")] * 2 + [(None, "v " * 30, "x"), (None, "y " * 40, "y"), (7, "same id", "x"), (7, "same id", "y"), (7, "other text", "x"), (8, None, None), (8, "", "y")]
    rows += [(100 + i, "a b c d e " * 20, "x") for i in range(300)] + [(100 + i, "f g h i j " * 3, "y") for i in range(300)] + [(None, f"n{i} text " * 5, "z") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"u": F.lit("mine"), "bits": F.lit(1), "row": F.lit(2)}).repartition(5)
    plan = mixing.mix(docs, target_entropy=1.0).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.sum("copies").alias("n"), F.first("weight").alias("weight"), F.sum("tokens").alias("own")).collect()
    got = mixing.realise(docs, target_entropy=1.0)
    assert got.columns == docs.columns
    real = {r.source: (r.t, r.n) for r in got.groupBy("source").agg(F.sum(mixing.tokens_of(F.col("text"))).alias("t"), F.count("*").alias("n")).collect()}
    assert real == {r.source: (r.t, r.n) for r in plan if r.n}
    budget = sum(r.own for r in plan)
    for r in plan:
        if r.own:
            assert 0 <= r.weight * budget + 1 - r.t < 101, r  # less than its weight asks for by no document's tokens
