import hashlib
import uuid

from sheafwork.llm import chat, exact_dedup, mixing, queries, warc
from sheafwork.llm.common import shared_folder

SF = "/root/testdata/sf0.01"


def test_native_queries_match_their_sql(spark, duck):
    for name in ("op2_exact_dedup", "op8_chat"):
        got, want = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(repr, want.project(", ".join(columns)).fetchall()))


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ü", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\nWARC/1.1\r\n" * 50), (6, "u", "y" * 3_000_000), (6, "u", "y" * 3_000_000), (None, "u", "z")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, size string")
    manifest = warc.write_archives(warc.plan_records(df), f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    out = warc.read_archives(manifest).collect()
    assert len(out) == 8 and sum(r.records for r in manifest.collect()) == 8
    for r in out:
        html = (next(x[2] for x in rows if x[0] == r.page_id) or "").encode()
        assert r.payload_bytes == len(html) and r.payload_digest == warc.digest(html)
        assert r.payload is None if r.record_type == "revisit" else r.payload == html
    assert {r.page_id: r.refers_to for r in out if r.record_type == "revisit"} == {1: 2, 3: 4}
    with open(manifest.first().archive.removeprefix("file:"), "rb") as f:
        assert f.read(4) == bytes.fromhex("5d2a4d18")
    none = warc.write_archives(warc.plan_records(df.limit(0)), f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    assert warc.read_archives(none).count() == 0


def test_fold_of_events(spark):
    ev = [("c", 0, 1, "open", "user", "hi"), ("c", 1, 2, "open", "assistant", None), ("c", 1, 3, "delta", None, "wr"), ("c", 1, 4, "delta", None, "ong"), ("c", 1, 5, "regenerate", None, None), ("c", 1, 6, "delta", None, "right"),
          ("c", 2, 7, "open", "user", "bad"), ("c", 2, 8, "delete", None, None), ("c", 0, 9, "edit", None, "hello <|im_end|>\\"), ("d", None, None, "delta", None, None)]
    df = spark.createDataFrame(ev, "conv_id string, message long, seq long, kind string, role string, text string")
    out = {r.conv: r for r in chat.format_conversations(df).withColumn("turns", chat.read_back(chat.F.col("formatted"))).collect()}
    assert [tuple(t) for t in out["c"].turns] == [("user", "hello <|im_end|>\\"), ("assistant", "right")]
    assert [s.text for s in out["c"].segments if s.loss] == ["right"] and [tuple(t) for t in out["d"].turns] == [("", "")]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_exact_groups_of_hot_and_odd_texts(spark):
    rows = [(i, "same") for i in range(300)] + [(400, None), (401, ""), (402, "Same"), (403, "long " * 30_000), (404, "long " * 30_000), (405, "x"), (405, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    for keep, best in (("smallest", min), ("largest", max)):
        groups = {}
        for i, t in rows:
            groups.setdefault(t or "", []).append(i)
        want = sorted((i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        assert sorted(map(tuple, exact_dedup.exact_groups(df, keep=keep).collect())) == want
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_mix_meets_budget_entropy_and_whole_passes(spark):
    rows = [(i, "w " * (5 + i % 40), "big") for i in range(3000)] + [(10_000 + i, "w " * 20, f"s{i % 5}") for i in range(500)] + [(20_000, None, None), (20_001, "a b", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, weight double")
    out = mixing.mix(df, block_tokens=500, max_epochs=0).toPandas()
    total, by = out.tokens.sum(), out.groupby(out.source.fillna("-"))
    assert len(out) == len(rows)
    for name, g in by:
        quota = g.weight.iloc[0] * total
        used = (g.tokens * g.copies).sum()
        assert used <= quota + 1 and (used > quota - 2 * g.tokens.max() - 2) and g.copies.max() - g.copies.min() <= 1
    w = by.weight.first()
    h = -(w * w.map(__import__("math").log)).sum() / __import__("math").log(len(w))
    assert abs(h - 0.95) < 0.01
    few = mixing.mix(df, max_epochs=1.5, target_entropy=1.0).toPandas()
    assert (few.tokens * few.copies).groupby(few.source.fillna("-")).sum().div(few.groupby(few.source.fillna("-")).tokens.sum()).max() <= 1.5
    same = mixing.realise(df.where("doc_id < 100"))
    assert same.columns == df.columns and mixing.mix(df.limit(0)).count() == 0


def test_warc_ids_beyond_floats(spark):
    big = 2**60
    df = spark.createDataFrame([(big + 1, "u", "p"), (big + 3, "u", "p"), (None, "u", "z"), (big + 5, "u", "y")], "page_id long, url string, html string")
    out = warc.read_archives(warc.write_archives(warc.plan_records(df.coalesce(1)), f"{shared_folder(spark)}/{uuid.uuid4().hex}")).collect()
    assert sorted((r.page_id or 0, r.refers_to or 0) for r in out) == [(0, 0), (big + 1, big + 3), (big + 3, 0), (big + 5, 0)]
