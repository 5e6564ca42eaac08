"""Queries on rows with the keys of larger tables: what a few digits more change."""

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import text as T
from sheafwork.operators import subtitles as S
from sheafwork.plans import catalog

SF = "/root/testdata/sf0.001"


def matches(spark, folder, name, **tables):
    """Whether a query on changed tables gives the rows of its SQL on them."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, str(folder)), c.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r[x] for x in columns) for r in got.collect())))
    return bool(rows) and rows == sorted(map(repr, want.project(", ".join(f'"{x}"' for x in columns)).fetchall()))


def test_cues_of_a_hundred_hours(spark, tmp_path):
    text = "1\n99:59:59,000 --> 100:00:00,900\na\n\n2\n228:01:02,003 --> 1228:01:02,903\nb"
    df = spark.createDataFrame([(text, "WEBVTT\n\n" + text.replace(",", "."))], "srt string, vtt string")
    want = [("99:59:59,000", "100:00:00,900"), ("228:01:02,003", "1228:01:02,903")]
    srt, vtt = df.select(S.srt_cues(F.col("srt")), S.vtt_cues(F.col("vtt"))).first()
    assert [(c.start, c.end) for c in srt] == want and [(c.start.replace(".", ","), c.end.replace(".", ",")) for c in vtt] == want
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert matches(spark, tmp_path, "srt_render_parse", events=events.withColumn("event_id", F.col("event_id") * 60_000))


def test_listings_of_archives_with_entries_of_megabytes(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_custkey < 40")
    assert matches(spark, tmp_path, "zip_reports", orders=orders.withColumn("o_orderkey", F.col("o_orderkey") * 997 + 1_048_000))
    sizes = spark.createDataFrame([(n,) for n in (1023, 1024, 1024**2 - 1, 1024**2, 1024**3)], "n long")
    assert [r[0] for r in sizes.select(T.file_size_label(F.col("n"))).collect()] == ["1023 B", "1.0 KB", "1024.0 KB", "1.0 MB", "1.0 GB"]
