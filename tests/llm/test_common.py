import pytest
from pyspark.sql import functions as F

from sheafwork.llm import common


@pytest.fixture
def as_planned(spark):
    """Without adaptive execution, so that rows lie where the plan deals them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rows_of_a_hub_are_dealt_over_tasks(spark, as_planned):
    edges = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    rows = common.spread_join(edges, least, "u", "n", "v", ["m"], total=100_000)
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == 100_000 and max(per_task) <= 40_000 and rows.where("m = 1").count() == 100_000


def test_components_of_a_star(spark):
    star = spark.range(0, 100_000).where("id != 7").select(F.col("id").alias("a"), F.lit(7).cast("long").alias("b"))
    got = common.components(star).agg(F.count("*"), F.min("root"), F.max("root"), F.count_distinct("node")).first()
    assert tuple(got) == (100_000, 0, 0, 100_000)


def test_components_of_chains_and_repeated_edges(spark):
    chain = [(10 * i, 10 * i + 10) for i in range(200)] + [(5, 3), (3, 5), (3, 3), (9001, 9003), (9003, 9002)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(chain * 2, "a long, b long")).collect()}
    assert got == {10 * i: 0 for i in range(201)} | {3: 3, 5: 3, 9001: 9001, 9002: 9001, 9003: 9001}


def test_components_without_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
