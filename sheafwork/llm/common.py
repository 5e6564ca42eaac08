"""What the operators share: reading, tables in the shared folder, components of a graph."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  One of our own only where a local session names none, as in tests; elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if of_context.isDefined():
            return of_context.get()
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Folders of tables of stage() that are still there.
_STAGED: list[str] = []
#: Spark's own option to delete a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's own bound on the bytes of a batch for Python.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def stage(df: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, a lost executor costs no recomputation, and the shuffles behind it can go at once.

    ``batch`` bounds the bytes that go to Python at once, such as "4m".
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {CLEANUP: "true"} | ({BATCH: batch} if batch else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(where)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(where)
    out.staged_at = where
    _STAGED.append(where)
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if where in _STAGED:
        _STAGED.remove(where)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of stage() that nothing reads any more."""
    for t in tables:
        if t is not None:
            _delete(t.sparkSession, t.staged_at)


def release_staged(spark: SparkSession) -> int:
    """Delete all tables that operators of this process have staged, for callers that have written the results they want; how many there were.  Results that weren't written can't be read any more."""
    n = len(_STAGED)
    for where in list(_STAGED):
        _delete(spark, where)
    return n


def width(spark: SparkSession) -> int:
    """Shuffle partitions of the session: operators that number partitions themselves follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _contract(batches):
    """Union-find over the edges of one task: a spanning star (root, node) of every component it sees."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = p
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:  # bounded memory: what is merged so far goes out, the rounds below merge the rest
            yield pd.DataFrame({"a": [root(x) for x in parent], "b": list(parent)}).query("a != b")
            parent.clear()
    yield pd.DataFrame({"a": np.array([root(x) for x in parent], np.int64), "b": np.array(list(parent), np.int64)}).query("a != b")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, root) for each node that has an edge, root the smallest node reachable.

    Each round merges what a task sees by union-find and then hangs neighbours below the smallest of
    their neighbourhood (large-star, small-star), until no edge changes.  A node's neighbourhood is only ever
    reduced by min() and joined, never gathered, so a hub may have any number of edges.
    """
    e = edges.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).where("a < b")
    e, before = stage(e.repartition("a").mapInPandas(_contract, "a long, b long"), "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum("a")).first()
        if now == before or not now[0]:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v")).union(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        done, e = e, stage(small, "edges")
        discard(done)


def spread_join(rows: DataFrame, dim: DataFrame, on: str, count: str, by: str, keep: list[str], total: int | None = None) -> DataFrame:
    """``rows`` left-joined with the columns ``keep`` of ``dim``, which has a row for each value of ``on`` and in ``count`` how many rows have it; nulls are equal.

    A value that more rows have than an even share of a partition is dealt over as many tasks as it needs, by a hash of the column ``by``. Fewer values than there are
    partitions can be such: only these are broadcast. ``total``: how many rows there are, where that is known.
    """
    parts = width(rows.sparkSession)
    total = (dim.agg(F.sum(count)).first()[0] or 0) if total is None else total
    share = F.lit(max(1, -(-total // parts)))
    ways = F.when(F.col(count) > share, F.ceil(F.col(count) / share)).otherwise(1).cast("int")
    dim = dim.select(F.col(on).alias("__on"), F.col(count).alias("__count"), ways.alias("__ways"), *keep)
    hot = dim.where("__ways > 1").select(F.col("__on").alias("__hot"), "__ways")
    dealt = rows.join(F.broadcast(hot), F.col(on).eqNullSafe(F.col("__hot")), "left")
    dealt = dealt.withColumn("__way", F.coalesce(F.pmod(F.xxhash64(by), F.col("__ways")), F.lit(0)).cast("int")).drop("__hot", "__ways")
    spread = dim.withColumn("__to", F.explode(F.expr("sequence(0, __ways - 1)"))).drop("__ways", "__count")
    return dealt.join(spread, F.col(on).eqNullSafe(F.col("__on")) & (F.col("__way") == F.col("__to")), "left").drop("__on", "__to", "__way")


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, *more) -> tuple[DataFrame, int]:
    """(id, text, more columns, chunk) with whole documents dealt to chunks by a hash of id and text, of about so many bytes each, and the number of chunks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")), n
