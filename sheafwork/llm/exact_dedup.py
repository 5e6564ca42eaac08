"""Exact deduplication by sorting content (DataFrame functions only).

Rows are dealt out by range, on splitters that Spark samples, of (leading bytes, 64-bit hash, salt); inside a
partition Spark's external sort places equal texts next to each other, and a row joins the run of the row
before it only if the two whole texts are equal.  A hash that holds more rows than an even share of one
partition is hot: its rows carry a salt, so that they fill as many partitions as they need, and the few
heads of its runs meet once more at the end, by their SHA-256.

Splitters are sampled on leading bytes and hash, not on whole texts, so what the driver gets does not
grow with the length of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=None,
    prefix_bytes: int = 24,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to what is compared (by default nothing changes).  ``keep`` is
    "smallest" or "largest".  Null texts count as empty, so nulls and empty texts are one group.  Rows that
    repeat a whole (id, text) are one group in which every repeated row of the kept id is ``kept``.  A null id
    sorts as the last choice to keep.  Other columns are ignored, whatever their names.  An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    spark = docs.sparkSession
    parts = common.width(spark)
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    if normalise is not None:
        text = F.coalesce(normalise(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).withColumn("h", F.xxhash64("body"))

    share = max(1, -(-docs.count() // parts))
    # Fewer than ``parts`` hashes can hold more than a partition's even share each: a broadcast of bounded size.
    hot = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > share).select("h", F.ceil(F.col("n") / share).cast("int").alias("salts"))
    salted = rows.join(F.broadcast(hot), "h", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id", F.lit(7)), F.col("salts")).cast("int"))
    ).drop("salts")

    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    key = [F.substring("body", 1, prefix_bytes).alias("lead"), "h", "salt", "id", "body"]
    dealt = salted.select(*key).repartitionByRange(parts, "lead", "h", "salt").sortWithinPartitions("lead", "h", "salt", "body", order)
    run = Window.partitionBy("lead", "h", "salt").orderBy("body", order)
    rows = dealt.withColumn("new", ~F.coalesce(F.col("body") == F.lag("body").over(run), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("lead", "h", "salt", "run", "id", "new", F.sha2(F.encode("body", "UTF-8"), 256).alias("text_sha256"))
    whole = Window.partitionBy("lead", "h", "salt", "run")
    best = F.min("id") if keep == "smallest" else F.max("id")
    rows = rows.select("h", "salt", "run", "id", "text_sha256", best.over(whole).alias("keep_run"), F.count("*").over(whole).alias("in_run"))

    # Heads of the runs of hot hashes, one for each salt and text, meet by hash and SHA-256: about as many rows as there are hot hashes.
    best_run = F.min("keep_run") if keep == "smallest" else F.max("keep_run")
    heads = rows.where("salt >= 0").groupBy("h", "text_sha256", "salt", "run").agg(F.first("keep_run").alias("keep_run"), F.first("in_run").alias("in_run"))
    merged = heads.groupBy("h", "text_sha256").agg(best_run.alias("keep_all"), F.sum("in_run").alias("in_all"))
    out = rows.join(F.broadcast(merged), ["h", "text_sha256"], "left")
    keep_id = F.when(F.col("in_all").isNull(), F.col("keep_run")).otherwise(F.col("keep_all"))
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("in_all", "in_run").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )
