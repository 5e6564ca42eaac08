"""Tables and folders in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; a temporary one only for a local session that names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = of_context.get() if of_context.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[[^,]*(,.*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back: what is iterated over is computed once a round, and a lost executor costs no earlier round."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out.written_at = where
    return out


def joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input, dealt by its keys.  Written tables look small to Spark, as their files are compressed: it would send one through the driver to all executors."""
    return a.join(b.hint("merge"), on, how)


def release(*tables: DataFrame | None) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        where = getattr(t, "written_at", None)
        if where:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
