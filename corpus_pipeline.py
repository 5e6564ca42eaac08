"""A corpus from raw documents to packed sequences: quality, exact and near duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one. What all stages do with odd rows: an empty table gives an
empty table; other columns than doc_id, text and source are carried along, whatever their names; texts are never shortened; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import common, exact_dedup, mixing, near_dedup, packing, quality, queries

#: Near duplicates: the share of all shingles of five words that two texts have in common, at least.
SIMILARITY = (80, 100)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: those with a score of 0.7 at least.

    It learns from the labels of table labels, by doc_id, of ids whose remainder allows it: a null id is never learnt from, an id on several texts is learnt from with each. Every row is scored by its own
    text, so repeated rows stay or go together, and rows with a null id are judged as all others. Empty texts have the score 0 and go. Without labels all texts are alike.
    """
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), learn=queries.remainder("doc_id", 4) != 2)
    return quality.keep_good(docs, model)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number of their own each, and the name of its column, that none has yet; written, so that the numbers stay."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return common.stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _choice(row: str) -> Column:
    """The order of choice: the smallest doc_id, null last, then any one of rows that repeat it."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))


def _only(rows: DataFrame, kept: DataFrame, row: str, docs: DataFrame) -> DataFrame:
    """The rows whose numbers stand in ``kept``, with the columns of ``docs``."""
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts exactly one, that with the smallest doc_id.

    A null doc_id is the last choice, but a text that only such rows have stays. Of rows that repeat doc_id and text one stays; an id that stands on two texts
    decides for each of them alone. Null and empty texts are equal: one row of them all stays.
    """
    rows, row = _numbered(docs)
    keyed = rows.select(_choice(row).alias("key"), F.col("text"))
    kept = exact_dedup.exact_groups(keyed, id_col="key", keep="smallest").where("kept").select(F.col("key.row").alias(row))
    return _only(rows, kept, row, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (SIMILARITY) exactly one row, that with the smallest doc_id.

    Rows are told apart by numbers of their own: null and repeated ids are treated as in drop_exact_copies. Texts without words are alone, each stays.
    """
    rows, row = _numbered(docs)
    found = near_dedup.near_duplicates(rows.select(F.col(row).alias("number"), "text"), id_col="number", threshold=SIMILARITY)
    groups = found.select("number", "component_id").join(rows.select(F.col(row), "doc_id"), F.col("number") == F.col(row))
    kept = groups.groupBy("component_id").agg(F.min(_choice(row)).alias("best")).select(F.col("best.row").alias(row))
    return _only(rows, kept, row, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources asks for: as many tokens as there are, four passes over a source at most.

    A null source is a source. An id that is null or stands in several sources is no tie between rows: only rows of one source that repeat id and text are taken together or not at all. Texts without words go with the rows before them in a source's random order;
    sources without any words stay as they are.
    """
    return mixing.realise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, each with its sequence and place: 2048 tokens, and documents and attention cost (queries.PACKING), at most.

    Repeated rows and rows with a null id are documents of their own each; an empty text is its end alone. Of equally long pieces any goes to a place. Neither of the other two limits can bind
    before the tokens do: they weigh in the choice of a bin and would hold where a longer sequence is asked for.
    """
    return packing.pack(docs, queries.tokenizer_file(), **queries.PACKING)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, near duplicates and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over table documents of a folder: pieces of the packed corpus."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir).select(*[F.col(f"`{c}`") for c in docs.columns]), name)
    return STAGES[-1][1](spark, docs, sf_dir)
