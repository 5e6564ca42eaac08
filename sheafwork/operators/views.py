"""Views of results (column ``result`` of parse()): text, metadata, tables and raw, as rows to be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# What is shown where there is nothing.
NO_TEXT, NO_DATA, NOT_SUPPORTED = "(텍스트 없음)", "(데이터 없음)", "이 포맷은 현재 지원되지 않습니다."
HIDDEN = ("html", "parsed", "imageDataUrl")


def _or(c: Column, default: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(c)


def text_view(results: DataFrame) -> DataFrame:
    """A column shown: (kind, html, body): a notice for what isn't supported, a rendered page or an image before the text, the escaped text."""
    r = lambda c: F.col(f"result.{c}")
    html, image = F.element_at(r("metadata"), "html"), F.element_at(r("metadata"), "imageDataUrl")
    kind = F.when(~r("supported"), "notice").when(_or(html, "-") != "-", "html").when(_or(image, "-") != "-", "image").otherwise("text")
    head = F.when(kind == "notice", _or(r("error"), NOT_SUPPORTED)).when(kind == "html", html).when(kind == "image", image)
    body = F.when(kind == "text", T.escape_html(_or(r("text"), NO_TEXT))).when(kind != "notice", T.escape_html(r("text")))
    return results.withColumn("shown", F.struct(kind.alias("kind"), head.alias("head"), body.alias("body")))


def rendered_value(json: Column) -> Column:
    """A JSON value as it is shown: arrays of plain values joined by ", ", strings without quotes, everything else as JSON.  Text that isn't JSON stays."""
    v = F.try_parse_json(json)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    return F.coalesce(F.array_join(items, ", "), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v), json)


def value_type(json: Column) -> Column:
    """array, object, string, number, boolean, null, or invalid for text that isn't JSON."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return (
        F.when(kind.isNull(), "invalid").when(F.startswith(kind, F.lit("ARRAY")), "array").when(F.startswith(kind, F.lit("OBJECT")), "object")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def metadata_view(results: DataFrame, *keep: str) -> DataFrame:
    """A row for each entry of the metadata that is shown: ``keep``, key, value (escaped), in the order of keys; what holds whole pages and images isn't shown."""
    entries = F.array_sort(F.map_entries(F.map_filter("result.metadata", lambda k, v: ~k.isin(*HIDDEN))))
    return results.select(*keep, F.explode(entries).alias("e")).select(*keep, F.col("e.key").alias("key"), T.escape_html(F.col("e.value")).alias("value"))


def table_view(results: DataFrame, *keep: str, most: int = 100) -> DataFrame:
    """A row for each table: ``keep``, nth (from 1), title (only beside others), headers, rows (the first ones), note (how many more there are)."""
    title = F.when(F.size("result.tables") > 1, F.concat(F.lit("테이블 "), (F.col("i") + 1).cast("string")))
    more = F.size("t.rows") - most
    note = F.when(more > 0, F.concat(F.lit("... "), more.cast("string"), F.lit("개 행 더 있음")))
    out = results.select("result", *keep, F.posexplode("result.tables").alias("i", "t"))
    return out.select(*keep, (F.col("i") + 1).alias("nth"), title.alias("title"), F.col("t.headers").alias("headers"), F.slice("t.rows", 1, most).alias("rows"), note.alias("note"))


def raw_view(results: DataFrame) -> DataFrame:
    """A column raw: the escaped text, or what stands for none; hex dumps are marked by a metadata entry hexPreview."""
    hexed = F.coalesce(F.element_at("result.metadata", "hexPreview") == "true", F.lit(False))
    text = F.col("result.text")
    return results.withColumn("raw", F.struct(F.when(hexed, "hex").otherwise("raw").alias("kind"), T.escape_html(F.when(hexed, text).otherwise(_or(text, NO_DATA))).alias("body")))
