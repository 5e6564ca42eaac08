"""Exports of services and notebooks: what a file is by its first characters, and its text, fields and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import markup as M


def sniff(text: Column, name: Column) -> Column:
    """zip, json, html, xml, markdown, csv, figma or unknown: the first that fits."""
    t = T.trim_all(text)
    starts = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.startswith(t, x))
    return (
        F.when(F.startswith(text, F.lit("PK")), "zip").when(starts("{", "["), "json").when(starts("<!", "<html", "<HTML"), "html").when(starts("<"), "xml")
        .when(starts("#") | F.contains(t, F.lit("\n## ")), "markdown").when(F.contains(t, F.lit(",")) & F.contains(t, F.lit("\n")), "csv")
        .when(T.last_suffix(name) == ".fig", "figma").otherwise("unknown")
    )


def kinds_of_entries(entries: DataFrame, by: str, name: str = "name") -> DataFrame:
    """How many entries each suffix has: ``by``, kind ("other" without a suffix), n, place (from 1, the most frequent first; of equal ones the first in the order of names)."""
    suffix = F.substring(T.last_suffix(F.col(name)), 2, 1000)
    kind = F.when(suffix == "", "other").otherwise(suffix)
    counts = entries.groupBy(by, kind.alias("kind")).agg(F.count("*").alias("n"), F.min(name).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first"))).drop("first")


def json_export(text: Column, columns: int = 10, rows: int = 100, keys: int = 20, chars: int = 100) -> Column:
    """(type, records, fields, keys, headers, rows) of JSON: of an array the fields of its first object and a table of the first rows; of an object its first keys.

    Columns, rows, keys and characters of a cell are limited, as in a preview. Null for text that isn't JSON. Keys are in the order in which the text has them; of one that stands twice the last value
    counts, at the first one's place.
    """
    v = F.try_parse_json(text)
    items = F.try_variant_get(v, "$", "array<variant>")
    first = F.array_distinct(F.json_object_keys(F.get_json_object(text, "$[0]")))
    own = F.array_distinct(F.json_object_keys(F.when(v.isNotNull(), text)))
    headers = F.slice(first, 1, columns)

    def cells(item):
        m = F.try_variant_get(item, "$", "map<string,variant>")
        value = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x), F.lit(""))
        return F.transform(headers, lambda h: F.substring(value(F.element_at(m, h)), 1, chars))

    kind = F.when(items.isNotNull(), "array").when(own.isNotNull(), "object")
    out = F.struct(kind.alias("type"), F.size(items).alias("records"), first.alias("fields"), F.when(items.isNull(), F.slice(own, 1, keys)).alias("keys"), headers.alias("headers"), F.when(headers.isNotNull(), F.transform(F.slice(items, 1, rows), cells)).alias("rows"))
    return F.when(v.isNotNull(), out)


def html_export(text: Column) -> Column:
    """(title, text): 5000 characters of the body's text."""
    return F.struct(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>|<title.*+", 1).alias("title"), F.substring(T.strip_tags(T.body_of(text)), 1, 5000).alias("text"))


def xml_export(text: Column) -> Column:
    """(root, children, text): the root element's name, how many elements are its children, and the first 5000 characters."""
    return F.struct(F.xpath_string(text, F.lit("name(/*)")).alias("root"), F.xpath_int(text, F.lit("count(/*/*)")).alias("children"), F.substring(text, 1, 5000).alias("text"))


def markdown_export(text: Column) -> Column:
    """(headings, text): the first twenty heading lines, 5000 characters."""
    return F.struct(F.slice(T.all_of(text, r"(?m)^#{1,6}[^\S\n]+[^\n]+", 0), 1, 20).alias("headings"), F.substring(text, 1, 5000).alias("text"))


def csv_export(text: Column) -> Column:
    """(lines, columns, headers, rows): lines that aren't blank, with the first one; ten headers; cells of a hundred rows, trimmed, a hundred characters each."""
    lines = F.filter(F.split(text, "\n"), lambda x: T.trim_all(x) != "")
    heads = F.transform(F.split(F.get(lines, F.lit(0)), ","), lambda h: F.regexp_replace(T.trim_all(h), '^"(.*)"$', "$1"))
    cells = lambda x: F.transform(F.get(M.csv_rows(x, F.lit(",")), F.lit(0)), lambda c: F.substring(T.trim_all(c), 1, 100))
    return F.struct(F.size(lines).alias("lines"), F.size(heads).alias("columns"), F.slice(heads, 1, 10).alias("headers"), F.transform(F.slice(lines, 2, 100), cells).alias("rows"))


def notebook(text: Column) -> Column:
    """(text, cells, code_cells, markdown_cells, kernel, nbformat) of a notebook: each cell's source and the text of its outputs.  Null for text that isn't JSON."""
    v = F.try_parse_json(text)
    cells = F.coalesce(F.try_variant_get(v, "$.cells", "array<variant>"), F.array().cast("array<variant>"))
    joined = lambda x, path: F.coalesce(F.array_join(F.try_variant_get(x, path, "array<string>"), ""), F.try_variant_get(x, path, "string"))
    filled = lambda c: F.when(c != "", c)

    def cell(c, i):
        shown = F.transform(F.try_variant_get(c, "$.outputs", "array<variant>"), lambda o: F.coalesce(filled(joined(o, "$.text")), joined(o, '$.data["text/plain"]'), F.lit("")))
        out = F.array_join(F.filter(shown, lambda o: o != ""), "\n")
        head = F.concat(F.lit("--- Cell "), (i + 1).cast("string"), F.lit(" ["), F.coalesce(F.try_variant_get(c, "$.cell_type", "string"), F.lit("unknown")), F.lit("] ---\n"), F.coalesce(joined(c, "$.source"), F.lit("")))
        return F.when(F.coalesce(out, F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n\n[Output]\n"), out))

    of = lambda kind: F.size(F.filter(cells, lambda c: F.try_variant_get(c, "$.cell_type", "string") == kind))
    kernel = F.coalesce(F.try_variant_get(v, "$.metadata.kernelspec.display_name", "string"), F.try_variant_get(v, "$.metadata.kernelspec.name", "string"), F.lit("unknown"))
    out = F.struct(F.array_join(F.transform(cells, cell), "\n\n").alias("text"), F.size(cells).alias("cells"), of("code").alias("code_cells"), of("markdown").alias("markdown_cells"), kernel.alias("kernel"), F.try_variant_get(v, "$.nbformat", "int").alias("nbformat"))
    return F.when(v.isNotNull(), out)
