"""Text whose nesting is in its indents or braces, as rows: block YAML and Protocol Buffers definitions.

Lines and statements are rows with a level; the row that holds another is the nearest one before it with a smaller level (chains.nearest_smaller), and paths are made by doubling ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import joined, written
from . import chains, markup

_KEY = r"""(?s)^("[^"]*"|'[^']*'|[^:\[\]{}"'#&*!|>%@`][^:]*?)\s*:(?:\s+(.*))?$"""
#: Sub-rows of a line that are told apart in its order: dashes and what follows them.
_LINE = 1 << 20


def _yaml_rows(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, level, item, name, literal): a row for each dash, and for each key of a map with what stands behind it."""
    lines = files.select(F.col(key).alias("__file"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n", -1)).alias("line", "x"))
    trimmed = T.trim_all(F.col("x"))
    lines = lines.where((trimmed != "") & ~F.startswith(trimmed, F.lit("#")) & ~trimmed.isin("---", "..."))
    lines = lines.withColumn("indent", F.length("x") - F.length(F.ltrim("x"))).withColumn("body", T.trim_all(F.col("x")))
    lines = lines.withColumn("dashes", F.regexp_extract("body", r"^((?:-[ \t]+)*(?:-$)?)", 1)).withColumn("rest", F.substr("body", F.length("dashes") + 1))
    lines = lines.withColumn("name", F.regexp_extract("rest", _KEY, 1)).withColumn("keyed", F.col("name") != "")
    plain = lambda c: F.nullif(F.when(c.rlike("^[\"']"), c).otherwise(T.trim_all(F.regexp_replace(c, r"(^|\s)#.*$", ""))), F.lit(""))
    row = "array<struct<level:int,item:boolean,name:string,literal:string>>"
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("dashes"), F.lit(1))), lambda i: F.substr(F.col("dashes"), i, F.lit(1)) == "-")
    own = lambda i: ~F.col("keyed") & (i == F.array_max(at))
    dashes = F.transform(at, lambda i: F.struct(((F.col("indent") + i - 1) * 2 + 1).alias("level"), F.lit(True).alias("item"), F.lit(None).cast("string").alias("name"), F.when(own(i), plain(F.col("rest"))).alias("literal"))).cast(row)
    quoted = F.col("name").rlike("^[\"']")
    name = F.when(quoted, F.substr("name", F.lit(2), F.length("name") - 2)).otherwise(F.col("name"))
    pair = F.array(F.struct(((F.col("indent") + F.length("dashes")) * 2).alias("level"), F.lit(False).alias("item"), name.alias("name"), plain(F.regexp_extract("rest", _KEY, 2)).alias("literal"))).cast(row)
    rows = lines.select("__file", "line", F.posexplode(F.concat(dashes, F.when(F.col("keyed"), pair).otherwise(F.array().cast(row)))).alias("sub", "r"))
    rows = rows.select("__file", (F.col("line").cast("long") * _LINE + F.col("sub")).alias("order"), "r.*")
    rows = chains.running(rows, ["__file"], "order", F.lit(1), "nth", block=_LINE << 10)
    return rows.withColumn("nth", F.col("nth") - 1).drop("order")


def yaml_values(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, kind, value) of block YAML: maps, lists and scalars (string, int, float, boolean, null), a row each; paths like a.b[0].c.

    Maps in lists, lists in lists, lists at the indent of their key, quoted keys and values, comments and one-line lists of plain scalars are known; anchors, tags, block scalars
    and other flow collections are strings. Of a key that stands twice in a map the last counts, with all below it. Lines that are neither a key nor an item go. A key with nothing below it is
    null. Below a scalar nothing can stand: such lines belong to what holds the scalar. Null texts and texts without values give no rows.
    """
    rows = written(_yaml_rows(files, key, text), "yaml")
    rows = written(chains.nearest_smaller(rows, "__file", "nth", "level"), "yaml")
    while True:  # scalars hold nothing
        leaf = rows.where("literal is not null").select("__file", F.col("nth").alias("parent"), F.col("parent").alias("above"), F.lit(True).alias("leaf"))
        if not joined(rows, leaf.select("__file", "parent"), ["__file", "parent"], "left_semi").limit(1).count():
            break
        rows = written(joined(rows, leaf, ["__file", "parent"], "left").withColumn("parent", F.when(F.col("leaf"), F.col("above")).otherwise(F.col("parent"))).drop("above", "leaf"), "yaml")
    rows = rows.withColumn("of", F.coalesce("parent", F.lit(-1)))
    rows = chains.running(rows, ["__file", "of"], "nth", F.col("item").cast("int"), "place")
    step = F.when(F.col("item"), F.concat(F.lit("["), (F.col("place") - 1).cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "name"))
    rows = rows.withColumn("step", step)
    last = rows.groupBy("__file", "of", "step").agg(F.max("nth").alias("last"))
    rows = written(joined(rows, last, ["__file", "of", "step"]).withColumn("alive", F.col("nth") == F.col("last")), "yaml")
    paths = chains.rooted(rows, "__file", "nth", "step", "alive")
    below = rows.groupBy("__file", F.col("parent").alias("nth")).agg(F.bool_or("item").alias("list")).where("nth is not null")
    out = joined(joined(rows.select("__file", "nth", "literal"), paths.where("alive").drop("alive"), ["__file", "nth"]), below, ["__file", "nth"], "left")
    flow = F.col("literal").rlike(r"^\[[^\[\]{}\"']*\]$")
    inside = F.filter(F.transform(F.split(F.regexp_extract("literal", r"^\[(.*)\]$", 1), ","), lambda x: T.trim_all(x)), lambda x: x != "")
    one = "array<struct<path:string,kind:string,value:string>>"
    whole = F.when(F.col("list"), "list").when(~F.col("list"), "map").when(flow, "list")
    own = F.array(F.struct(F.lit("").alias("path"), F.coalesce(whole, markup.scalar(F.coalesce("literal", F.lit("null")))["kind"]).alias("kind"), F.when(whole.isNull(), markup.scalar(F.coalesce("literal", F.lit("null")))["value"]).alias("value"))).cast(one)
    items = F.transform(inside, lambda x, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("path"), markup.scalar(x)["kind"].alias("kind"), markup.scalar(x)["value"].alias("value"))).cast(one)
    out = out.select("__file", "path", F.explode(F.concat(own, F.when(flow, items).otherwise(F.array().cast(one)))).alias("v"))
    return out.select(F.col("__file").alias(key), F.regexp_replace(F.concat("path", "v.path"), r"^\.", "").alias("path"), "v.kind", "v.value")


_TOKEN = r"""\"[^\"]*\"|'[^']*'|[\w.]+|[{};=<>,()\[\]-]"""


def proto_definitions(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, path, type, number) of Protocol Buffers definitions: package, message, enum, value, field, service and rpc.

    Paths name the blocks around: Outer.Inner.field. A field of a oneof belongs to the message around it; an rpc's type is its request and response. Depth is the running sum of braces, a
    statement's block the nearest statement before it that is less deep. Braces that are never closed hold the rest; comments and options don't count.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?s)/\*.*?\*/|//[^\n]*", " ")
    tokens = files.select(F.col(key).alias("__file"), F.posexplode(F.regexp_extract_all(clean, F.lit(_TOKEN), F.lit(0))).alias("at", "t")).withColumn("at", F.col("at").cast("long"))
    tokens = chains.running(tokens, ["__file"], "at", F.when(F.col("t") == "{", 1).when(F.col("t") == "}", -1).otherwise(0), "depth")
    tokens = chains.running(tokens, ["__file"], "at", F.col("t").isin("{", "}", ";").cast("int"), "ends")
    ends = F.col("t").isin("{", "}", ";")
    tokens = tokens.withColumn("statement", F.col("ends") - ends.cast("int"))
    words = F.array_sort(F.collect_list(F.when(~ends, F.struct("at", "t"))))
    level = F.max(F.when(F.col("t") == "{", F.col("depth") - 1).when(F.col("t") == "}", F.col("depth") + 1).when(F.col("t") == ";", F.col("depth")))
    s = tokens.groupBy("__file", "statement").agg(F.transform(words, lambda w: w["t"]).alias("w"), F.coalesce(level, F.max("depth")).alias("level"), F.max(F.when(ends, F.col("t"))).alias("end"))
    s = written(s.withColumnRenamed("statement", "nth"), "statements")
    s = chains.nearest_smaller(s, "__file", "nth", "level")
    first, word = F.get("w", F.lit(0)), lambda i: F.get("w", F.lit(i))
    block = F.when(F.col("end") == "{", F.when(first.isin("message", "enum", "service"), first).when(first.isin("oneof", "extend"), F.lit("group")).when(first == "rpc", first).otherwise("other"))
    named = F.when(block.isin("message", "enum", "service"), F.concat(word(1), F.lit("."))).otherwise("")
    s = written(s.withColumns({"block": block, "step": named}), "statements")
    paths = chains.rooted(s.where("block is not null"), "__file", "nth", "step").drop("alive")
    kinds = s.where("block is not null").select("__file", F.col("nth").alias("parent"), F.col("block").alias("in1"), F.col("parent").alias("above"))
    outer = kinds.select("__file", F.col("parent").alias("above"), F.col("in1").alias("in2"))
    inside = joined(joined(s, kinds, ["__file", "parent"], "left"), outer, ["__file", "above"], "left").withColumn("inside", F.when(F.col("in1") == "group", F.col("in2")).otherwise(F.col("in1")))
    inside = joined(inside, paths.select("__file", F.col("nth").alias("parent"), F.col("path").alias("around")), ["__file", "parent"], "left").withColumn("around", F.coalesce("around", F.lit("")))
    gap = F.array_position("w", F.lit("=")).cast("int")
    typed = F.filter("w", lambda x, i: (i < gap - 2) & ~((i == 0) & x.isin("repeated", "optional", "required")))
    number = F.when(F.get("w", gap) == "-", F.concat(F.lit("-"), F.get("w", gap + 1))).otherwise(F.get("w", gap)).try_cast("long")
    plain = (F.col("end") == ";") & (gap > 1) & ~first.isin("option", "reserved", "extensions", "syntax", "edition", "import")
    kind = F.when(F.col("block").isin("message", "enum", "service"), F.col("block")).when((first == "package") & (F.col("level") == 0), "package")
    kind = kind.when((first == "rpc") & (F.col("inside") == "service"), "rpc").when(plain & (F.col("inside") == "enum"), "value").when(plain & (F.col("inside") == "message"), "field")
    name = F.when(kind.isin("field", "value"), F.get("w", gap - 2)).otherwise(word(1))
    ask = F.filter("w", lambda x, i: (i > 2) & ~x.isin("(", ")", "returns"))
    kind_type = F.when(kind == "field", F.array_join(typed, "")).when(kind == "rpc", F.array_join(ask, " "))
    out = inside.select(F.col("__file").alias(key), kind.alias("kind"), F.concat("around", name).alias("path"), kind_type.alias("type"), F.when(kind.isin("field", "value"), number).alias("number"))
    return out.where("kind is not null")
