"""Queries over the relational steps of the parsers: projections of records, counts, previews, unions, sinks, and formats that are joins of their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..operators import entries as N
from ..operators import markup as M
from ..operators import parse as P
from ..sources import registry as R
from .base import query, scratch
from .base import table as _t
from .formats import _KNOWN, _SUFFIXES, _cat, _named_files


@query("""SELECT conv_id, turn, role || '|' || turn || '|' AS fields, 'role,text' AS first FROM conversations""")
def record_fields(spark, sf_dir):
    """Named fields of records, empty where a record lacks one, and the first keys of each record."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"), F.lit("turn"), F.col("turn").cast("string")).alias("m"))
    headers = F.array(*map(F.lit, ("role", "turn", "lost")))
    fields = F.transform(headers, lambda h: F.coalesce(F.element_at("m", h), F.lit("")))
    return c.select("conv_id", "turn", F.array_join(fields, "|").alias("fields"), F.array_join(F.slice(F.map_keys("m"), 1, 2), ",").alias("first"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<img\b')) AS images, (length(html) - length(replace(html, '</p>', ''))) // 4 AS closed, len(list_filter(regexp_split_to_array(html, '\n\n'), lambda x: regexp_matches(x, '\S'))) AS paragraphs FROM pages""")
def page_counts(spark, sf_dir):
    """Occurrences of elements and strings, and paragraphs."""
    h = F.col("html")
    paragraphs = F.size(F.filter(F.split(h, "\n\n"), lambda x: x.rlike(r"\S")))
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_count(h, F.lit(r"(?i)<img\b")).cast("long").alias("images"), F.regexp_count(h, F.lit("</p>")).cast("long").alias("closed"), paragraphs.cast("long").alias("paragraphs"))


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, chr(10) ORDER BY n) FILTER (WHERE n <= 3) || CASE WHEN count(*) > 3 THEN chr(10) || '... +' || (count(*) - 3) ELSE '' END AS preview
          FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) GROUP BY l_orderkey""")
def preview_notes(spark, sf_dir):
    """The first rows of each group and how many more there are; only first rows are gathered, and groups are limited before the shuffle."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    first = rows.withColumn("n", nth).where("n <= 3").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("n", "l_linenumber", "l_partkey"))).alias("l"))
    both = first.join(rows.groupBy("l_orderkey").agg(F.count("*").alias("total")), "l_orderkey")
    lines = F.transform("l", lambda x: _cat(x["l_linenumber"].cast("string"), ":", x["l_partkey"].cast("string")))
    return both.select("l_orderkey", N.with_note(lines, 3, F.col("total")).alias("preview"))


@query("""SELECT conv_id, array_to_string(list_concat(list(role ORDER BY turn), list(role ORDER BY turn)), ',') AS bag FROM conversations GROUP BY conv_id""")
def bag_union(spark, sf_dir):
    """Lists end to end; what stands in both stays twice."""
    got = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"))
    roles = F.transform("l", lambda x: x["role"])
    return got.select("conv_id", F.array_join(F.concat(roles, roles), ",").alias("bag"))


@query("""SELECT conv_id, count(*) * 2 AS tables, string_agg(turn || 'a|' || turn || 'b', '|' ORDER BY turn) AS names FROM conversations GROUP BY conv_id""")
def tables_of_parts(spark, sf_dir):
    """Tables of all parts of a file in one list."""
    t = F.col("turn").cast("string")
    got = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array(_cat(t, "a"), _cat(t, "b")).alias("tables")))).alias("l"))
    flat = F.flatten(F.transform("l", lambda x: x["tables"]))
    return got.select("conv_id", F.size(flat).cast("long").alias("tables"), F.array_join(flat, "|").alias("names"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, '{t}' AS name, {n}::BIGINT AS columns, count(*) AS n FROM {t}" for k, t, n in (("table", "nation", 3), ("table", "region", 2), ("view", "lineitem", 11), ("view", "orders", 6))))
def catalog_listing(spark, sf_dir):
    """Tables and views with their columns and rows."""
    parts = []
    for kind, name in (("table", "region"), ("table", "nation"), ("view", "orders"), ("view", "lineitem")):
        t = _t(spark, sf_dir, name)
        parts.append(t.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.lit(len(t.columns)).cast("long").alias("columns"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).orderBy("kind", "name")


@query("""SELECT event_id, CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 100) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') AS two, CASE WHEN c < 0 THEN '-' ELSE '' END || (abs(c) // 100) || '.' || lpad((abs(c) % 100)::VARCHAR, 2, '0') || '0000' AS six,
          floor(event_id / 1000.0 + 0.5)::BIGINT AS rounded FROM (SELECT event_id, round(value * 100)::BIGINT AS c FROM events)""")
def fixed_point(spark, sf_dir):
    """Numbers with two and with six digits, and rounded to the next integer."""
    v = F.round(F.col("value") * 100) / 100
    return _t(spark, sf_dir, "events").select("event_id", F.format_string("%.2f", v).alias("two"), F.format_string("%.6f", v).alias("six"), T.rounded(F.col("event_id") / 1000.0).cast("long").alias("rounded"))


@query("""SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","raw":"[Binary ' || strlen(event_type) || ' bytes]"}' AS json FROM events""")
def json_strings(spark, sf_dir):
    """Values as JSON; bytes are named by their number."""
    e = _t(spark, sf_dir, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), _cat("[Binary ", F.octet_length(F.col("event_type").cast("binary")).cast("string"), " bytes]").alias("raw"))).alias("json"))


@query("""SELECT s_nationkey, s_name || ' wörld' AS line FROM supplier UNION ALL SELECT s_nationkey, 'line ' || s_suppkey FROM supplier""")
def text_sink(spark, sf_dir):
    """Texts written as UTF-8 and read back, line by line, a folder for each nation: few folders, of files as large as Spark writes them."""
    folder = scratch(spark, "text")
    text = _cat(F.col("s_name"), " wörld\nline ", F.col("s_suppkey").cast("string"))
    _t(spark, sf_dir, "supplier").select("s_nationkey", text.alias("text")).write.partitionBy("s_nationkey").text(folder)
    return spark.read.text(folder).select(F.col("s_nationkey").cast("int").alias("s_nationkey"), F.col("value").alias("line"))


@query(f"""SELECT category, string_agg(DISTINCT f, ', ' ORDER BY f) AS names, count(*) AS files FROM orders JOIN (VALUES {_KNOWN}) v(i, f, category, place) ON o_custkey % {len(_SUFFIXES)} = i GROUP BY category HAVING count(DISTINCT f) < 2""")
def small_categories(spark, sf_dir):
    """Categories of which files have one format only."""
    got = _named_files(spark, sf_dir).groupBy("category", "format").agg(F.count("*").alias("n")).groupBy("category").agg(F.array_sort(F.collect_list("format")).alias("l"), F.sum("n").alias("files"))
    return got.where("size(l) < 2").select("category", F.array_join("l", ", ").alias("names"), "files")


@query("""SELECT conv_id, turn, 'AC1032' AS version, '4' AS units, 2 AS variables, '0,' || role AS layers, 'door' AS blocks, 'LINE,TEXT,DIMENSION,MTEXT' AS types, role || ' text,m' AS texts, 1 AS dimensions FROM conversations""")
def dxf_drawings(spark, sf_dir):
    r = F.col("role")
    text = _cat(
        "  0\r\nSECTION\r\n  2\r\nHEADER\r\n  9\r\n$ACADVER\r\n  1\r\nAC1032\r\n  9\r\n$INSUNITS\r\n 70\r\n     4\r\n  0\r\nENDSEC\r\n  0\r\nSECTION\r\n  2\r\nTABLES\r\n  0\r\nTABLE\r\n  2\r\nLAYER\r\n  0\r\nLAYER\r\n  5\r\n10\r\n  2\r\n0\r\n  0\r\nLAYER\r\n  2\r\n", r,
        "\r\n 62\r\n7\r\n  0\r\nENDTAB\r\n  0\r\nENDSEC\r\n  0\r\nSECTION\r\n  2\r\nBLOCKS\r\n  0\r\nBLOCK\r\n  8\r\n0\r\n  2\r\ndoor\r\n  0\r\nENDBLK\r\n  0\r\nENDSEC\r\n  0\r\nSECTION\r\n  2\r\nENTITIES\r\n  0\r\nLINE\r\n  8\r\n0\r\n  0\r\nTEXT\r\n  8\r\n0\r\n  1\r\n", r,
        " text\r\n  0\r\nDIMENSION\r\n  8\r\n0\r\n  0\r\nMTEXT\r\n  1\r\nm\r\n  0\r\nENDSEC\r\n  0\r\nEOF\r\n",
    )
    d = _t(spark, sf_dir, "conversations").select("conv_id", "turn", M.dxf_drawing(text).alias("d"))
    joined = lambda c: F.array_join(f"d.{c}", ",").alias(c)
    return d.select("conv_id", "turn", "d.version", "d.units", "d.variables", joined("layers"), joined("blocks"), joined("types"), joined("texts"), "d.dimensions")


@query(r"""WITH c AS (SELECT conv_id, turn, role || ' & ' || turn AS t FROM conversations), b AS (SELECT conv_id, conv_id % 3 = 2 AS bare, CASE WHEN conv_id % 3 = 2 THEN string_agg(replace(t, '&', '&amp;') || chr(10) || 'x', chr(10) || chr(10) ORDER BY 'c' || turn)
             ELSE string_agg(t || chr(10) || 'x', chr(10) || chr(10) ORDER BY -turn) || chr(10) || chr(10) || arg_max(t, -turn) || chr(10) || 'x' END AS text, count(*)::INT AS n FROM c GROUP BY conv_id)
    SELECT conv_id, CASE WHEN bare THEN NULL ELSE 'Book ' || conv_id END AS title, CASE WHEN bare THEN n ELSE n + 1 END AS chapters, length(text)::INT AS characters, text FROM b""")
def epub_books(spark, sf_dir):
    """Books of chapters in the order of their spines (here backwards, with the first chapter once more at the end); one in three has no package and is read by names."""
    c = _t(spark, sf_dir, "conversations")
    bare = F.col("conv_id") % 3 == 2
    n = F.col("turn").cast("string")
    page = _cat("<html><head><title>t</title><style>p{}</style></head><body><p>", F.col("role"), " &amp; ", n, "</p><p>x</p></body></html>")
    plain = _cat("<p>", F.col("role"), " &amp; ", n, "</p><p>x</p>")
    parts = c.select("conv_id", F.when(bare, _cat("c", n, ".html")).otherwise(_cat("ops/text/c", n, ".xhtml")).alias("name"), F.when(bare, F.regexp_replace(plain, "</p><p>", "</p>")).otherwise(F.regexp_replace(page, "</p><p>", "</p>")).alias("xml"))
    turns = c.where(~bare).groupBy("conv_id").agg(F.reverse(F.array_sort(F.collect_list(F.col("turn").cast("long")))).alias("l"))
    turn = lambda x: x.cast("string")
    items = F.array_join(F.transform("l", lambda x: _cat('<item id="i', turn(x), '" href="text/c', turn(x), '.xhtml" media-type="application/xhtml+xml"/>')), "")
    refs = F.array_join(F.transform(F.concat("l", F.array(F.array_min("l"))), lambda x: _cat('<itemref idref="i', turn(x), '"/>')), "")
    opf = _cat("<package><metadata><dc:title>Book ", F.col("conv_id").cast("string"), '</dc:title></metadata><manifest><item id="css" href="a.css" media-type="text/css"/>', items, '</manifest><spine><itemref idref="css"/><itemref idref="lost"/>', refs, "</spine></package>")
    packages = turns.select("conv_id", F.lit("ops/book.opf").alias("name"), opf.alias("xml"))
    containers = turns.select("conv_id", F.lit("META-INF/container.xml").alias("name"), F.lit('<rootfile full-path="ops/book.opf"/>').alias("xml"))
    return N.epub_books(parts.union(packages).union(containers), "conv_id").select("conv_id", "title", "chapters", "characters", "text")


@query(r"""SELECT conv_id, turn, role || ' tail' || chr(10) || chr(10) || turn AS text, 2 AS paragraphs FROM conversations""")
def word_paragraphs(spark, sf_dir):
    """Paragraphs of a word processor's document part."""
    xml = _cat("<w:document><w:body><w:p><w:r><w:t>", F.col("role"), "</w:t></w:r><w:r><w:t xml:space=\"preserve\"> tail</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>", F.col("turn").cast("string"), "</w:t></w:r></w:p></w:body></w:document>")
    p = M.paragraphs(xml, "</w:p>", "<w:t(?: [^>]*)?>([^<]*)</w:t>")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(p, "\n\n").alias("text"), F.size(p).alias("paragraphs"))


@query("""SELECT page_id, 'data:' || CASE page_id % 2 WHEN 0 THEN 'text/html' ELSE 'application/octet-stream' END || ';base64,' || base64(encode(html)) AS url FROM pages""")
def data_urls(spark, sf_dir):
    mime = F.when(F.col("page_id") % 2 == 0, "text/html")
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(T.data_url(F.encode("html", "UTF-8"), mime), r"\s", "").alias("url"))


@query("""SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, CASE WHEN length(event_type) >= length(props) THEN event_type ELSE props END AS longer FROM events""")
def stamps_and_choices(spark, sf_dir):
    """Times in ISO form, to the millisecond; the longer of two strings, the first of equally long ones."""
    return _t(spark, sf_dir, "events").select("event_id", T.iso_timestamp(F.col("ts")).alias("stamp"), T.longer(F.col("event_type"), F.col("props")).alias("longer"))


# What a parser says of each file made by format_heads, by the remainder of its key.
_HEADS_SQL = """CASE c_custkey % 8
    WHEN 0 THEN 'format=Apache Arrow/Feather;size=' || (10 + n) || ';validMagic=true;variant=Arrow IPC' WHEN 1 THEN 'format=HDF5;size=' || (11 + n) || ';superblockVersion=2;validMagic=true'
    WHEN 2 THEN 'columns=amount_x, col_' || c_custkey || ';footerLength=513;format=Apache Parquet;size=' || (40 + length(c_custkey::VARCHAR)) || ';validMagic=true'
    WHEN 3 THEN 'format=SQLite;pageCount=3;pageSize=4096;schemaVersion=7;size=60;textEncoding=UTF-8' WHEN 4 THEN 'compressionMethod=Deflate;format=tar.gz;isGzip=true;originalSize=' || c_custkey || ';os=Unix;size=14'
    WHEN 5 THEN 'format=DWG;version=2013;versionCode=AC1027' WHEN 6 THEN 'format=MessagePack;size=1;type=fixmap(' || c_custkey % 16 || ')'
    ELSE 'detectedFiles=dir/' || c_name || '.txt;format=7z;size=' || (6 + 1 + 4 + n + 4 + 1) END"""


@query(f"SELECT c_custkey, {_HEADS_SQL} AS said FROM (SELECT *, length(c_name) AS n FROM customer)")
def format_heads(spark, sf_dir):
    """What parsers say of files by their heads: databases, archives, drawings, packed values."""
    k, name = F.col("c_custkey"), F.hex("c_name")
    zeros = lambda n: "00" * n
    swapped = F.lpad(F.hex(k), 8, "0")
    codes = [
        (".arrow", _cat("4152524F573100", name, "000000")),
        (".h5", _cat("894844460D0A1A0A02", name, "0000")),
        (".parquet", _cat("504152310000", F.hex(_cat("schema amount_x INT64 col_")), F.hex(k.cast("string")), "01020000" + "50415231")),
        (".sqlite", _cat("53514C69746520666F726D6174203300" + "1000" + zeros(10) + "00000003" + zeros(8) + "00000007" + zeros(12) + "00000001")),
        (".tgz", _cat("1F8B0800" + zeros(4) + "0003", F.concat(*[F.substring(swapped, i, 2) for i in (7, 5, 3, 1)]))),
        (".dwg", F.hex(F.lit("AC1027xyz"))),
        (".msgpack", F.hex(F.lit(128) + k % 16)),
        (".7z", _cat("377ABCAF271C" + "00", F.hex(F.lit("dir/")), name, F.hex(F.lit(".txt")), "00")),
    ]
    suffix = code = None
    for i, (x, c) in enumerate(codes):
        suffix = F.when(k % 8 == i, F.lit(x)) if suffix is None else suffix.when(k % 8 == i, F.lit(x))
        code = F.when(k % 8 == i, c) if code is None else code.when(k % 8 == i, c)
    files = _t(spark, sf_dir, "customer").select("c_custkey", _cat("f", suffix).alias("name"), F.unhex(code).alias("content"), F.lit(None).cast("timestamp").alias("modified"))
    got = P.parse(R.detect(files.withColumn("size", F.octet_length("content").cast("long"))))
    own = F.map_filter("result.metadata", lambda key, _: ~key.isin("fileName", "fileSize", "fileType", "lastModified"))
    return got.select("c_custkey", F.array_join(F.transform(F.array_sort(F.map_entries(own)), lambda e: _cat(e["key"], "=", e["value"])), ";").alias("said"))


@query("""SELECT page_id, array_to_string(list_filter(list_filter(r, lambda x: length(x) >= 4 AND regexp_matches(x, '[A-Za-z]')), lambda x, i: list_position(list_filter(r, lambda y: length(y) >= 4 AND regexp_matches(y, '[A-Za-z]')), x) = i)[1:30], '|') AS strings
          FROM (SELECT page_id, regexp_extract_all(left(html, 50000), '([\\x20-\\x7E]+)[^\\x20-\\x7E]', 1) AS r FROM pages)""")
def design_strings(spark, sf_dir):
    """Strings of any length from four characters on."""
    return _t(spark, sf_dir, "pages").select("page_id", F.array_join(B.text_strings(F.encode("html", "UTF-8"), least=4, below=2**31 - 1), "|").alias("strings"))
