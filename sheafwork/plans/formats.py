"""Queries over formats: detection, files and their results, and the steps of the parsers, on files made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..operators import entries as N
from ..operators import exports as X
from ..operators import markup as M
from ..operators import parse as P
from ..operators import subtitles as S
from ..operators import views as V
from ..sources import datasource as D
from ..sources import files as files_
from ..sources import registry as R
from .base import query, scratch
from .base import table as _t


def _cat(*xs):
    """Strings end to end; plain strings are literals."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])


def _bytes(code) -> F.Column:
    return F.unhex(code)


# ---- registry and detection ----------------------------------------------------------------------------------------------


# Suffixes of files named after the tables' rows, with what the registry says of each: format, category, whether it has a parser, the category's place.
_SUFFIXES = [
    (".pdf", "PDF", "문서", 1), (".rtf", "RTF", "문서", 1), (".yml", "YAML", "웹/마크업", 2), (".eml", "이메일 (EML)", "웹/마크업", 2), (".dcm", "DICOM", "이미지/스캔", 3), (".epub", "EPUB", "전자책/출판", 4),
    (".mp3", "MP3", "오디오/비디오", 5), (".md", "Markdown", "코드/기술문서", 6), (".proto", "Protocol Buffers", "코드/기술문서", 6), (".csv", "CSV", "구조화 데이터", 7), (".avro", "Avro", "구조화 데이터", 7),
    (".tgz", "tar.gz", "복합/압축", 8), (".shp", "Shapefile", "도메인 특수", 9), (".none", "Unknown", "기타", None),
]
_KNOWN = ", ".join(f"({i}, '{f}', '{c}', {p or 'NULL'})" for i, (_, f, c, p) in enumerate(_SUFFIXES))


def _named_files(spark, sf_dir):
    """A file's name for each order, detected."""
    suffix = F.element_at(F.array(*[F.lit(x[0]) for x in _SUFFIXES]), (F.col("o_custkey") % len(_SUFFIXES) + 1).cast("int"))
    return R.detect(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _cat("o", F.col("o_orderkey").cast("string"), suffix).alias("name")), content=None)


@query(f"""SELECT category, count(*) AS files, count(DISTINCT f)::BIGINT AS formats, place::INT AS place FROM orders JOIN (VALUES {_KNOWN}) v(i, f, category, place) ON o_custkey % {len(_SUFFIXES)} = i GROUP BY category, place""")
def category_summary(spark, sf_dir):
    """How many files and formats there are of each category, and its place in the registry."""
    got = _named_files(spark, sf_dir).groupBy("category").agg(F.count("*").alias("files"), F.count_distinct("format").alias("formats"))
    return got.join(F.broadcast(R.categories(R.formats(spark)).select("category", F.col("place").cast("int").alias("place"))), "category", "left")  # nine categories


@query(f"""SELECT f AS format, f <> 'Unknown' AS supported, count(*) AS files FROM orders JOIN (VALUES {_KNOWN}) v(i, f, category, place) ON o_custkey % {len(_SUFFIXES)} = i GROUP BY ALL""")
def format_totals(spark, sf_dir):
    return _named_files(spark, sf_dir).groupBy("format", "supported").agg(F.count("*").alias("files"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 900 WHEN 1 THEN 900 WHEN 2 THEN 72 ELSE 71 END AS format_id, CASE page_id % 4 WHEN 0 THEN 'Log' WHEN 1 THEN 'Log' WHEN 2 THEN 'TSV' ELSE 'CSV' END AS format,
          CASE page_id % 4 WHEN 3 THEN 'mime' ELSE 'extension' END AS detected_by FROM pages""")
def format_lookup(spark, sf_dir):
    """A format that is registered last takes over the suffixes it names, in any case of letters, but no MIME type that it doesn't."""
    known = R.register(R.formats(spark), 900, "Log", [".LOG", ".csv"], [], "구조화 데이터", "TextParser")
    k = F.col("page_id") % 4
    files = _t(spark, sf_dir, "pages").select("page_id", _cat("p", F.when(k == 0, ".log").when(k == 1, ".CSV").when(k == 2, ".tsv").otherwise("")).alias("name"), F.when(k == 3, "text/csv").alias("mime"))
    return R.detect(files, content=None, mime="mime", known=known).select("page_id", "format_id", "format", "detected_by")


@query("""SELECT doc_id, id AS format_id, p AS parser_name, how AS detected_by FROM documents
          JOIN (VALUES (0, 1, 'PdfParser', 'extension'), (1, 98, 'ArchiveParser', 'extension'), (2, 59, 'MarkdownParser', 'extension'), (3, 71, 'TextParser', 'extension'), (4, 0, NULL, 'unknown')) v(k, id, p, how) ON doc_id % 5 = k""")
def detect_ladder(spark, sf_dir):
    names = F.concat("source", F.lit("."), "lang", F.element_at(F.array(*map(F.lit, (".PDF", ".tar.gz", ".md", ".csv", ".nope"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return R.detect(_t(spark, sf_dir, "documents").select("doc_id", names.alias("name")), content=None).select("doc_id", "format_id", "parser_name", "detected_by")


# Heads of files without a known suffix: name, bytes in hexadecimal, MIME type.
_HEADS = [
    ("a", "255044462D312E37", None), ("b.bin", "504B030414000000", None), ("c", "504B0506", None), ("d", "5249464624080000", None), ("e", "4F67675300", None), ("f", "664C614300", None),
    ("g", "FFFB9064", None), ("h", "49443303", None), ("i", "D0CF11E0A1B11AE1", None), ("j", "526172211A0700", None), ("k", "377ABCAF271C", None), ("l", "1F8B0800", None),
    ("m", "4F626A0104", None), ("n", "894844460D0A1A0A", None), ("o", "5041523115", None), ("p", "53514C69746520666F726D6174203300", None), ("q", "68656C6C6F", "text/csv"), ("r", "68656C6C6F", "TEXT/CSV"),
    ("s", "0A2D2D2D0A613A2031", None), ("t", "2320686561640A", None), ("u", "696E74726F0A23232068656164", None), ("v", "2301020304", None), ("w.csv", "255044462D312E37", None), ("x", "", None),
]


@query("""SELECT doc_id, id AS format_id, how AS detected_by FROM documents JOIN (VALUES (0, 1, 'magic'), (1, 95, 'magic'), (2, 95, 'magic'), (3, 45, 'magic'), (4, 47, 'magic'), (5, 110, 'magic'), (6, 44, 'magic'), (7, 44, 'magic'),
          (8, 8, 'magic'), (9, 97, 'magic'), (10, 96, 'magic'), (11, 98, 'magic'), (12, 75, 'magic'), (13, 77, 'magic'), (14, 73, 'magic'), (15, 78, 'magic'), (16, 71, 'mime'), (17, 0, 'unknown'), (18, 23, 'text'), (19, 59, 'text'),
          (20, 59, 'text'), (21, 0, 'unknown'), (22, 71, 'extension'), (23, 0, 'unknown')) v(k, id, how) ON doc_id % 24 = k""")
def detect_bytes(spark, sf_dir):
    """All signatures, MIME types and the look at the text, on heads without a known suffix."""
    pick = lambda i: F.element_at(F.array(*[F.lit(h[i]).cast("string") for h in _HEADS]), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    files = _t(spark, sf_dir, "documents").select("doc_id", pick(0).alias("name"), _bytes(pick(1)).alias("content"), pick(2).alias("mime"))
    return R.detect(files, mime="mime").select("doc_id", "format_id", "detected_by")


# ---- files and results ---------------------------------------------------------------------------------------------------


def _supplier_files(spark, sf_dir):
    s, k, n = _t(spark, sf_dir, "supplier"), F.col("s_suppkey") % 11, F.col("s_name")
    contents = {
        "csv": _cat('name,note\n"', n, ', Ltd","say ""hi""\nthere"\n\nshort\n'),
        "tsv": _cat("name\tkey\n", n, "\t", F.col("s_suppkey").cast("string"), "\textra"),
        "srt": _cat("1\n00:00:01,000 --> 00:00:02,500\n<i>", n, "</i>\n{\\an8}two\n\n2\n00:01:01,000 --> 00:01:02,000\nlast"),
        "md": _cat("# ", n, "\ntext\n## sub"),
        "eml": _cat("From: ", n, "\r\nSubject: offer\r\n\r\nDear\r\nyou"),
        "pdf": _cat("not a pdf: ", n),
        "nope": _cat("who knows ", n),
        "mp3": _cat("ID3", n),
        "rtf": _cat("{\\rtf1{\\fonttbl\\f0 Arial;}Hello\\par ", n, " a\\\\b}"),
        "fdf": _cat("/T (name) /V (", n, ") /T (b) /V ()"),
        "mp4": _cat("broken ", n),
    }
    content = suffix = None
    for i, (x, c) in enumerate(contents.items()):
        content = F.when(k == i, c) if content is None else content.when(k == i, c)
        suffix = F.when(k == i, F.lit(x)) if suffix is None else suffix.when(k == i, F.lit(x))
    return s.select("s_suppkey", _cat("dir", (F.col("s_suppkey") % 3).cast("string"), "/f", F.col("s_suppkey").cast("string"), ".", suffix).alias("name"), content.alias("content"))


@query(r"""WITH s AS (SELECT *, s_suppkey % 11 AS k, s_name AS n FROM supplier),
    f AS (SELECT s_suppkey, k, n, 'f' || s_suppkey || '.' || x AS name, format, category, p, c FROM s JOIN (VALUES
      (0, 'csv', 'CSV', '구조화 데이터', true), (1, 'tsv', 'TSV', '구조화 데이터', true), (2, 'srt', 'SRT 자막', '오디오/비디오', true), (3, 'md', 'Markdown', '코드/기술문서', true), (4, 'eml', '이메일 (EML)', '웹/마크업', true), (5, 'pdf', 'PDF', '문서', true),
      (6, 'nope', 'Unknown', '기타', false), (7, 'mp3', 'MP3', '오디오/비디오', false), (8, 'rtf', 'RTF', '문서', true), (9, 'fdf', 'PDF 폼 데이터', '문서', true), (10, 'mp4', 'MP4', '오디오/비디오', true)) v(kk, x, format, category, p) ON k = kk,
      LATERAL (SELECT CASE k WHEN 0 THEN 'name,note' || chr(10) || '"' || n || ', Ltd","say ""hi""' || chr(10) || 'there"' || chr(10) || chr(10) || 'short' || chr(10)
        WHEN 1 THEN 'name' || chr(9) || 'key' || chr(10) || n || chr(9) || s_suppkey || chr(9) || 'extra' WHEN 3 THEN '# ' || n || chr(10) || 'text' || chr(10) || '## sub' END AS c))
    SELECT name, format, category, p AS supported,
      coalesce(CASE k WHEN 2 THEN n || ' two' || chr(10) || 'last' WHEN 4 THEN 'Dear' || chr(10) || 'you' WHEN 8 THEN 'Hello' || n || ' a\' WHEN 9 THEN 'name: ' || n || chr(10) || 'b: ' ELSE c END, '') AS text,
      CASE k WHEN 6 THEN 'Unknown 포맷은 현재 브라우저에서 직접 파싱할 수 없습니다. (API 접근 또는 서버 사이드 처리 필요)' WHEN 7 THEN '파서를 찾을 수 없습니다: AudioParser' WHEN 10 THEN '파싱 중 오류 발생: no frames' END AS error,
      CASE k WHEN 5 THEN 'PDF 시그니처를 찾을 수 없습니다' END AS soft_error,
      CASE k WHEN 0 THEN 'name,note|' || n || ', Ltd,say "hi"' || chr(10) || 'there|short' WHEN 1 THEN 'name,key|' || n || ',' || s_suppkey || ',extra' WHEN 2 THEN '#,Start,End,Text|1,00:00:01,000,00:00:02,500,' || n || ' two|2,00:01:01,000,00:01:02,000,last' END AS cells,
      CASE k WHEN 7 THEN NULL ELSE name END AS file_name, CASE WHEN k IN (0, 1, 2, 3, 4, 5, 8, 9) THEN 'unknown' END AS file_type
    FROM f""")
def parsed_files(spark, sf_dir):
    """Files written from a table, read back, detected and parsed: whole results, unsupported formats, formats without a parser, failures and what a parser says itself."""
    folder = scratch(spark, "files")
    files_.write_files(_supplier_files(spark, sf_dir), folder).agg(F.sum("bytes")).collect()
    parsers = dict(P.PARSERS)
    P.register_parser("VideoParser", lambda f: P.parts(F.lit("lost"), failure=F.lit("no frames")), parsers)
    got = P.parse(R.detect(files_.read_files(spark, folder)), parsers)
    table = F.get("result.tables", F.lit(0))
    rows = F.transform(F.concat(F.array(table["headers"]), table["rows"]), lambda r: F.array_join(r, ","))
    meta = lambda k: F.element_at("result.metadata", k)
    r = [F.col(f"result.{c}") for c in ("format", "category", "supported", "text", "error")]
    return got.select("name", *r, meta("error").alias("soft_error"), F.when(table.isNotNull(), F.array_join(rows, "|")).alias("cells"), meta("fileName").alias("file_name"), meta("fileType").alias("file_type"))


@query("""SELECT 'f' || s_suppkey || '.csv' AS name, 'CSV' AS format, (10 + 1 + length(s_name) + 7 + 20 + 6)::BIGINT AS size, 'name,note|' || s_name || ', Ltd,say "hi"' || chr(10) || 'there|short' AS cells
          FROM supplier WHERE s_suppkey % 11 = 0 AND 10 + 1 + length(s_name) + 7 + 20 + 6 > 40""")
def file_source(spark, sf_dir):
    """Files of a folder through the data source, by their suffix and size: the others are never opened."""
    folder = scratch(spark, "source")
    files_.write_files(_supplier_files(spark, sf_dir), folder).agg(F.sum("bytes")).collect()
    got = P.parse(R.detect(D.read_folder(spark, folder, partition_bytes=1 << 10).where("suffix = '.csv' and size > 40")))
    table = F.get("result.tables", F.lit(0))
    return got.select("name", "result.format", "size", F.array_join(F.transform(F.concat(F.array(table["headers"]), table["rows"]), lambda r: F.array_join(r, ",")), "|").alias("cells"))


def _settings(content: bytes):
    for line in content.decode().splitlines():
        key, mark, value = line.partition("=")
        if not mark:
            raise ValueError(line)
        yield key.strip(), value.strip()


@query("""SELECT s_suppkey, unnest([0, 1, 2]) AS nth, unnest(['name', 'key', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'nation' END]) AS key, unnest([s_name, s_suppkey::VARCHAR, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey::VARCHAR END]) AS value,
          unnest([NULL, NULL, CASE WHEN s_suppkey % 3 = 0 THEN 'ValueError: broken ' || s_suppkey END]) AS error FROM supplier""")
def table_parser(spark, sf_dir):
    """A parser of the user's own as a table function; files that it fails on say why."""
    D.register_table_parser(spark, "settings_of", _settings)
    last = F.when(F.col("s_suppkey") % 3 == 0, _cat("broken ", F.col("s_suppkey").cast("string"))).otherwise(_cat("nation=", F.col("s_nationkey").cast("string")))
    files = _t(spark, sf_dir, "supplier").select("s_suppkey", _cat("name = ", F.col("s_name"), "\nkey=", F.col("s_suppkey").cast("string"), "\n", last).cast("binary").alias("content"))
    files.createOrReplaceTempView("settings_files")
    return spark.sql("SELECT s_suppkey, p.nth, p.key, p.value, p.error FROM settings_files, LATERAL settings_of(content) AS p")


def _segments(spark, sf_dir):
    """Results of a CSV for each market segment and thousand of customers' keys."""
    c = _t(spark, sf_dir, "customer").groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 1000).alias("b")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("l"))
    text = _cat("key,name\n", F.array_join(F.transform("l", lambda x: F.concat(x["c_custkey"].cast("string"), F.lit(","), x["c_name"])), "\n"))
    files = c.select(_cat(F.col("c_mktsegment"), "-", F.col("b").cast("string"), ".csv").alias("name"), F.octet_length(text).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), text.cast("binary").alias("content"))
    return P.parse(R.detect(files))


@query("""SELECT name, 1 AS nth, NULL::VARCHAR AS title, 'key,name' AS headers, least(100, count(*))::INT AS shown,
          string_agg(c_custkey, ',' ORDER BY c_custkey) FILTER (WHERE n <= 100) AS keys, CASE WHEN count(*) > 100 THEN '... ' || (count(*) - 100) || '개 행 더 있음' END AS note
          FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) AS n FROM (SELECT *, c_mktsegment || '-' || c_custkey // 1000 || '.csv' AS name FROM customer)) GROUP BY name""")
def result_tables(spark, sf_dir):
    v = V.table_view(_segments(spark, sf_dir), "name")
    return v.select("name", "nth", "title", F.array_join("headers", ",").alias("headers"), F.size("rows").alias("shown"), F.array_join(F.transform("rows", lambda r: r[0]), ",").alias("keys"), "note")


@query("""SELECT name, unnest(['columns', 'delimiter', 'fileName', 'fileSize', 'fileType', 'format', 'headers', 'rows']) AS key,
          unnest(['2', ',', name, (8 + sum(length(c_custkey::VARCHAR) + 2 + length(c_name)))::BIGINT::VARCHAR, 'unknown', 'CSV', 'key, name', count(*)::VARCHAR]) AS value
          FROM (SELECT *, c_mktsegment || '-' || c_custkey // 1000 || '.csv' AS name FROM customer) GROUP BY name""")
def result_metadata(spark, sf_dir):
    return V.metadata_view(_segments(spark, sf_dir), "name")


@query(r"""WITH m AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN '# ' || role || ' & co' WHEN 1 THEN '' ELSE role || ' <b>' END AS c FROM conversations)
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'text' ELSE 'notice' END AS kind, CASE turn % 3 WHEN 0 THEN '<p><h1>' || role || ' & co</h1></p>' WHEN 2 THEN 'Unknown 포맷은 현재 브라우저에서 직접 파싱할 수 없습니다. (API 접근 또는 서버 사이드 처리 필요)' END AS head,
      CASE turn % 3 WHEN 0 THEN '# ' || role || ' &amp; co' WHEN 1 THEN '(텍스트 없음)' END AS body, CASE turn % 3 WHEN 0 THEN '# ' || role || ' &amp; co' ELSE '(데이터 없음)' END AS raw FROM m""")
def result_text(spark, sf_dir):
    c, k = _t(spark, sf_dir, "conversations"), F.col("turn") % 3
    text = F.when(k == 0, _cat("# ", F.col("role"), " & co")).when(k == 1, "").otherwise(_cat(F.col("role"), " <b>"))
    name = F.when(k == 0, "a.md").when(k == 1, "b.csv").otherwise("c.nope")
    files = c.select("conv_id", "turn", name.alias("name"), F.octet_length(text).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), text.cast("binary").alias("content"))
    v = V.raw_view(V.text_view(P.parse(R.detect(files))))
    return v.select("conv_id", "turn", "shown.kind", "shown.head", "shown.body", F.col("raw.body").alias("raw"))


@query("""SELECT event_id, unnest(['object', 'array', 'string', 'number', 'boolean', 'null', 'invalid']) AS type,
          unnest([replace(props, ' ', ''), event_type || ', ' || event_id, event_type, event_id::VARCHAR, 'true', 'null', '{' || event_type]) AS shown FROM events""")
def json_values(spark, sf_dir):
    """JSON values, their types and how they are shown."""
    e, i = _t(spark, sf_dir, "events"), F.col("event_id").cast("string")
    quoted = _cat('"', F.col("event_type"), '"')
    values = F.array(F.col("props"), _cat("[", quoted, ", ", i, "]"), quoted, i, F.lit("true"), F.lit("null"), _cat("{", F.col("event_type")))
    v = e.select("event_id", F.explode(values).alias("v"))
    return v.select("event_id", V.value_type(F.col("v")).alias("type"), V.rendered_value(F.col("v")).alias("shown"))


# ---- delimited text, configuration, listings -----------------------------------------------------------------------------


@query("""SELECT conv_id, turn, unnest(['turn,text,empty', turn || ',' || text || ',', 'alone', 'a,b,c,d']) AS cells, unnest([1, 2, 3, 4]) AS nth FROM conversations""")
def csv_ragged_rows(spark, sf_dir):
    """Cells with delimiters, quotes and line ends; rows of any length; lines without a character go."""
    text = _cat("turn,text,empty\r\n", F.col("turn").cast("string"), ',"', F.replace("text", F.lit('"'), F.lit('""')), '",\n\nalone\n"a","b",c,"d"')
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(M.csv_rows(text, F.lit(","))).alias("i", "r"))
    return c.select("conv_id", "turn", F.array_join("r", ",").alias("cells"), (F.col("i") + 1).alias("nth"))


@query("""SELECT s_suppkey, unnest(['name;key', s_name || ';' || s_suppkey || ';x"y']) AS cells FROM supplier""")
def csv_plain_lines(spark, sf_dir):
    text = _cat("name, key \n  \n ", F.col("s_name"), ' , "', F.col("s_suppkey").cast("string"), '","x""y"\n')
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.explode(M.csv_cells_of_lines(text)).alias("r"))
    return s.select("s_suppkey", F.array_join("r", ";").alias("cells"))


@query("""SELECT s_suppkey, unnest(['', '', 'owner', 'owner', 'limits', 'limits', 'limits']) AS section, unnest(['title', 'n', 'name', 'tag', 'balance', 'open', 'list']) AS key,
          unnest(['string', 'int', 'string', 'string', 'float', 'boolean', 'string']) AS kind, unnest([s_name, s_suppkey::VARCHAR, s_name || ' = x', '7', s_nationkey || '.50', 'true', '[1, 2]']) AS value FROM supplier""")
def toml_sections(spark, sf_dir):
    text = _cat("# file\ntitle = \"", F.col("s_name"), "\"\nn = ", F.col("s_suppkey").cast("string"), "\n\n[owner]\nname = '", F.col("s_name"), " = x'\r\ntag = \"7\"\n[ limits ]\nbalance = ", F.col("s_nationkey").cast("string"), ".50\nopen = true\nlist = [1, 2]\nloose")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.explode(M.toml_entries(text)).alias("e"))
    return s.select("s_suppkey", "e.*")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS files, 1 AS dirs, o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 0 END AS total, 'a b ' || o_orderkey || '.txt' AS first FROM orders""")
def listing_totals(spark, sf_dir):
    """The rows between two rules of a listing, and what they add up to."""
    rule = "-" * 19 + " ----- ------------ ------------  ------------------------\n"
    more = F.when(F.col("o_orderkey") % 2 == 0, "2024-01-02 03:04:05 ....A            5              x  c.bin\n").otherwise("\n")
    text = _cat("7-Zip\n2000-01-01 00:00:00 ....A 1 1 outside\n", rule, "2024-01-02 03:04:05 ....A ", F.col("o_custkey").cast("string"), " 17  a b ", F.col("o_orderkey").cast("string"), ".txt\n2024-01-02 03:04:05 D....            0            0  d\nshort line\n", more, rule, "2024-01-02 03:04:05 2 files and more words\n")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", M.listed_7z(text).alias("l"))
    sizes = F.aggregate(F.transform("l", lambda x: x["size"]), F.lit(0).cast("long"), lambda a, b: a + b)
    count = lambda on: F.size(F.filter("l", on))
    return o.select("o_orderkey", count(lambda x: ~x["dir"]).alias("files"), count(lambda x: x["dir"]).alias("dirs"), sizes.alias("total"), F.col("l")[0]["name"].alias("first"))


# ---- subtitles, Markdown, RTF --------------------------------------------------------------------------------------------

_STAMP = "lpad(({0}//3600000)::VARCHAR, greatest(2, length(({0}//3600000)::VARCHAR))::INT, '0') || ':' || lpad(({0}//60000%60)::VARCHAR, 2, '0') || ':' || lpad(({0}//1000%60)::VARCHAR, 2, '0') || '{1}' || lpad(({0}%1000)::VARCHAR, 3, '0')"


def _at(ms, mark: str):
    return F.replace(T.cue_timestamp(ms), F.lit(","), F.lit(mark))


@query(f"""SELECT event_id, unnest(['1', '2']) AS nth, unnest([{_STAMP.format('(m*3)', '.')}, {_STAMP.format('(m*3+1000)', '.')}]) AS start, unnest([event_type || ' said', 'id ' || event_id || ' twice']) AS text FROM (SELECT * EXCLUDE (event_id), event_id, event_id % 100000000 AS m FROM events)""")
def vtt_cue_table(spark, sf_dir):
    e, ms = _t(spark, sf_dir, "events"), F.col("event_id") % 100_000_000 * 3  # hours of two digits
    text = _cat("WEBVTT - a title\r\n\r\n1\r\n", _at(ms, "."), " --> ", _at(ms + 900, "."), " align:start\r\n<v Ann>", F.col("event_type"), "</v> said\r\n\r\n", _at(ms + 1000, "."), " --> ", _at(ms + 1100, "."), "\r\nid ", F.col("event_id").cast("string"), "\r\ntwice\r\n\r\nNOTE nothing")
    rows = e.select("event_id", F.explode(S.cue_table(S.subtitle_cues(text, F.lit(".vtt")))).alias("r"))
    return rows.select("event_id", F.col("r")[0].alias("nth"), F.col("r")[1].alias("start"), F.col("r")[3].alias("text"))


@query(r"""SELECT conv_id, turn, '0:00:01.00' AS start, '0:00:0' || (turn % 9) || '.50' AS stop, role || ', and\Nso' AS text FROM conversations""")
def ass_cue_lines(spark, sf_dir):
    text = _cat("[Events]\nFormat: Layer\nDialogue: 0,0:00:01.00, 0:00:0", (F.col("turn") % 9).cast("string"), ".50,Default,,0,0,0,,{\\i1}", F.col("role"), ", and\\Nso\nDialogue: 0,short\nComment: 0,1,2,3,4,5,6,7,8,9,10")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(S.subtitle_cues(text, F.lit(".ssa"))).alias("c"))
    return rows.select("conv_id", "turn", "c.start", F.col("c.end").alias("stop"), "c.text")


@query("""SELECT conv_id, turn, role || chr(10) || 'end' AS text FROM conversations""")
def subtitle_text(spark, sf_dir):
    """Texts of cues, a line each, without those that hold nothing but markup."""
    text = _cat("1\n00:00:00,000 --> 00:00:01,000\n", F.col("role"), "\n\n2\n00:00:01,000 --> 00:00:02,000\n<i></i>{x}\n\nno time\nhere\nat all\n\n3\n00:00:02,000 --> 00:00:03,000\nend")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", S.cue_text(S.srt_cues(text)).alias("text"))


@query(r"""SELECT conv_id, turn, '<p>' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '(?m)^### (.+)$', '<h3>\1</h3>', 'g'), '(?m)^## (.+)$', '<h2>\1</h2>', 'g'),
    '(?m)^# (.+)$', '<h1>\1</h1>', 'g'), '\*\*(.+?)\*\*', '<strong>\1</strong>', 'g'), '\*(.+?)\*', '<em>\1</em>', 'g'), '`(.+?)`', '<code>\1</code>', 'g'), '(?m)^- (.+)$', '<li>\1</li>', 'g'), '\n\n', '</p><p>', 'g') || '</p>' AS html
    FROM (SELECT conv_id, turn, '# ' || role || chr(10) || '### deep' || chr(10) || '#### deeper' || chr(10) || chr(10) || '**' || turn || '** is *not* `code`' || chr(10) || '- ' || text AS m FROM conversations)""")
def markdown_to_html(spark, sf_dir):
    m = _cat("# ", F.col("role"), "\n### deep\n#### deeper\n\n**", F.col("turn").cast("string"), "** is *not* `code`\n- ", F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", S.markdown_html(m).alias("html"))


@query(r"""SELECT conv_id, turn, 'Hello' || chr(10) || 'World' || turn || ' a\' || role AS text FROM conversations""")
def rtf_text(spark, sf_dir):
    r = _cat("{\\rtf1{\\fonttbl\\f0 Arial;}{\\*\\generator x}\\b Hello\n\n\\par World", F.col("turn").cast("string"), " a\\\\b ", F.col("role"), "\\par}")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_rtf(r).alias("text"))


# ---- pages, mail, PDF ----------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<table(?:\s[^>]*)?>(.*?)</table>', 1)) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<table(?:\s[^>]*)?>(.*?)</table>', 1), 1) AS nth FROM
      (SELECT page_id, html || '<TABLE class="x"><thead><tr><th> url </th><th>n</th></tr></thead><tr><td><b>' || url || '</b></td><td>' || page_id || '</td></tr><tr></tr></TABLE><table></table><table id="y"><tr><td>1</td></tr></table>' AS html FROM pages)),
    r AS (SELECT page_id, nth, unnest(regexp_extract_all(t, '(?is)<tr(?:\s[^>]*)?>(.*?)</tr>', 1)) AS r, generate_subscripts(regexp_extract_all(t, '(?is)<tr(?:\s[^>]*)?>(.*?)</tr>', 1), 1) AS row FROM t),
    c AS (SELECT page_id, nth, row, list_transform(regexp_extract_all(r, '(?is)<t[hd](?:\s[^>]*)?>(.*?)</t[hd]>', 1), lambda x: regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$', '', 'g')) AS c FROM r)
    SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY nth)::INT AS nth, row::INT AS row, array_to_string(c, '|') AS cells FROM c WHERE len(c) > 0""")
def page_tables(spark, sf_dir):
    tables = _cat('<TABLE class="x"><thead><tr><th> url </th><th>n</th></tr></thead><tr><td><b>', F.col("url"), "</b></td><td>", F.col("page_id").cast("string"), '</td></tr><tr></tr></TABLE><table></table><table id="y"><tr><td>1</td></tr></table>')
    t = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(M.html_tables(F.concat("html", tables))).alias("i", "t"))
    rows = t.select("page_id", (F.col("i") + 1).alias("nth"), F.posexplode(F.concat(F.array("t.headers"), "t.rows")).alias("j", "c")).where("size(c) > 0")
    return rows.select("page_id", "nth", (F.col("j") + 1).alias("row"), F.array_join("c", "|").alias("cells"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$', '', 'g') AS text FROM pages""")
def mail_page_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", M.mail_text(F.col("html")).alias("text"))


@query("""SELECT conv_id, turn, role || ' <r@x.org>' AS sender, 'to ' || turn AS subject, CASE WHEN turn % 2 = 0 THEN text ELSE 'head' || chr(10) || chr(10) || text END AS body FROM conversations""")
def mail_fields(spark, sf_dir):
    """Headers and body of mails, of one part and of several."""
    multi = _cat("Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n", F.col("text"), "\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>\r\n--b--")
    plain = _cat("X-None:\nDate: today\n\nhead\n\n", F.col("text"))
    mail = _cat("From: ", F.col("role"), " <r@x.org>\r\nSubject: old\r\nSubject:  to ", F.col("turn").cast("string"), "  \r\n", F.when(F.col("turn") % 2 == 0, multi).otherwise(plain))
    m = _t(spark, sf_dir, "conversations").select("conv_id", "turn", M.mail_parts(mail).alias("m"))
    return m.select("conv_id", "turn", F.col("m.from").alias("sender"), "m.subject", "m.body")


@query("""SELECT conv_id, string_agg(CASE WHEN turn % 4 = 0 THEN turn || '@x.org' ELSE role || ' <' || turn || '@x.org>' END, ', ' ORDER BY turn) FILTER (WHERE role = 'user') AS receivers,
          coalesce(string_agg(turn || '@x.org', ', ' ORDER BY turn) FILTER (WHERE role <> 'user'), '') AS copies FROM conversations GROUP BY conv_id""")
def mail_parties(spark, sf_dir):
    """Recipients by type: those of mails with their names, those of copies by their addresses."""
    c = _t(spark, sf_dir, "conversations").withColumn("at", F.concat(F.col("turn").cast("string"), F.lit("@x.org")))
    name = F.when(F.col("turn") % 4 != 0, F.col("role"))
    one = F.struct("turn", F.when(F.col("role") == "user", "to").otherwise("cc").alias("type"), F.when(F.col("role") == "user", M.address(name, F.col("at"))).otherwise(F.col("at")).alias("address"))
    got = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    to = N.parties(F.col("l"), "to")
    return got.select("conv_id", F.when(to != "", to).alias("receivers"), N.parties(F.col("l"), "cc").alias("copies"))


@query("""SELECT conv_id, turn, role || ' ' || turn || ' tail' AS shown, 'role=' || role || ';empty=' AS fields FROM conversations""")
def pdf_text_layers(spark, sf_dir):
    pdf = _cat("%PDF-1.4 (no) Tj BT /F1 12 Tf (", F.col("role"), ") Tj\n(", F.col("turn").cast("string"), ")Tj ET (out) Tj BT (tail)  Tj (x) TJ ET")
    fdf = _cat("<< /T (role) /Ff 1\n/V (", F.col("role"), ") >> << /T (empty) /V () >>")
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", M.pdf_strings(pdf).alias("shown"), F.array_join(F.transform(M.fdf_fields(fdf), lambda x: F.concat(x["name"], F.lit("="), x["value"])), ";").alias("fields"))


@query("""WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS y, l_partkey AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey, l_linenumber) AS n FROM lineitem),
    f AS (SELECT l_orderkey, n, y AS anchor, 1 AS line FROM i WHERE n = 1 UNION ALL
          SELECT i.l_orderkey, i.n, CASE WHEN abs(i.y - f.anchor) < 3 THEN f.anchor ELSE i.y END, CASE WHEN abs(i.y - f.anchor) < 3 THEN f.line ELSE f.line + 1 END FROM f JOIN i ON i.l_orderkey = f.l_orderkey AND i.n = f.n + 1)
    SELECT l_orderkey, line::INT AS line, string_agg(x, ' ' ORDER BY x) AS text FROM f JOIN i USING (l_orderkey, n) GROUP BY l_orderkey, line""")
def pdf_line_fold(spark, sf_dir):
    """Positioned items as lines: an item joins while it is near the line's first."""
    item = F.struct(F.col("l_partkey").cast("double").alias("x"), F.col("l_quantity").alias("y"), F.col("l_partkey").cast("string").alias("str"))
    got = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    kept = F.filter("items", lambda i: T.trim_all(i["str"]) != "")
    return got.select("l_orderkey", F.posexplode(T.lines_of_items(kept)).alias("i", "text")).select("l_orderkey", (F.col("i") + 1).alias("line"), "text")


@query("""SELECT conv_id, turn, 'Name|Turn' AS headers, role || '|' || turn || '|x y' AS row FROM conversations WHERE turn % 2 = 0""")
def pdf_line_table(spark, sf_dir):
    wide = F.array(F.lit("Name   Turn"), F.lit("not a row"), _cat(F.col("role"), "  ", F.col("turn").cast("string"), "    x y"))
    lines = F.when(F.col("turn") % 2 == 0, wide).otherwise(F.array(F.lit("one cell"), F.lit("a  b")))
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", M.table_of_lines(lines).alias("t")).where("t is not null")
    return c.select("conv_id", "turn", F.array_join("t.headers", "|").alias("headers"), F.explode("t.rows").alias("r")).select("conv_id", "turn", "headers", F.array_join("r", "|").alias("row"))


# ---- parts of containers -------------------------------------------------------------------------------------------------


def _slides(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") % 4 == 3, _cat("ppt/media/slide", F.col("turn").cast("string"), ".xml")).otherwise(_cat("ppt/slides/slide", (F.col("turn") * 5 + 1).cast("string"), ".xml"))
    xml = _cat("<p:sld><a:p><a:r><a:t>", F.col("role"), "</a:t></a:r><a:r><a:t> &amp; ", F.col("turn").cast("string"), "</a:t></a:r></a:p><a:p><a:t> </a:t></a:p><a:p><a:t>end</a:t></a:p></p:sld>")
    return c.select("conv_id", name.alias("name"), xml.alias("xml"))


@query(r"""SELECT conv_id, count(*)::INT AS parts, string_agg(role || ' &amp; ' || turn || chr(10) || 'end', chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id""")
def slide_texts(spark, sf_dir):
    """Slides in the order of their numbers, paragraphs of each; other entries go."""
    return N.joined_parts(_slides(spark, sf_dir), "conv_id", r"ppt/slides/slide\d+\.xml", lambda x: F.array_join(M.paragraphs(x), "\n"))


@query(r"""SELECT conv_id, count(*)::INT AS parts, string_agg(role || ' &amp; ' || turn || ' end', chr(10) || chr(10) ORDER BY 'slide' || (turn * 5 + 1) || '.xml') AS text FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id""")
def parts_by_name(spark, sf_dir):
    """Entries in the order of their names as text: 11 before 6."""
    text = lambda x: F.regexp_replace(T.trim_all(F.regexp_replace(T.strip_tags(x, " "), " +", " ")), " +", " ")
    joined = N.joined_parts(_slides(spark, sf_dir), "conv_id", r"ppt/slides/.*\.xml", lambda x: F.replace(text(x), F.lit("  "), F.lit(" ")), number=False)
    return joined


@query("""SELECT conv_id, turn, role || '|x' AS word, role || '|' || turn AS shared, 'A&amp;B|' || role AS xps, 'one ' || role || '|two' AS odf, role AS paragraphs, coalesce(nullif(role, 'user'), 'none') AS creator, 'OEBPS/text/' AS folder FROM conversations""")
def xml_part_texts(spark, sf_dir):
    """Texts of XML parts by their elements and attributes; entities aren't decoded."""
    r, t = F.col("role"), F.col("turn").cast("string")
    word = _cat("<w:p><w:r><w:t xml:space='preserve'>", r, "</w:t></w:r><w:tab/><w:r><w:t>x</w:t></w:r></w:p>")
    shared = _cat("<sst><si><t>", r, "</t></si><si><t xml:space='preserve'>", t, "</t></si><si><t></t></si></sst>")
    xps = _cat('<Glyphs UnicodeString="A&amp;B" /><Glyphs UnicodeString="', r, '"/><Glyphs UnicodeString=""/>')
    odf = _cat('<text:p text:style-name="P1">one <text:span>', r, "</text:span></text:p><text:p/><text:p>two</text:p>")
    core = F.when(r == "user", F.lit("<cp:coreProperties/>")).otherwise(_cat("<dc:creator>", r, "</dc:creator>"))
    join = lambda a: F.array_join(F.filter(a, lambda x: x != ""), "|")
    c = _t(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", join(T.element_texts(word, "w:t")).alias("word"), join(T.element_texts(shared, "t")).alias("shared"), join(M.attribute_texts(xps)).alias("xps"), join(M.odf_paragraphs(F.replace(odf, F.lit("<text:p/>"), F.lit("")))).alias("odf"),
        join(T.all_of(_cat("<p class='x'>", r, "</p><p></p>"), "<p[^>]*>([^<]+)</p>")).alias("paragraphs"), F.coalesce(T.dublin_core(core, "creator"), F.lit("none")).alias("creator"), N.folder_of(F.lit("OEBPS/text/part.xhtml")).alias("folder"),
    )


# ---- bytes ---------------------------------------------------------------------------------------------------------------


def _hex_of(c, digits: int):
    return F.lpad(F.hex(c), digits, "0")


@query("""SELECT c_custkey, (c_custkey % 65536)::BIGINT AS page_size, c_custkey * 1001 AS page_count, CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'UTF-8' WHEN 2 THEN 'UTF-16le' ELSE 'UTF-16be' END AS encoding, c_nationkey::BIGINT AS schema_version,
          CASE c_custkey % 3 WHEN 0 THEN 'Unix' WHEN 1 THEN 'NTFS' ELSE 'Unknown(77)' END AS gzip_system, c_custkey * 7 AS gzip_size,
          CASE c_custkey % 3 WHEN 0 THEN '2018' WHEN 1 THEN '2000' ELSE 'Unknown' END AS dwg, CASE c_custkey % 3 WHEN 0 THEN 'fixmap(' || c_nationkey % 16 || ')' WHEN 1 THEN 'fixarray(' || c_nationkey % 16 || ')' ELSE 'map16' END AS msgpack,
          CASE WHEN c_custkey % 2 = 0 THEN 'PolyLine' ELSE 'Unknown(99)' END AS shape FROM customer""")
def fixed_headers(spark, sf_dir):
    """Numbers and codes at fixed places of file heads, of both byte orders, and their names."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    zeros = lambda m: F.lit("00" * m)
    sqlite = _bytes(_cat("53514C69746520666F726D6174203300", _hex_of(k % 65536, 4), zeros(10), _hex_of(k * 1001, 8), zeros(8), _hex_of(n, 8), zeros(12), _hex_of(k % 4, 8)))
    swapped = _hex_of(k * 7, 8)
    little = F.concat(*[F.substring(swapped, i, 2) for i in (7, 5, 3, 1)])
    pick = lambda of, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % of + 1).cast("int"))
    gz = _bytes(_cat("1F8B0800", zeros(4), "00", pick(3, "03", "0A", "4D"), zeros(6), little))
    dwg = F.unhex(F.hex(_cat(pick(3, "AC1032", "AC1015", "AC9999"), "rest")))
    msgpack = _bytes(F.when(k % 3 == 2, "DE00").otherwise(_hex_of(n % 16 + F.when(k % 3 == 0, 0x80).otherwise(0x90), 2)))
    shape = F.when(k % 2 == 0, 3).otherwise(99)
    system = B.number(gz, 9, 1)
    unknown = lambda c: F.concat(F.lit("Unknown("), c.cast("string"), F.lit(")"))
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", B.number(sqlite, 16, 2).alias("page_size"), B.number(sqlite, 28, 4).alias("page_count"), B.named(B.number(sqlite, 56, 4).cast("int"), B.SQLITE_ENCODINGS, F.lit("unknown")).alias("encoding"), B.number(sqlite, 40, 4).alias("schema_version"),
        B.named(system.cast("int"), B.GZIP_SYSTEMS, unknown(system)).alias("gzip_system"), B.number(gz, -4, 4, little=True).alias("gzip_size"), B.named(B.latin1(F.substring(dwg, 1, 6)), B.DWG_RELEASES, F.lit("Unknown")).alias("dwg"), P.msgpack_type(msgpack).alias("msgpack"), B.named(shape, B.SHAPE_TYPES, unknown(shape)).alias("shape"),
    )


@query(r"""WITH r AS (SELECT page_id, regexp_extract_all(left(html, 50000), '([\x20-\x7E]+)[^\x20-\x7E]', 1) AS r, html FROM pages)
    SELECT page_id, array_to_string(list_filter(list_filter(r, lambda x: length(x) BETWEEN 3 AND 99 AND regexp_matches(x, '[A-Za-z]')), lambda x, i: list_position(list_filter(r, lambda y: length(y) BETWEEN 3 AND 99 AND regexp_matches(y, '[A-Za-z]')), x) = i)[1:30], '|') AS strings,
           array_to_string(list_filter(list_filter(r, lambda x: length(x) BETWEEN 4 AND 199 AND (regexp_matches(x, '\.[a-zA-Z0-9]{1,10}$') OR contains(x, '/') OR contains(x, '\'))), lambda x, i: list_position(list_filter(r, lambda y: length(y) BETWEEN 4 AND 199 AND (regexp_matches(y, '\.[a-zA-Z0-9]{1,10}$') OR contains(y, '/') OR contains(y, '\'))), x) = i)[1:30], '|') AS names,
           nullif(array_to_string(list_filter(regexp_extract_all(html, '[\x20-\x7E\n\r\t]{6,}'), lambda x: true), chr(10)), '') AS plain FROM r""")
def carved_bytes(spark, sf_dir):
    """Strings carved from bytes; a run that isn't closed in the window doesn't count."""
    raw = F.col("raw")
    return _t(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw")).select("page_id", F.array_join(B.text_strings(raw), "|").alias("strings"), F.array_join(B.archive_strings(raw), "|").alias("names"), B.ascii_text(raw).alias("plain"))


_WORDS = ", ".join(f"'{w}'" for w in B.PARQUET_WORDS)


@query(rf"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:30], ' ') AS kept FROM (SELECT doc_id, list_filter(regexp_extract_all(text || ' org.apache.spark List map_key INT64', '[a-zA-Z_][a-zA-Z0-9_]{{0,63}}'),
            lambda x: length(x) BETWEEN 2 AND 49 AND NOT list_contains([{_WORDS}], x) AND NOT list_contains([{_WORDS}], upper(x))) AS l FROM documents)""")
def stopword_except(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(B.identifiers(_cat(F.col("text"), " org.apache.spark List map_key INT64")), " ").alias("kept"))


_CELL = "coalesce(nullif(substring(h, {0}, 2), ''), '  ')"
_HALF = " || ' ' || ".join


@query(f"""WITH b AS (SELECT page_id, i, lower(substring(hex(encode(html)), i * 32 + 1, least(32, 4096 - i * 32)::INT)) AS h, strlen(html) AS n FROM pages, range(128) r(i) WHERE i * 16 < strlen(html))
    SELECT page_id, i::INT AS nth, lpad(lower(hex(i * 16)), 8, '0') || '  ' || {_HALF([_CELL.format(2 * j + 1) for j in range(8)])} || '  ' || {_HALF([_CELL.format(2 * j + 1) for j in range(8, 16)])} || '  |' ||
      rpad(array_to_string(list_transform(range(0, length(h) // 2), lambda j: CASE WHEN substring(h, (2 * j + 1)::INT, 2) BETWEEN '20' AND '7e' THEN decode(unhex(substring(h, (2 * j + 1)::INT, 2))) ELSE '.' END), ''), 16, ' ') || '|' AS line FROM b
    UNION ALL SELECT page_id, 128, '... (' || CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' ELSE ((strlen(html)*20+1024)//2048)//10 || '.' || ((strlen(html)*20+1024)//2048)%10 || ' KB' END || ' total)' FROM pages WHERE strlen(html) > 2048""")
def hex_dump(spark, sf_dir):
    """Address, sixteen bytes and their characters of the first 2048 bytes of each page; the preview is the feature."""
    return B.hex_rows(_t(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")), "page_id", "content")


@query("""SELECT c_custkey, 132 + 2 * (c_custkey % 5) AS at, 'Modality' AS name, 'CT' AS value FROM customer UNION ALL SELECT c_custkey, 142 + 2 * (c_custkey % 5), 'PatientName', c_name FROM customer""")
def dicom_tags(spark, sf_dir):
    """Tags found by their numbers anywhere in the first bytes."""
    name = F.hex("c_name")
    code = _cat("00" * 128, "4449434D", F.expr("repeat('0000', cast(c_custkey % 5 as int))"), "080060004353", "0200", "4354", "10001000504E", F.lpad(F.hex(F.length("c_name")), 2, "0"), "00", name, "0000000000000000")
    files = _t(spark, sf_dir, "customer").select("c_custkey", _bytes(code).alias("content"))
    return N.dicom_scan(files, "c_custkey")


_DICOM = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(N.DICOM_FIELDS))


@query(f"""WITH f AS (SELECT * FROM (VALUES {_DICOM}) v(pos, key, label)), v AS (SELECT o_custkey, o_orderkey % 26 AS pos, max(CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderkey::VARCHAR ELSE ' ' || o_orderstatus || ' ' END) AS value FROM orders GROUP BY ALL)
    SELECT o_custkey, string_agg(label || ': ' || trim(value), chr(10) ORDER BY pos) AS fields FROM v JOIN f USING (pos) GROUP BY o_custkey""")
def dicom_fields(spark, sf_dir):
    """Tagged values in the order of the map of fields; tags that it doesn't have go."""
    names = F.array(*[F.lit(k) for k, _ in N.DICOM_FIELDS], F.lit("OtherTag"))
    o = F.col("o_orderkey")
    value = F.when(o % 3 == 0, F.col("o_orderpriority")).when(o % 3 == 1, o.cast("string")).otherwise(_cat(" ", F.col("o_orderstatus"), " "))
    v = _t(spark, sf_dir, "orders").select("o_custkey", F.element_at(names, (o % 26 + 1).cast("int")).alias("key"), value.alias("value")).groupBy("o_custkey", "key").agg(F.max("value").alias("value"))
    return N.fields_in_order(v, N.dicom_dimension(spark), "o_custkey").select("o_custkey", F.array_join("fields", "\n").alias("fields"))


@query("""SELECT conv_id, array_to_string(list(label || ': ' || v ORDER BY pos), '; ') AS fields FROM (SELECT conv_id, role, min(turn) AS v FROM conversations GROUP BY conv_id, role) JOIN (VALUES ('assistant', 'Answer', 0), ('user', 'Question', 1)) d(role, label, pos) USING (role) GROUP BY conv_id""")
def fields_by_dimension(spark, sf_dir):
    """Tagged values that a dimension knows, in its order."""
    dim = spark.createDataFrame([("assistant", "Answer", 0), ("user", "Question", 1), ("tool", "Tool", 2)], "key string, label string, pos int")
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("key")).agg(F.min("turn").cast("string").alias("value"))
    return N.fields_in_order(c, dim, "conv_id").select("conv_id", F.array_join("fields", "; ").alias("fields"))


@query("""SELECT conv_id, turn, 'LINE:2,TEXT:1,' || CASE WHEN turn % 2 = 0 THEN 'CIRCLE:1' ELSE 'ARC:1' END AS types, role AS texts, 'door' AS blocks FROM conversations""")
def dxf_entities(spark, sf_dir):
    """Entity types in the order of their first places, with counts; texts; blocks that aren't the system's."""
    last = F.when(F.col("turn") % 2 == 0, "CIRCLE").otherwise("ARC")
    dxf = _cat("  0\r\nLINE\r\n  8\r\n0layer\r\n  0\r\nTEXT\r\n  1\r\nhello\r\n  0\r\nLINE\r\n  0\r\n", last, "\r\n 10\r\n1.0\r\n")
    c = _t(spark, sf_dir, "conversations")
    ent = lambda t, x: F.struct(F.lit(t).alias("type"), x.alias("text"))
    texts = N.texts_of(F.array(ent("LINE", F.lit("no")), ent("TEXT", F.col("role")), ent("MTEXT", F.lit(""))))
    counted = F.transform(M.counted(M.dxf_types(dxf)), lambda x: F.concat(x["item"], F.lit(":"), x["n"].cast("string")))
    return c.select("conv_id", "turn", F.array_join(counted, ",").alias("types"), F.array_join(texts, ",").alias("texts"), F.array_join(N.user_blocks(F.array(F.lit("*Model_Space"), F.lit("door"))), ",").alias("blocks"))


# ---- exports and notebooks -----------------------------------------------------------------------------------------------


@query("""SELECT event_id, ['zip', 'json', 'json', 'html', 'xml', 'markdown', 'markdown', 'csv', 'figma', 'unknown'][event_id % 10 + 1] AS kind FROM events""")
def export_sniff(spark, sf_dir):
    heads = ("PK\u0003\u0004", ' {"a": 1}', "[1]", "<!DOCTYPE html><p>", "<?xml version='1.0'?><a/>", "# Title", "text\n## Sub", "a,b\n1,2", "plain", "plain")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % 10 + 1).cast("int"))
    name = F.when(F.col("event_id") % 10 == 8, "a.fig").otherwise("a.txt")
    return _t(spark, sf_dir, "events").select("event_id", X.sniff(pick(heads), name).alias("kind"))


@query("""SELECT l_orderkey, kind, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f)::INT AS place FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'json' WHEN 'N' THEN 'md' ELSE 'other' END AS kind, count(*) AS n,
          min('f' || l_linenumber || '-' || l_partkey || CASE l_returnflag WHEN 'A' THEN '.JSON' WHEN 'N' THEN '.md' ELSE '' END) AS f FROM lineitem GROUP BY ALL)""")
def export_kinds(spark, sf_dir):
    suffix = F.when(F.col("l_returnflag") == "A", ".JSON").when(F.col("l_returnflag") == "N", ".md").otherwise("")
    e = _t(spark, sf_dir, "lineitem").select("l_orderkey", _cat("f", F.col("l_linenumber").cast("string"), "-", F.col("l_partkey").cast("string"), suffix).alias("name"))
    return X.kinds_of_entries(e, "l_orderkey")


@query("""SELECT event_id, 'array' AS type, 2 AS records, 'id,kind,k' AS headers, event_id || ',' || event_type || ',' || regexp_extract(props, '\\d+') || '|' || event_id || ',,null' AS rows, NULL AS keys FROM events WHERE event_id % 2 = 0
          UNION ALL SELECT event_id, 'object', NULL, NULL, NULL, 'k' FROM events WHERE event_id % 2 = 1""")
def json_exports(spark, sf_dir):
    e, i = _t(spark, sf_dir, "events"), F.col("event_id").cast("string")
    array = _cat('[{"id": ', i, ', "kind": "', F.col("event_type"), '", ', F.regexp_extract("props", r"\{(.*)\}", 1), '}, {"id": ', i, ', "k": null}]')
    x = e.select("event_id", X.json_export(F.when(F.col("event_id") % 2 == 0, array).otherwise(F.col("props"))).alias("x"))
    rows = F.transform("x.rows", lambda r: F.array_join(r, ","))
    return x.select("event_id", "x.type", F.col("x.records").alias("records"), F.array_join("x.headers", ",").alias("headers"), F.array_join(rows, "|").alias("rows"), F.array_join("x.keys", ",").alias("keys"))


@query(rf"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, substring(regexp_replace(CASE WHEN regexp_matches(html, '(?is)<body[^>]*>(.*?)</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END, '<[^>]+>', '', 'g'), 1, 5000) AS text FROM pages""")
def html_exports(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", X.html_export(F.col("html")).alias("x")).select("page_id", "x.*")


@query("""SELECT conv_id, turn, 'thread' AS root, 2 + (turn % 2)::INT AS children, 'Name,Turn' AS headers, 'x, y|' || turn AS row, 3 AS lines, 2 AS n_headings, '## b' AS second, least(5000, length('<thread><a/><b/><c></c></thread>') + length(text)) AS shown FROM conversations""")
def text_exports(spark, sf_dir):
    """XML, CSV and Markdown exports: root and children, headers and rows, headings."""
    t = F.col("turn").cast("string")
    xml = F.when(F.col("turn") % 2 == 0, "<?xml version='1.0'?><thread><a><b/></a><c/></thread>").otherwise("<thread><a/><b/><c>x</c></thread>")
    csv = _cat('"Name", Turn\n\n"x, y", ', t, "\nz\n")
    md = _cat("# ", F.col("role"), "\ntext\n## b\n#no")
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text", X.xml_export(xml).alias("x"), X.csv_export(csv).alias("c"), X.markdown_export(md).alias("m"))
    return c.select("conv_id", "turn", "x.root", "x.children", F.length(X.xml_export(_cat("<thread><a/><b/><c>", F.col("text"), "</c></thread>"))["text"]).cast("long").alias("shown"), F.array_join("c.headers", ",").alias("headers"), F.array_join(F.col("c.rows")[0], "|").alias("row"), "c.lines", F.size("m.headings").alias("n_headings"), F.col("m.headings")[1].alias("second"))


@query("""SELECT conv_id, turn, '--- Cell 1 [markdown] ---' || chr(10) || '# ' || role || chr(10) || chr(10) || '--- Cell 2 [code] ---' || chr(10) || 'a = ' || turn || chr(10) || 'a' || chr(10) || chr(10) || '[Output]' || chr(10) || turn || chr(10) || 'done' AS text,
          2 AS cells, 1 AS code_cells, 1 AS markdown_cells, CASE WHEN turn % 2 = 0 THEN 'Py 3' ELSE 'unknown' END AS kernel, 4 AS nbformat FROM conversations""")
def notebooks(spark, sf_dir):
    t = F.col("turn").cast("string")
    meta = F.when(F.col("turn") % 2 == 0, '{"kernelspec": {"display_name": "Py 3", "name": "py"}}').otherwise("{}")
    nb = _cat('{"nbformat": 4, "metadata": ', meta, ', "cells": [{"cell_type": "markdown", "source": "# ', F.col("role"), '"}, {"cell_type": "code", "source": ["a = ', t, '\\n", "a"], "outputs": [{"data": {"text/plain": ["', t, '"], "image/png": "x"}}, {"data": {}}, {"text": "done"}]}]}')
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.notebook(nb).alias("n")).select("conv_id", "turn", "n.*")
