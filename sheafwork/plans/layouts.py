"""Queries over nested and linked layouts: indents, braces, record chains, boxes, blocks and sectors, in files whose parts are rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from ..operators import chains as C
from ..operators import containers as K
from ..operators import nesting as E
from .base import query
from .base import table as _t
from .formats import _cat


def _hex(c, size: int, little: bool = False):
    """A number as so many bytes in hexadecimal; negative ones as their complement."""
    code = F.substring(F.lpad(F.hex(c), 16, "0"), 17 - 2 * size, 2 * size)
    return F.concat(*[F.substring(code, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]) if little else code


def _orders(spark, sf_dir, part, *more):
    """(k, body, n): a row for each customer with the hexadecimal ``part`` of each order end to end, by key."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), "o_orderstatus")
    got = o.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("o", part.alias("part"), *more))).alias("l"))
    return got.withColumn("body", F.array_join(F.transform("l", lambda x: x["part"]), "")).withColumn("n", F.size("l"))


_O = "o AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus AS s, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"
_BEFORE = "coalesce(sum({0}) OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


# ---- indents and braces --------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    d AS (SELECT conv_id, count(*) AS m, max(n) AS longest FROM c GROUP BY conv_id)
    SELECT conv_id, unnest(['talk', 'talk.id', 'talk.open', 'talk.size', 'talk.size.turns', 'talk.size.longest', 'turns', 'tags', 'tags[0]', 'tags[1]', 'ratio', 'none']) AS path,
           unnest(['map', 'int', 'boolean', 'map', 'int', 'int', 'list', 'list', 'string', 'int', 'float', 'null']) AS kind,
           unnest([NULL, conv_id::VARCHAR, CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END, NULL, m::VARCHAR, longest::VARCHAR, NULL, NULL, 'a b', conv_id::VARCHAR, m || '.5', NULL]) AS value FROM d
    UNION ALL SELECT conv_id, 'turns[' || i || ']' || unnest(['', '.role', '.at', '.at.n', '.at.seen', '.at.seen[0]', '.at.seen[1]']), unnest(['map', 'string', 'map', 'int', 'list', 'int', 'string']),
           unnest([NULL, role || ': #' || turn, NULL, n::VARCHAR, NULL, turn::VARCHAR, role]) FROM c""")
def yaml_paths(spark, sf_dir):
    """Maps and lists in each other, told apart by their indents: a file for each conversation."""
    turn = _cat("- role: '", F.col("role"), ": #", F.col("turn").cast("string"), "'\n  at:\n     n: ", F.length("text").cast("string"), "  # characters\n     seen:\n     - ", F.col("turn").cast("string"), "\n     - ", F.col("role"), "\n")
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("l"), F.max(F.length("text")).alias("longest"))
    i, m = F.col("conv_id").cast("string"), F.size("l").cast("string")
    head = _cat("# a talk\n---\ntalk:\n  id: 0\n  \"id\": ", i, "\n  open: ", F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false"), "\r\n  size:\n      turns: ", m, "\n      longest: ", F.col("longest").cast("string"), "\n\nturns:\n")
    text = _cat(head, F.array_join(F.transform("l", lambda x: x["t"]), ""), "tags: [a b, ", i, "]\nratio: ", m, ".5\nnone:\n")
    return E.yaml_values(c.select("conv_id", text.alias("text")), "conv_id", "text")


@query("""WITH s AS (SELECT s_nationkey AS k, s_suppkey AS s, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier)
    SELECT k, unnest(['package', 'message', 'field', 'message', 'field', 'field', 'field', 'enum', 'value', 'value', 'service', 'rpc', 'rpc']) AS kind,
           unnest(['n' || k || '.api', 'Nation', 'Nation.key', 'Nation.Inner', 'Nation.Inner.tag', 'Nation.a', 'Nation.b', 'Nation.Kind', 'Nation.Kind.ZERO', 'Nation.Kind.LOW', 'Find', 'Find.Get', 'Find.All']) AS path,
           unnest([NULL, NULL, 'int32', NULL, 'string', 'int64', 'map<string,Inner>', NULL, NULL, NULL, NULL, 'Inner Nation', 'Inner stream Nation']) AS type,
           unnest([NULL, NULL, 1, NULL, 1, 2, k + 3, NULL, 0, -1, NULL, NULL, NULL])::BIGINT AS number FROM (SELECT DISTINCT k FROM s)
    UNION ALL SELECT k, unnest(['message', 'field', 'message', 'field']), 'Supplier' || s || unnest(['', '.id', '.Deep', '.Deep.at']), unnest([NULL, 'fixed64', NULL, 'n' || k || '.Nation']), unnest([NULL, i, NULL, i + 1]) FROM s""")
def proto_paths(spark, sf_dir):
    """Packages, messages in messages, fields, enums and services, told apart by their braces: a file for each nation."""
    k, s, i = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string"), lambda n: (F.col("i") + n).cast("string")
    ranked = C.running(_t(spark, sf_dir, "supplier"), ["s_nationkey"], "s_suppkey", F.lit(1), "i")
    own = _cat("message Supplier", s, " {fixed64 id = ", i(0), ";message Deep{ optional n", k, ".Nation at=", i(1), " [deprecated = true];}}\n")
    got = ranked.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", own.alias("t")))).alias("l"))
    head = _cat('syntax = "proto3"; // one { brace\npackage n', k, ".api;\nimport \"a.proto\";\nmessage Nation {\n  int32 key = 1;\n  message Inner { repeated string tag = 1; reserved 4, 5; }\n  oneof pick { int64 a = 2; map<string, Inner> b = ", (F.col("s_nationkey") + 3).cast("string"), "; }\n",
        "  enum Kind { ZERO = 0; LOW = -1; }\n  option (x) = { y: 1 };\n}\n/* message Not {\n int32 x = 1; } */\nservice Find { rpc Get (Inner) returns (Nation); rpc All (Inner) returns (stream Nation) { option (z) = 2; } }\n")
    files = got.select(F.col("s_nationkey").alias("k"), _cat(head, F.array_join(F.transform("l", lambda x: x["t"]), "")).alias("text"))
    return E.proto_definitions(files, "k", "text")


# ---- chains --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_O}, p AS (SELECT *, 100 + {_BEFORE.format('8 + 2 * (o % 20)')} AS at, 100 + sum(8 + 2 * (o % 20)) OVER (PARTITION BY k) - CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END AS size FROM o)
    SELECT k, nth, p.at::BIGINT AS at, CASE WHEN k % 7 = 1 THEN 2147483616 WHEN k % 7 = 2 THEN -8 ELSE 2 * (o % 20) END AS bytes FROM p WHERE p.at + 8 < size AND (nth = 0 OR k % 7 NOT IN (1, 2))""")
def shape_chain(spark, sf_dir):
    """Records of mixed lengths: a file for each customer, some cut short, some with a length beyond the end or back to the record itself."""
    o = F.col("o")
    files = _orders(spark, sf_dir, _cat(_hex(o, 4), _hex(o % 20, 4), F.repeat(F.lit("0000"), (o % 20).cast("int"))))
    first = F.when(F.col("k") % 7 == 1, F.lit("3FFFFFF0")).when(F.col("k") % 7 == 2, F.lit("FFFFFFFC")).otherwise(F.substring("body", 9, 8))
    whole = _cat("0000270A", "00" * 96, F.substring("body", 1, 8), first, F.substr("body", F.lit(17)))
    cut = F.when(F.col("k") % 7 == 0, F.substr(whole, F.lit(1), F.length(whole) - 6)).otherwise(whole)
    return K.shape_records(files.select("k", F.unhex(cut).alias("content")), "k", "content")


_ZIP_SIZE = "30 + length('o' || o || '.txt') + o % 3 + 4 + o % 30"


def _archives(spark, sf_dir):
    o = F.col("o")
    name = _cat("o", o.cast("string"), ".txt")
    part = _cat("504B03041400", F.when(F.col("o_orderstatus") == "F", "0108").otherwise("0008"), "0000" * 3, "00000000", _hex(4 + o % 30, 4, True), _hex(o, 4, True), _hex(F.length(name), 2, True), _hex(o % 3, 2, True), F.hex(name), F.repeat(F.lit("FF"), (o % 3).cast("int")), "504B0304", F.repeat(F.lit("50"), (o % 30).cast("int")))
    files = _orders(spark, sf_dir, part)
    parts = F.transform("l", lambda x: x["part"])
    cut = F.array_join(F.concat(F.slice(parts, 1, 2), F.array(F.lit("00")), F.slice(parts, 3, F.greatest(F.size("l"), F.lit(1)))), "")
    body = F.when(F.col("k") % 5 == 0, cut).otherwise(_cat(F.col("body"), "504B0102", "504B030414000000" + "0000" * 3))
    return files.select("k", F.unhex(body).alias("content"))


@query(f"""WITH {_O}, s AS (SELECT *, CASE WHEN o < 1024 THEN o || ' B' ELSE ((o*20+1024)//2048)//10 || '.' || ((o*20+1024)//2048)%10 || ' KB' END AS label FROM o WHERE k % 5 <> 0 OR nth < 2)
    SELECT k, count(*) AS files, count(*) FILTER (WHERE s = 'F') AS encrypted, sum(o)::BIGINT AS bytes, string_agg('o' || o || '.txt' || CASE WHEN s = 'F' THEN ' [암호화]' ELSE '' END || ' (' || label || ')', chr(10) ORDER BY nth) FILTER (WHERE nth < 8) AS listing,
           CASE WHEN count(*) > 8 THEN '... 외 ' || (count(*) - 8) || '개' END AS note FROM s GROUP BY k""")
def zip_reports(spark, sf_dir):
    """What listings of archives say: entries, encrypted ones, sizes (in KB at most, as the SQL has them), the first eight lines."""
    return K.archive_reports(K.zip_entries(_archives(spark, sf_dir), "k", "content"), "k", most=8, largest="KB")


@query(f"""WITH {_O} SELECT k, nth, ({_BEFORE.format(_ZIP_SIZE)})::BIGINT AS at, 'o' || o || '.txt' AS name, o AS size, 4 + o % 30 AS packed, s = 'F' AS encrypted FROM o WHERE k % 5 <> 0 OR nth < 2""")
def zip_chain(spark, sf_dir):
    """Local heads of archives, with signatures inside the data; one archive in five has something else behind its second entry."""
    return K.zip_entries(_archives(spark, sf_dir), "k", "content")


@query(f"""WITH {_O} SELECT k, nth, ({_BEFORE.format('512 + 512 * ceil(o % 1500 / 512.0)::BIGINT')})::BIGINT AS at, 'd/o' || o || '.bin' AS name, o % 1500 AS size FROM o WHERE nth < 100 AND (k % 4 <> 0 OR nth < 1)""")
def tar_chain(spark, sf_dir):
    """Heads of tar archives, sizes in octal; one archive in four has a blank name behind its first entry."""
    o = F.col("o")
    name = _cat("d/o", o.cast("string"), ".bin")
    octal = F.lpad(F.conv((o % 1500).cast("string"), 10, 8), 11, "0")
    head = _cat(F.rpad(F.hex(name), 200, "0"), "00" * 24, F.hex(octal), "00" * (512 - 135))
    part = _cat(head, F.rpad(F.repeat(F.lit("78"), (o % 1500).cast("int")), (F.ceil((o % 1500) / 512) * 1024).cast("int"), F.lit("0")))
    files = _orders(spark, sf_dir, part)
    blank = F.lit("00" * 200 + "78" * 312)
    parts = F.transform("l", lambda x: x["part"])
    body = F.when(F.col("k") % 4 == 0, F.array_join(F.concat(F.slice(parts, 1, 1), F.array(blank), F.slice(parts, 2, F.greatest(F.size("l"), F.lit(1)))), "")).otherwise(F.col("body"))
    return K.tar_entries(files.select("k", F.unhex(_cat(body, "00" * 1024)).alias("content")), "k", "content")


@query(f"""WITH {_O}, f AS (SELECT k, n, sum(16 + o % 5) AS moov FROM o GROUP BY k, n)
    SELECT k, unnest(['/ftyp', '/meta', '/meta/iprp', '/meta/iprp/ipco', '/moov']) AS path, unnest([0, 16, 28, 36, 16 + 28 + 20 * n])::BIGINT AS at, unnest([16, 28 + 20 * n, 16 + 20 * n, 8 + 20 * n, 8 + moov])::BIGINT AS size,
           unnest([0, 0, 1, 2, 0])::INT AS level, NULL::BIGINT AS width, NULL::BIGINT AS height FROM f
    UNION ALL SELECT k, '/meta/iprp/ipco/ispe', 44 + 20 * nth, 20, 3, o % 4000, k FROM o
    UNION ALL SELECT k, unnest(['/moov/trak', '/moov/trak/free']), (52 + 20 * n + {_BEFORE.format('16 + o % 5')} + unnest([0, 8]))::BIGINT, unnest([16 + o % 5, 8 + o % 5]), unnest([1, 2])::INT, NULL, NULL FROM o""")
def media_boxes(spark, sf_dir):
    """Boxes in boxes, level by level: a file for each customer, with a picture's sizes and a track for each order."""
    o = F.col("o")
    box = lambda name, size, *body: _cat(_hex(size, 4), name.encode().hex().upper(), *body)
    ispe = box("ispe", F.lit(20), "00000000", _hex(o % 4000, 4), _hex(F.col("k"), 4))
    trak = box("trak", 16 + o % 5, box("free", 8 + o % 5, F.repeat(F.lit("AA"), (o % 5).cast("int"))))
    got = _orders(spark, sf_dir, ispe, trak.alias("trak"))
    n, tracks = F.col("n"), F.array_join(F.transform("l", lambda x: x["trak"]), "")
    body = _cat("0000001066747970", "6865696300000000", box("meta", 28 + 20 * n, "00000000", box("iprp", 16 + 20 * n, box("ipco", 8 + 20 * n, F.col("body")))), box("moov", 8 + F.length(tracks) / 2, tracks))
    return K.boxes(got.select("k", F.unhex(body).alias("content")), "k", "content")


_SIZE = "(1 + (o % 200 >= 63)::INT) + (1 + (o % 300 >= 63)::INT) + o % 300 + 1 + 16"


@query(f"""WITH {_O}, p AS (SELECT *, 4 + 1 + 12 + 6 + 11 + 5 + 1 + 16 + {_BEFORE.format(_SIZE)} AS at FROM o) SELECT k, nth, p.at::BIGINT AS at, o % 200 + 1 AS records, o % 300 + 1 AS bytes FROM p WHERE k % 6 <> 0 OR nth < n - 1""")
def avro_chain(spark, sf_dir):
    """Blocks between markers, read in ranges of 64 bytes: counts and sizes of one byte and of two; one file in six is cut short."""
    o, k = F.col("o"), F.col("k")

    def number(v):
        z = 2 * v
        return F.when(z < 128, _hex(z, 1)).otherwise(F.concat(_hex(128 + z % 128, 1), _hex(F.floor(z / 128), 1)))

    sync = F.upper(F.md5(k.cast("string").cast("binary")))
    got = _orders(spark, sf_dir, _cat(number(o % 200 + 1), number(o % 300 + 1), F.repeat(F.lit("07"), (o % 300 + 1).cast("int")), sync))
    text = lambda x: x.encode().hex().upper()
    whole = _cat("4F626A0104", "16" + text("avro.schema") + "0A" + text('"int"') + "14" + text("avro.codec") + "08" + text("null") + "00", sync, F.col("body"))
    cut = F.when(k % 6 == 0, F.substr(whole, F.lit(1), F.length(whole) - 34)).otherwise(whole)
    return K.avro_blocks(got.select("k", F.unhex(cut).alias("content")), "k", "content", ranged=64)


@query(f"""WITH {_O}, w AS (SELECT k, 4 * nth + i AS p, t FROM o, LATERAL (SELECT unnest([0, 1, 2]) AS i, unnest(['o' || o, 'U' || chr(3) || 'abc' || o, 'é' || s]) AS t))
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY p) - 1 AS nth, t AS text FROM w QUALIFY nth < 50""")
def pickle_strings(spark, sf_dir):
    """Strings behind opcodes, in order; what looks like an opcode inside a string isn't one."""
    o = F.col("o")
    short = lambda code, t: _cat(code, _hex(F.octet_length(t), 1), F.hex(t))
    inner = _cat("U\x03abc", o.cast("string"))
    part = _cat(short("8C", _cat("o", o.cast("string"))), "7100", "58", _hex(F.octet_length(inner), 4, True), F.hex(inner), short("55", _cat("é", F.col("o_orderstatus"))), "8C0178")
    files = _orders(spark, sf_dir, part)
    return K.pickled_strings(files.select("k", F.unhex(_cat("8004", F.col("body"), "2E55FF")).alias("content")), "k", "content")


@query("""SELECT c_nationkey AS k, string_agg(c_name, chr(10) ORDER BY c_custkey) AS text FROM customer GROUP BY c_nationkey""")
def sector_streams(spark, sf_dir):
    """Text of a stream whose sectors lie backwards in the file: a compound file for each nation."""
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("l"))
    c = c.select("k", F.encode(F.array_join(F.transform("l", lambda x: x["c_name"]), "\n"), "UTF-16LE").alias("raw"))
    # Sectors of 512 bytes, or of 4096 where the 109 sectors of the table that a head names wouldn't do.
    c = c.select("k", "raw", F.explode(F.array(F.greatest(F.lit(4096), F.octet_length("raw")).cast("long"))).alias("length"))  # a step of its own: lambdas look at the length, not at the text
    c = c.withColumn("z", F.when(F.col("length") > 108 * 127 * 512, 4096).otherwise(512).cast("long"))
    c = c.withColumn("m", F.ceil(F.col("length") / F.col("z")).cast("long"))
    c = c.withColumn("f", F.ceil((F.col("m") + 1) / (F.col("z") / 4 - 1)).cast("long"))  # sectors: the table's, the directory, the stream's
    m, f, z = F.col("m"), F.col("f"), F.col("z")
    le = lambda v: _hex(v, 4, True)
    entry = lambda i: F.when(i < f, le(F.lit(0xFFFFFFFD))).when(i == f, le(F.lit(0xFFFFFFFE))).when(i == f + 1, le(F.lit(0xFFFFFFFE))).when(i <= f + m, le(i - 1)).otherwise(F.lit("FFFFFFFF"))
    padded = lambda x: F.rpad(x, (2 * z).cast("int"), F.lit("0"))
    table = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), f * (z / 4).cast("long") - 1), entry), "")
    heads = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(108).cast("long")), lambda i: F.when(i < f, le(i)).otherwise(F.lit("FFFFFFFF"))), "")
    version = F.when(z == 512, F.lit("3E000300FEFF09000600")).otherwise(F.lit("3E000400FEFF0C000600"))
    head = _cat("D0CF11E0A1B11AE1", "00" * 16, version, "00" * 10, le(f), le(f), "00000000", "00100000", "FEFFFFFF", "00000000", "FEFFFFFF", "00000000", heads)
    name = lambda n: n.encode("utf-16-le").hex().upper().ljust(128, "0") + f"{2 * len(n) + 2:02X}00"
    root = name("Root Entry") + "0501" + "FF" * 12 + "00" * 36 + "FEFFFFFF" + "00" * 8
    stream = _cat(name("WordDocument"), "0201", "FF" * 12, "00" * 36, le(f + m), le(F.col("length")), "00000000")
    sector = lambda raw, i: padded(F.hex(F.substr(raw, (i * z + 1).cast("int"), z.cast("int"))))
    backwards = T.let(F.col("raw"), lambda raw: F.array_join(F.reverse(F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda i: sector(raw, i))), ""))
    files = c.select("k", F.unhex(_cat(padded(head), table, padded(_cat(root, stream)), backwards)).alias("content"))
    return K.document_text(files, "k", "content").select(F.col("k").cast("int").alias("k"), "text")


# ---- runs of UTF-16 ------------------------------------------------------------------------------------------------------

_U = r"\x{20}-\x{7E}\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}"
_D = r"\x{20}-\x{7E}\x{3000}-\x{303F}\x{3131}-\x{318E}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{FF01}-\x{FF5E}"
_TRIM = r"regexp_replace({0}, '^[\s\x{{a0}}\x{{feff}}]+|[\s\x{{a0}}\x{{feff}}]+$', '', 'g')"


@query(rf"""WITH t AS (SELECT doc_id, text, '가나' || chr(10) || '값 ' || doc_id || chr(233) || text AS x FROM documents),
    d AS (SELECT doc_id, {_TRIM.format(r"regexp_replace(replace(array_to_string(regexp_extract_all(x, '[" + _D + r"\t\n\r]{4,}'), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS document,
          regexp_extract_all(left(x, 50000), '([{_U}]{{3,}})[^{_U}]', 1) AS s, regexp_extract_all(left(x, 100000), '([{_U}]+)([\r\n]?)', 1) AS l, regexp_extract_all(left(x, 100000), '([{_U}]+)([\r\n]?)', 2) AS e FROM t)
    SELECT doc_id, CASE WHEN length(document) > 10 THEN document ELSE '' END AS document, array_to_string(list_filter(s, lambda y: regexp_matches(y, '[a-zA-Z\x{{AC00}}-\x{{D7AF}}]'))[1:20], '|') AS strings,
           array_to_string(list_transform(list_filter(list_zip(l, e), lambda y: length({_TRIM.format('y[1]')}) >= 2 AND (y[2] <> '' OR regexp_matches(y[1], '[\x{{AC00}}-\x{{D7AF}}]'))), lambda y: {_TRIM.format('y[1]')})[1:200], '|') AS lines FROM d""")
def utf16_runs(spark, sf_dir):
    """Runs of UTF-16 units, by three rules of what ends a run; every second document begins at an odd place."""
    text = _cat("가나\n값 ", F.col("doc_id").cast("string"), "é", F.col("text"))
    odd = F.col("doc_id") % 2
    d = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(odd == 1, F.unhex(F.lit("EA"))).otherwise(F.unhex(F.lit(""))), F.encode(text, "UTF-16LE")).alias("content"))
    by = lambda f, *more: F.when(odd == 1, f(F.col("content"), 1)).otherwise(f(F.col("content"), 0))
    joined = lambda f: lambda c, start: F.array_join(f(c, start), "|")
    return d.select("doc_id", by(B.utf16_document).alias("document"), by(joined(B.utf16_strings)).alias("strings"), by(joined(B.utf16_lines)).alias("lines"))
