"""Column functions over file bytes: numbers at fixed places, prefixes and carved strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Words that aren't column names in the end of a Parquet file.
PARQUET_WORDS = [
    "PAR1", "parquet", "schema", "PLAIN", "SNAPPY", "GZIP", "NONE", "OPTIONAL", "REQUIRED", "REPEATED", "UTF8", "INT32", "INT64", "FLOAT",
    "DOUBLE", "BOOLEAN", "BYTE_ARRAY", "FIXED_LEN", "MAP", "LIST", "org", "apache", "spark", "pandas", "writer", "version", "created", "NULL",
]
# Systems by the tenth byte of a gzip file, AutoCAD releases by version code, shape types by number.
GZIP_SYSTEMS = {0: "FAT", 3: "Unix", 7: "Macintosh", 10: "NTFS", 11: "OS/2", 255: "Unknown"}
DWG_RELEASES = {"AC1015": "2000", "AC1018": "2004", "AC1021": "2007", "AC1024": "2010", "AC1027": "2013", "AC1032": "2018"}
SHAPE_TYPES = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint", 11: "PointZ", 13: "PolyLineZ", 15: "PolygonZ"}
SQLITE_ENCODINGS = {1: "UTF-8", 2: "UTF-16le", 3: "UTF-16be"}


def latin1(content: Column) -> Column:
    """Bytes as characters of the same numbers."""
    return F.decode(content, "ISO-8859-1")


def starts_with(content: Column, code: str) -> Column:
    """Whether bytes start with those of a hexadecimal string; null for null."""
    return F.startswith(F.hex(F.substring(content, 1, len(code) // 2)), F.lit(code))


def number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """The unsigned number of ``size`` bytes (4 at most) at place ``at``, counted from 0, or from the end if negative; null where bytes are missing."""
    begin = F.lit(at + 1) if at >= 0 else F.octet_length(content) + (at + 1)
    part = F.hex(F.substr(content, begin, F.lit(size)))
    if little:
        part = F.concat(*[F.substring(part, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.when((F.length(part) == 2 * size) & (begin > 0), F.conv(part, 16, 10).cast("long"))


def number_at(content: Column, at: Column, size: int, little: bool = False, signed: bool = False) -> Column:
    """The number of ``size`` bytes (8 at most) at a place that is a column, counted from 0; null where bytes are missing.  Eight bytes are a long, whatever their sign."""
    part = F.hex(F.substr(content, (at + 1).cast("int"), F.lit(size)))
    if little:
        part = F.concat(*[F.substring(part, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    value = F.conv(part, 16, -10 if size == 8 else 10).cast("long")
    if signed and size < 8:
        value = F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)
    return F.when((at >= 0) & (F.length(part) == 2 * size), value)


def varint(content: Column, at: Column) -> Column:
    """(value, next) of a zig-zag number of variable length at a place that is a column: seven bits a byte, the lowest first, up to ten bytes; nulls where its last byte is missing."""
    code = F.regexp_extract(F.hex(F.substr(content, (at + 1).cast("int"), F.lit(10))), "^((?:[89A-F].){0,9}[0-7].)", 1)

    def read(c):
        n = (F.length(c) / 2).cast("long")
        seven = lambda i: F.conv(F.substr(c, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(0x7F).cast("long"))
        bits = F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", seven(i), (7 * i).cast("int"))))
        return F.struct(bits.alias("bits"), (at + n).alias("next"))

    def decoded(r):
        return F.struct(F.shiftrightunsigned(r["bits"], 1).bitwiseXOR(-r["bits"].bitwiseAND(F.lit(1).cast("long"))).alias("value"), r["next"].alias("next"))

    none = F.struct(F.lit(None).cast("long").alias("bits"), F.lit(None).cast("long").alias("next"))
    return T.let(T.let(code, lambda c: F.when(F.length(c) > 0, read(c)).otherwise(none)), decoded)


def named(key: Column, names: dict, default: Column) -> Column:
    """The name of a key, or the default: a lookup in a few fixed values."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def _distinct(runs: Column, keep, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(runs, keep)), 1, most)


def _runs(content: Column, window: int) -> Column:
    """Runs of printable ASCII in the first ``window`` bytes; one that reaches the end of the window isn't closed and doesn't count."""
    return F.regexp_extract_all(latin1(F.substring(content, 1, window)), F.lit(r"(?<![\x20-\x7E])([\x20-\x7E]++)(?=[^\x20-\x7E])"), F.lit(1))


def text_strings(content: Column, most: int = 30, least: int = 3, below: int = 100) -> Column:
    """Strings of 3 to 99 characters with a letter, each once, in the order of their first place: so many at most, of the first 50,000 bytes (a preview)."""
    return _distinct(_runs(content, 50_000), lambda s: (F.length(s) >= least) & (F.length(s) < below) & s.rlike("[A-Za-z]"), most)


def archive_strings(content: Column, most: int = 30) -> Column:
    """Strings of 4 to 199 characters that look like a file's name: with a suffix, a slash or a backslash."""
    path = lambda s: s.rlike(r"\.[a-zA-Z0-9]{1,10}$") | F.contains(s, F.lit("/")) | F.contains(s, F.lit("\\"))
    return _distinct(_runs(content, 50_000), lambda s: (F.length(s) >= 4) & (F.length(s) < 200) & path(s), most)


def identifiers(text: Column, most: int = 30) -> Column:
    """Identifiers of 2 to 49 characters without the words of the Parquet format, each once, so many at most."""
    words = F.array(*map(F.lit, PARQUET_WORDS))
    found = F.regexp_extract_all(text, F.lit("[a-zA-Z_][a-zA-Z0-9_]{0,63}"), F.lit(0))
    return _distinct(found, lambda s: F.length(s).between(2, 49) & ~F.array_contains(words, s) & ~F.array_contains(words, F.upper(s)), most)


def ascii_text(content: Column) -> Column:
    """Runs of six and more printable characters, tabs and line ends, joined by line ends; null if that is 20 characters or fewer."""
    text = F.array_join(F.regexp_extract_all(latin1(content), F.lit(r"[\x20-\x7E\n\r\t]{6,}"), F.lit(0)), "\n")
    return F.when(F.length(text) > 20, text)


def hex_line(part: Column, at: Column) -> Column:
    """A line of a hex dump: the address, up to sixteen bytes in two halves and their ASCII characters."""
    code = F.rpad(F.lower(F.hex(part)), 32, " ")
    half = lambda begin: F.regexp_replace(F.substring(code, begin, 16), r"(..)(?!$)", "$1 ")
    shown = F.rpad(F.regexp_replace(latin1(part), r"[^\x20-\x7E]", "."), 16, " ")
    return F.concat(F.lpad(F.lower(F.hex(at)), 8, "0"), F.lit("  "), half(1), F.lit("  "), half(17), F.lit("  |"), shown, F.lit("|"))


def _lines(content: Column, most: int) -> Column:
    """Places of the lines of a hex dump of the first bytes."""
    n = F.when(F.octet_length(content) > most, F.lit(most)).otherwise(F.octet_length(content))
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 16) * 16, F.lit(16).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _rest(content: Column) -> Column:
    return F.concat(F.lit("... ("), T.file_size_label(F.octet_length(content)), F.lit(" total)"))


def hex_lines(content: Column, most: int = 2048) -> Column:
    """A hex dump of the first bytes as an array of lines; then the whole size if there is more."""
    lines = F.flatten(F.transform(F.array(F.substring(content, 1, most)), lambda b: F.transform(_lines(content, most), lambda at: F.transform(F.array(F.substr(b, (at + 1).cast("int"), F.lit(16))), lambda part: hex_line(part, at))[0])))
    return F.when(F.octet_length(content) > most, F.array_append(lines, _rest(content))).otherwise(lines)


def hex_rows(files: DataFrame, key: str, content: str, most: int = 2048) -> DataFrame:
    """(key, nth, line): the same, a row for each line, each made of its own sixteen bytes; null and empty values have none."""
    c = F.col(content)
    lines = files.select(key, F.substring(c, 1, most).alias("__b"), F.posexplode(_lines(c, most)).alias("nth", "__at"))
    lines = lines.select(key, "nth", F.col("__at"), F.substr("__b", (F.col("__at") + 1).cast("int"), F.lit(16)).alias("__part")).select(key, "nth", hex_line(F.col("__part"), F.col("__at")).alias("line"))
    more = files.where(F.octet_length(c) > most).select(key, F.lit(-(-most // 16)).alias("nth"), _rest(c).alias("line"))
    return lines.unionByName(more)


def utf16_units(content: Column, start: int = 0, most: int | None = None) -> Column:
    """Bytes from an even or odd place on as text of UTF-16 units, the low byte first; what isn't a whole unit at the end is left out. ``most``: bytes that are looked at."""
    size = F.octet_length(content) - start
    if most is not None:
        size = F.least(size, F.lit(most))
    return F.decode(F.substr(content, F.lit(start + 1), F.greatest(F.lit(0), size - size % 2)), "UTF-16LE")


# The characters of runs, as classes.
DOC_UNITS = r"\x20-\x7E\u3000-\u303F\u3131-\u318E\u4E00-\u9FFF\uAC00-\uD7AF\uFF01-\uFF5E"
OLE_UNITS = r"\x20-\x7E\u3000-\u9FFF\uAC00-\uD7AF"


def utf16_document(content: Column, start: int = 0) -> Column:
    """Text of a word processor's stream: runs of four units and more, line by line, carriage returns and line feeds as line ends; empty if it is ten characters or fewer. The last run counts."""
    runs = F.regexp_extract_all(utf16_units(content, start), F.lit(rf"[{DOC_UNITS}\t\n\r]{{4,}}+"), F.lit(0))
    text = T.trim_all(T.collapsed(F.replace(F.array_join(runs, "\n"), F.lit("\r"), F.lit("\n"))))
    return F.when(F.length(text) > 10, text).otherwise("")


def utf16_strings(content: Column, start: int = 0, most: int = 20, window: int = 100_000) -> Column:
    """Strings of three units and more with a letter or a syllable, in order: so many at most, of the first bytes; one that no other unit ends doesn't count."""
    runs = F.regexp_extract_all(utf16_units(content, start, window), F.lit(rf"(?<![{OLE_UNITS}])([{OLE_UNITS}]{{3,}}+)(?=[^{OLE_UNITS}])"), F.lit(1))
    return F.slice(F.filter(runs, lambda s: s.rlike(r"[a-zA-Z\uAC00-\uD7AF]")), 1, most)


def utf16_lines(content: Column, start: int = 0, most: int = 200, window: int = 200_000) -> Column:
    """Lines of two units and more, trimmed, in order: those that a line end closes, and of others those with a Hangul syllable; the last counts like the others."""
    runs = F.regexp_extract_all(utf16_units(content, start, window), F.lit(rf"[{OLE_UNITS}]++[\r\n]?"), F.lit(0))
    kept = F.filter(runs, lambda r: (F.length(T.trim_all(r)) >= 2) & (F.endswith(r, F.lit("\n")) | F.endswith(r, F.lit("\r")) | r.rlike(r"[\uAC00-\uD7AF]")))
    return F.slice(F.transform(kept, T.trim_all), 1, most)
