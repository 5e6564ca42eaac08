"""From files to results: text, metadata and tables of each file, by the parser of its format.

A parser is a function from the columns of a file to a column of parts(): a plan, not code that runs on rows. All parsers of the session's table stand in one CASE on
the parser's name, so only a file's own is evaluated, without a shuffle and without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from . import markup as M
from . import subtitles as S

TABLES = "array<struct<headers:array<string>,rows:array<array<string>>>>"
PARTS = f"struct<text:string,metadata:map<string,string>,tables:{TABLES},failure:string>"

# Texts of results.
UNSUPPORTED = " 포맷은 현재 브라우저에서 직접 파싱할 수 없습니다. (API 접근 또는 서버 사이드 처리 필요)"
NO_PARSER = "파서를 찾을 수 없습니다: "
FAILED = "파싱 중 오류 발생: "
NOT_PDF = "PDF 시그니처를 찾을 수 없습니다"
FILE_SIZE, STRINGS_FOUND, NAMES_FOUND = "파일 크기: ", "감지된 문자열:", "감지된 파일명:"


@dataclass
class File:
    """Columns of a file, as parsers see them.  ``text`` is the content as UTF-8, ``suffix`` the last one of the name."""

    name: Column
    size: Column
    content: Column
    format: Column

    @property
    def suffix(self) -> Column:
        return T.last_suffix(self.name)

    @property
    def text(self) -> Column:
        return T.text_of(self.content)


Parser = Callable[[File], Column]


def parts(text: Column, metadata: dict[str, Column] | None = None, tables: Column | None = None, failure: Column | None = None) -> Column:
    """What a parser gives back.  Entries of metadata that are null are left out; ``failure`` is why a file could not be parsed."""
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    known = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map()
    return F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        known.cast("map<string,string>").alias("metadata"),
        (F.array() if tables is None else tables).cast(TABLES).alias("tables"),
        (F.lit(None) if failure is None else failure).cast("string").alias("failure"),
    ).cast(PARTS)


def table(headers: Column, rows: Column) -> Column:
    return F.array(F.struct(headers.alias("headers"), rows.alias("rows")))


def route(key: Column, ways: dict[str | tuple[str, ...], Column], default: Column) -> Column:
    out = None
    for names, way in ways.items():
        hit = key.isin(*(names if isinstance(names, tuple) else (names,)))
        out = F.when(hit, way) if out is None else out.when(hit, way)
    return out.otherwise(default)


def _count(items: Column) -> Column:
    return F.size(items)


def _nothing(texts: Column, sep: str, otherwise: str) -> Column:
    return F.when(F.size(texts) > 0, F.array_join(texts, sep)).otherwise(otherwise)


def _found(strings: Column, title: str) -> Column:
    listed = F.array_join(F.transform(strings, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.when(F.size(strings) > 0, F.concat(F.lit(f"\n{title}\n"), listed)).otherwise("")


def _sized(title: Column, f: File, *more: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit(f"]\n{FILE_SIZE}"), T.file_size_label(f.size), F.lit("\n"), *more)


def delimited(f: File) -> Column:
    tab = f.suffix == ".tsv"

    def told(rows):
        headers, data = F.get(rows, F.lit(0)), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
        empty = F.size(rows) == 0
        meta = {"format": F.when(~empty, "CSV"), "rows": F.when(empty, 0).otherwise(F.size(data)), "columns": F.when(empty, 0).otherwise(F.size(headers)), "headers": F.array_join(headers, ", "), "delimiter": F.when(~empty, F.when(tab, "TAB").otherwise(","))}
        return parts(f.text, meta, F.when(~empty, table(headers, data)).otherwise(F.array().cast(TABLES)))

    return T.let(M.csv_rows(f.text, F.when(tab, "\t").otherwise(",")), told)


def markdown(f: File) -> Column:
    heads = S.headings(f.text)
    shown = F.array_join(F.transform(heads, lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"])), ", ")
    return parts(f.text, {"headings": shown, "html": S.markdown_html(f.text), "lines": F.size(F.split(f.text, "\n")), "format": F.lit("Markdown")})


def subtitle(f: File) -> Column:
    heads = F.array(*map(F.lit, ("#", "Start", "End", "Text")))
    return T.let(S.subtitle_cues(f.text, f.suffix), lambda cues: parts(S.cue_text(cues), {"entries": _count(cues), "format": f.suffix}, table(heads, S.cue_table(cues))))


def pdf(f: File) -> Column:
    """Text layers of uncompressed PDFs and forms; a file without the signature has no text and says so in its metadata."""
    fields = M.fdf_fields(f.text)
    listed = F.array_join(F.transform(fields, lambda x: F.concat(x["name"], F.lit(": "), x["value"])), "\n")
    form = parts(F.when(F.size(fields) > 0, listed).otherwise(F.substring(f.text, 1, 5000)), {"format": F.lit("FDF"), "fields": F.when(F.size(fields) > 0, F.size(fields))})
    shown = M.pdf_strings(B.latin1(f.content))
    whole = parts(F.when(shown != "", shown).otherwise(_sized(F.lit("PDF"), f)), {"format": F.lit("PDF"), "size": f.size})
    return F.when(f.suffix.isin(".fdf", ".xfdf"), form).when(B.starts_with(f.content, "25504446"), whole).otherwise(parts(F.lit(""), {"error": F.lit(NOT_PDF)}))


def office(f: File) -> Column:
    """RTF, OpenDocument and XPS as far as their text stands in the file uncompressed; others by size."""
    rtf = parts(T.strip_rtf(f.text), {"format": F.lit("RTF"), "originalSize": T.utf16_length(f.text)})
    odf, xps = M.odf_paragraphs(f.text), M.attribute_texts(f.text)
    odf = parts(_nothing(odf, "\n", "[OpenDocument]"), {"format": F.lit("OpenDocument"), "paragraphs": F.when(F.size(odf) > 0, F.size(odf))})
    xps = parts(_nothing(xps, " ", "[XPS]"), {"format": F.lit("XPS")})
    return route(f.suffix, {".rtf": rtf, (".odt", ".ods", ".odp"): odf, (".xps", ".oxps"): xps}, parts(_sized(f.format, f), {"format": f.format, "size": f.size}))


def _xml_strings(pattern: str, sep: str, format_: str) -> Parser:
    def run(f: File) -> Column:
        texts = F.filter(T.all_of(f.text, pattern), lambda t: t != "")
        return parts(_nothing(texts, sep, f"[{format_}]"), {"format": F.lit(format_), "strings": F.size(texts)})

    return run


def mail(f: File) -> Column:
    return T.let(M.mail_parts(f.text), lambda m: parts(m["body"], {"format": F.lit("EML"), "from": m["from"], "to": m["to"], "subject": m["subject"], "date": m["date"], "contentType": m["content_type"]}))


def configuration(f: File) -> Column:
    """TOML: the text as it is, and its sections; YAML: the text alone."""
    sections = lambda entries: F.array_join(F.filter(F.array_distinct(F.transform(entries, lambda e: e["section"])), lambda s: s != ""), ", ")
    toml = T.let(M.toml_entries(f.text), lambda entries: parts(f.text, {"format": F.lit("TOML"), "type": F.lit("object"), "sections": sections(entries), "entries": F.size(entries)}))
    return F.when(f.suffix == ".toml", toml).otherwise(parts(f.text, {"format": F.lit("YAML")}))


def database(f: File) -> Column:
    """SQLite, Parquet, Arrow and HDF5 by their headers; others by the strings in them."""
    be = lambda at, n: B.number(f.content, at, n)
    encoding = B.named(be(56, 4).cast("int"), B.SQLITE_ENCODINGS, F.lit("unknown"))
    sqlite = parts(_sized(F.lit("SQLite"), f), {"format": F.lit("SQLite"), "size": f.size, "pageSize": be(16, 2), "pageCount": be(28, 4), "textEncoding": encoding, "schemaVersion": be(40, 4)})
    valid = B.starts_with(f.content, "50415231") & (F.hex(F.substr(f.content, F.lit(-4))) == "50415231")
    columns = B.identifiers(T.text_of(F.when(f.size > 10_000, F.substr(f.content, F.lit(-10_000))).otherwise(f.content)))
    parquet = parts(_sized(F.lit("Apache Parquet"), f, _found(columns, "감지된 컬럼명:")), {"format": F.lit("Apache Parquet"), "size": f.size, "validMagic": valid, "footerLength": F.when(valid & (f.size >= 8), B.number(f.content, -8, 4, little=True)), "columns": F.when(F.size(columns) > 0, F.array_join(columns, ", "))})
    variant = F.when(B.starts_with(f.content, "4152524F5731"), "Arrow IPC").when(B.starts_with(f.content, "46454131"), "Feather v1").otherwise("Arrow/Feather")
    strings = _found(B.text_strings(f.content), STRINGS_FOUND)
    arrow = parts(_sized(variant, f, strings), {"format": F.lit("Apache Arrow/Feather"), "size": f.size, "variant": variant, "validMagic": variant != "Arrow/Feather"})
    magic = B.starts_with(f.content, "894844460D0A1A0A")
    hdf5 = parts(_sized(F.lit("HDF5"), f, strings), {"format": F.lit("HDF5"), "size": f.size, "validMagic": magic, "superblockVersion": F.when(magic, B.number(f.content, 8, 1))})
    other = parts(_sized(f.format, f, _found(B.text_strings(f.content, 20), STRINGS_FOUND)), {"format": f.format, "size": f.size})
    return route(f.suffix, {(".db", ".sqlite", ".sqlite3"): sqlite, ".parquet": parquet, (".arrow", ".feather"): arrow, (".h5", ".hdf5"): hdf5}, other)


def archive(f: File) -> Column:
    """gzip by its header and trailer; other archives by the names in them."""
    gz = B.starts_with(f.content, "1F8B")
    method, system = B.number(f.content, 2, 1), B.number(f.content, 9, 1)
    unknown = lambda c: F.concat(F.lit("Unknown("), c.cast("string"), F.lit(")"))
    size = F.when(gz, B.number(f.content, -4, 4, little=True))
    meta = {"format": f.format, "size": f.size, "isGzip": gz, "compressionMethod": F.when(gz, F.when(method == 8, "Deflate").otherwise(unknown(method))), "os": F.when(gz, B.named(system.cast("int"), B.GZIP_SYSTEMS, unknown(system))), "originalSize": size}
    names = B.archive_strings(f.content)
    other = parts(_sized(f.format, f, _found(names, NAMES_FOUND)), {"format": f.format, "size": f.size, "detectedFiles": F.when(F.size(names) > 0, F.array_join(names, ", "))})
    return F.when(gz, parts(_sized(f.format, f), meta)).otherwise(other)


def domain(f: File) -> Column:
    """DXF by its entities, DWG by its version, MessagePack by its first byte; others by size."""
    some = lambda c: F.when(F.size(c) > 0, F.size(c))

    def drawn(drawing):
        kinds = F.when(F.size(drawing["types"]) > 0, drawing["types"]).otherwise(M.dxf_types(f.text))
        listed = F.array_join(F.transform(M.counted(kinds), lambda c: F.concat(c["item"], F.lit("("), c["n"].cast("string"), F.lit(")"))), ", ")
        shown = F.concat(F.lit("[DXF]\n"), listed, F.when(F.size(drawing["texts"]) > 0, F.concat(F.lit("\n"), F.array_join(drawing["texts"], "\n"))).otherwise(""))
        return parts(shown, {"format": F.lit("DXF"), "version": drawing["version"], "layers": some(drawing["layers"]), "blocks": some(drawing["blocks"]), "entities": F.size(kinds), "texts": some(drawing["texts"])})

    dxf = T.let(M.dxf_drawing(f.text), drawn)
    code = B.latin1(F.substring(f.content, 1, 6))
    long = f.size >= 6
    dwg = parts(_sized(F.lit("DWG"), f), {"format": F.lit("DWG"), "versionCode": F.when(long, code), "version": F.when(long, B.named(code, B.DWG_RELEASES, F.lit("Unknown")))})
    msgpack = parts(_sized(F.lit("MessagePack"), f), {"format": F.lit("MessagePack"), "size": f.size, "type": msgpack_type(f.content)})
    return route(f.suffix, {".dxf": dxf, ".dwg": dwg, (".msgpack", ".msgpck"): msgpack}, parts(_sized(f.format, f), {"format": f.format, "size": f.size}))


def msgpack_type(content: Column) -> Column:
    """What the first byte says: fixmap(n), fixarray(n), array16, array32, map16, map32, or null."""
    b = B.number(content, 0, 1)
    sized = lambda name, base: F.concat(F.lit(f"{name}("), (b - base).cast("string"), F.lit(")"))
    out = F.when(b.between(0x80, 0x8F), sized("fixmap", 0x80)).when(b.between(0x90, 0x9F), sized("fixarray", 0x90))
    for byte, name in ((0xDC, "array16"), (0xDD, "array32"), (0xDE, "map16"), (0xDF, "map32")):
        out = out.when(b == byte, F.lit(name))
    return out


#: Parsers by name.
PARSERS: dict[str, Parser] = {
    "TextParser": delimited,
    "MarkdownParser": markdown,
    "SubtitleParser": subtitle,
    "PdfParser": pdf,
    "OfficeParser": office,
    "DocxParser": _xml_strings(r"<w:t[^>]*>([^<]*)</w:t>", " ", "DOCX"),
    "PptxParser": _xml_strings(r"<a:t>([^<]*)</a:t>", "\n", "PPTX"),
    "XlsxParser": _xml_strings(r"<t[^>]*>([^<]*)</t>", "\n", "XLSX"),
    "HwpParser": _xml_strings(r"<(?:hp:)?t>([^<]*)</(?:hp:)?t>", "\n", "HWPX"),
    "EbookParser": _xml_strings(r"<p[^>]*>([^<]+)</p>", "\n\n", "EPUB"),
    "EmailParser": mail,
    "YamlParser": configuration,
    "DatabaseParser": database,
    "ArchiveParser": archive,
    "DomainParser": domain,
}


def register_parser(name: str, parser: Parser, parsers: dict[str, Parser] | None = None) -> None:
    """Add a parser, or take another one for a name."""
    (PARSERS if parsers is None else parsers)[name] = parser


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``files`` (name, size, modified, content and what detect() adds) with a column result: format, category, text, metadata, tables, supported, error.

    A format that isn't supported or has no parser gives an empty text, supported = false and an error; a parser's failure gives an empty text and an error but stays supported. What a
    parser says about a file in its metadata (also "error") doesn't change that. fileName and fileSize are stamped on all but files without a parser, fileType and lastModified
    (UTC, to the millisecond) on those that were parsed. Null content counts as empty.
    """
    known = PARSERS if parsers is None else parsers
    f = File(F.col("name"), F.col("size"), F.coalesce("content", F.lit(b"")), F.col("format"))
    none = parts(F.lit(None))
    got = None
    for name, parser in known.items():
        hit = F.col("supported") & (F.col("parser_name") == name)
        got = F.when(hit, parser(f)) if got is None else got.when(hit, parser(f))
    out = files.withColumn("__parts", none if got is None else got.otherwise(none))
    has = F.coalesce(F.col("parser_name").isin(*known), F.lit(False))
    failure = F.col("__parts.failure")
    error = F.when(~F.col("supported"), F.concat("format", F.lit(UNSUPPORTED))).when(~has, F.concat(F.lit(NO_PARSER), "parser_name")).when(failure.isNotNull(), F.concat(F.lit(FAILED), failure))
    named = F.create_map(F.lit("fileName"), F.col("name"), F.lit("fileSize"), F.col("size").cast("string"))
    typed = F.create_map(F.lit("fileType"), F.coalesce("mime", F.lit("unknown")) if "mime" in files.columns else F.lit("unknown"), F.lit("lastModified"), T.iso_timestamp(F.col("modified")))
    stamp = F.map_concat(named, F.map_filter(typed, lambda k, v: v.isNotNull()))
    own = F.map_filter("__parts.metadata", lambda k, v: ~k.isin("fileName", "fileSize", "fileType", "lastModified"))
    metadata = F.when(~F.col("supported"), named).when(~has, F.create_map().cast("map<string,string>")).when(failure.isNotNull(), named).otherwise(F.map_concat(own, stamp))
    fine = F.col("supported") & has & failure.isNull()
    result = F.struct(
        "format",
        "category",
        F.when(fine, F.col("__parts.text")).otherwise("").alias("text"),
        metadata.alias("metadata"),
        F.when(fine, F.col("__parts.tables")).otherwise(F.array().cast(TABLES)).alias("tables"),
        (F.col("supported") & has).alias("supported"),
        error.alias("error"),
    )
    return out.withColumn("result", result).drop("__parts")
