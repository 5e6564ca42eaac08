"""The formats that are known, and how a file's format is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Id, name, suffixes, MIME types, category, parser, difficulty.
FORMATS = [
    (1, "PDF", [".pdf"], ["application/pdf"], "문서", "PdfParser", "중"),
    (7, "PDF 폼 데이터", [".fdf", ".xfdf"], [], "문서", "PdfParser", "중"),
    (8, "Word", [".docx", ".doc"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword"], "문서", "DocxParser", "하"),
    (9, "PowerPoint", [".pptx", ".ppt"], ["application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.ms-powerpoint"], "문서", "PptxParser", "중"),
    (10, "Excel", [".xlsx", ".xls"], ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"], "문서", "XlsxParser", "중"),
    (11, "한글 (HWP)", [".hwp"], ["application/x-hwp"], "문서", "HwpParser", "상"),
    (12, "한글 (HWPX)", [".hwpx"], ["application/hwp+zip"], "문서", "HwpParser", "중"),
    (13, "OpenDocument", [".odt", ".ods", ".odp"], ["application/vnd.oasis.opendocument.text"], "문서", "OfficeParser", "하"),
    (14, "Apple iWork", [".pages", ".numbers", ".key"], [], "문서", "OfficeParser", "중"),
    (15, "WPS Office", [".wps", ".et", ".dps"], [], "문서", "OfficeParser", "중"),
    (16, "RTF", [".rtf"], ["application/rtf"], "문서", "OfficeParser", "하"),
    (17, "XPS", [".xps", ".oxps"], ["application/oxps"], "문서", "OfficeParser", "중"),
    (18, "OneNote", [".one", ".onepkg"], [], "문서", "OfficeParser", "상"),
    (23, "YAML", [".yaml", ".yml"], ["text/yaml"], "웹/마크업", "YamlParser", "하"),
    (24, "TOML", [".toml"], ["text/toml"], "웹/마크업", "YamlParser", "하"),
    (26, "이메일 (EML)", [".eml"], ["message/rfc822"], "웹/마크업", "EmailParser", "중"),
    (27, "Outlook (MSG)", [".msg"], ["application/vnd.ms-outlook"], "웹/마크업", "EmailParser", "중"),
    (35, "HEIC/HEIF", [".heic", ".heif"], ["image/heic"], "이미지/스캔", "ImageParser", "상"),
    (38, "DJVU", [".djvu"], ["image/vnd.djvu"], "이미지/스캔", "ImageParser", "상"),
    (39, "DICOM", [".dcm"], ["application/dicom"], "이미지/스캔", "ImageParser", "상"),
    (40, "CAD/도면", [".dwg", ".dxf"], [], "이미지/스캔", "DomainParser", "최상"),
    (41, "EPUB", [".epub"], ["application/epub+zip"], "전자책/출판", "EbookParser", "중"),
    (42, "MOBI/AZW", [".mobi", ".azw3", ".azw"], [], "전자책/출판", "EbookParser", "중"),
    (44, "MP3", [".mp3"], ["audio/mpeg"], "오디오/비디오", "AudioParser", "중"),
    (45, "WAV", [".wav"], ["audio/wav"], "오디오/비디오", "AudioParser", "중"),
    (46, "M4A/AAC", [".m4a", ".aac"], ["audio/mp4", "audio/aac"], "오디오/비디오", "AudioParser", "중"),
    (47, "OGG", [".ogg"], ["audio/ogg"], "오디오/비디오", "AudioParser", "중"),
    (110, "FLAC", [".flac"], ["audio/flac"], "오디오/비디오", "AudioParser", "중"),
    (48, "MP4", [".mp4"], ["video/mp4"], "오디오/비디오", "VideoParser", "중"),
    (49, "WebM/MKV", [".webm", ".mkv"], ["video/webm", "video/x-matroska"], "오디오/비디오", "VideoParser", "중"),
    (50, "SRT 자막", [".srt"], ["text/srt"], "오디오/비디오", "SubtitleParser", "하"),
    (51, "VTT 자막", [".vtt"], ["text/vtt"], "오디오/비디오", "SubtitleParser", "하"),
    (52, "ASS/SSA 자막", [".ass", ".ssa"], [], "오디오/비디오", "SubtitleParser", "하"),
    (59, "Markdown", [".md", ".markdown"], ["text/markdown"], "코드/기술문서", "MarkdownParser", "하"),
    (64, "Protocol Buffers", [".proto"], [], "코드/기술문서", "DomainParser", "중"),
    (71, "CSV", [".csv"], ["text/csv"], "구조화 데이터", "TextParser", "하"),
    (72, "TSV", [".tsv"], ["text/tab-separated-values"], "구조화 데이터", "TextParser", "하"),
    (73, "Parquet", [".parquet"], [], "구조화 데이터", "DatabaseParser", "하"),
    (74, "Arrow/Feather", [".arrow", ".feather"], [], "구조화 데이터", "DatabaseParser", "하"),
    (75, "Avro", [".avro"], [], "구조화 데이터", "DatabaseParser", "중"),
    (77, "HDF5", [".h5", ".hdf5"], [], "구조화 데이터", "DatabaseParser", "중"),
    (78, "SQLite", [".db", ".sqlite", ".sqlite3"], [], "구조화 데이터", "DatabaseParser", "중"),
    (80, "Pickle", [".pkl", ".pickle"], [], "구조화 데이터", "DatabaseParser", "중"),
    (95, "ZIP", [".zip"], ["application/zip"], "복합/압축", "ArchiveParser", "중"),
    (96, "7z", [".7z"], ["application/x-7z-compressed"], "복합/압축", "ArchiveParser", "중"),
    (97, "RAR", [".rar"], ["application/vnd.rar"], "복합/압축", "ArchiveParser", "중"),
    (98, "tar.gz", [".tar.gz", ".tgz", ".tar.bz2", ".tar"], ["application/gzip", "application/x-tar"], "복합/압축", "ArchiveParser", "중"),
    (99, "ISO", [".iso"], [], "복합/압축", "ArchiveParser", "중"),
    (106, "Shapefile", [".shp", ".dbf"], [], "도메인 특수", "DomainParser", "중"),
    (109, "MessagePack", [".msgpack", ".msgpck"], [], "도메인 특수", "DomainParser", "중"),
]
# Leading bytes in hexadecimal, in the order they are tried, and the suffix whose format they mean.
SIGNATURES = [
    ("25504446", ".pdf"),
    ("504B0304", ".zip"),
    ("504B0506", ".zip"),
    ("52494646", ".wav"),
    ("4F676753", ".ogg"),
    ("664C6143", ".flac"),
    ("FFFB", ".mp3"),
    ("494433", ".mp3"),
    ("D0CF11E0", ".doc"),
    ("52617221", ".rar"),
    ("377ABCAF", ".7z"),
    ("1F8B", ".tar.gz"),
    ("4F626A01", ".avro"),
    ("89484446", ".hdf5"),
    ("50415231", ".parquet"),
    ("53514C69746520666F726D61742033", ".sqlite"),
]


_SCHEMA = "id int, name string, extensions array<string>, mimes array<string>, category string, parser_name string, difficulty string, supported boolean, pos int"


def formats(spark: SparkSession) -> DataFrame:
    """One row per format: id, name, extensions, mimes, category, parser_name, difficulty, supported, pos."""
    return spark.createDataFrame([(*f, True, pos) for pos, f in enumerate(FORMATS)], _SCHEMA)


def register(known: DataFrame, id: int, name: str, extensions: list[str], mimes: list[str], category: str, parser_name: str, difficulty: str = "중", supported: bool = True) -> DataFrame:  # noqa: A002
    """The registry with one more format, after all others: of suffixes and MIME types that stand twice the last registered counts."""
    last = known.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    return known.unionByName(known.sparkSession.createDataFrame([(id, name, extensions, mimes, category, parser_name, difficulty, supported, last + 1)], _SCHEMA))


def by_id(known: DataFrame, id: int) -> DataFrame:  # noqa: A002
    return known.where(F.col("id") == id)


def by_category(known: DataFrame, category: str) -> DataFrame:
    return known.where(F.col("category") == category)


def categories(known: DataFrame) -> DataFrame:
    """category, formats, supported, place: categories in the order in which they were registered first (place from 1)."""
    got = known.groupBy("category").agg(F.count("*").alias("formats"), F.count_if("supported").alias("supported"), F.min("pos").alias("first"))
    return got.withColumn("place", F.row_number().over(Window.orderBy("first"))).drop("first")  # as many rows as there are categories


def by_key(formats_: DataFrame, key: str) -> DataFrame:
    """(key, id): suffixes in lower case or MIME types as they are; of repeated keys the last format's counts."""
    one = F.lower("k") if key == "extensions" else F.col("k")
    return formats_.select(F.explode(key).alias("k"), "id", "pos").groupBy(one.alias("key")).agg(F.max_by("id", "pos").alias("id"))


def magic_suffix(head: Column) -> Column:
    """The suffix that the leading bytes stand for, null if none does."""
    code, out = F.hex(F.substring(head, 1, 16)), None
    for signature, suffix in SIGNATURES:
        hit = F.startswith(code, F.lit(signature))
        out = F.when(hit, F.lit(suffix)) if out is None else out.when(hit, F.lit(suffix))
    return out


def likely_text(head: Column) -> Column:
    """No control byte other than tab to carriage return; true for no bytes."""
    return ~F.hex(F.substring(head, 1, 16)).rlike("^(?:..)*?(?:0[0-8EF]|1[0-9A-F]|7F)")


def sniffed_suffix(head: Column) -> Column:
    t = T.trim_all(T.text_of(F.substring(head, 1, 1024)))
    found = F.when(F.startswith(t, F.lit("---")), F.lit(".yaml")).when(F.startswith(t, F.lit("#")) | F.contains(t, F.lit("\n## ")), F.lit(".md"))
    return F.when(likely_text(head), found)


def detect(files: DataFrame, name: str = "name", content: str | None = "content", mime: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """``files`` with format_id, format, category, parser_name, supported and detected_by (extension, magic, mime, text or unknown), the first that hits.

    The registry is ``known`` (by default that of formats()), small and broadcast. Bytes are looked at only where the suffix says nothing, and no bytes are read at all without ``content``. Null names,
    contents and MIME types hit nothing but the text stage, which takes no bytes for text. Columns of ``files`` that have the names of the new ones are replaced.
    """
    known = formats(files.sparkSession) if known is None else known
    added = ["format_id", "format", "category", "parser_name", "supported", "detected_by"]
    ext, mimes = by_key(known, "extensions"), by_key(known, "mimes")

    def step(table: DataFrame, key: Column, to: str):
        nonlocal out
        hits = F.broadcast(table.select(F.col("key").alias("__key"), F.col("id").alias(to)))
        out = out.withColumn("__have", key).join(hits, F.col("__have") == F.col("__key"), "left").drop("__have", "__key")

    out = files.drop(*[c for c in added if c in files.columns and c != mime])
    step(ext, T.detector_suffix(F.col(name)), "__e")
    head = F.when(F.col("__e").isNull(), F.substring(F.coalesce(F.col(content), F.lit(b"")), 1, 1024)) if content else F.lit(None).cast("binary")
    out = out.withColumn("__head", head)
    step(ext, magic_suffix(F.col("__head")), "__g")
    step(mimes, F.col(mime) if mime else F.lit(None).cast("string"), "__m")
    step(ext, sniffed_suffix(F.col("__head")), "__t")
    by = F.when(F.col("__e").isNotNull(), "extension").when(F.col("__g").isNotNull(), "magic").when(F.col("__m").isNotNull(), "mime").when(F.col("__t").isNotNull(), "text").otherwise("unknown")
    out = out.withColumns({"format_id": F.coalesce("__e", "__g", "__m", "__t", F.lit(0)), "detected_by": by}).drop("__e", "__g", "__m", "__t", "__head")
    info = known.select(F.col("id").alias("format_id"), F.col("name").alias("format"), "category", "parser_name", "supported").dropDuplicates(["format_id"])
    out = out.join(F.broadcast(info), "format_id", "left")
    return out.withColumns({"format": F.coalesce("format", F.lit("Unknown")), "category": F.coalesce("category", F.lit("기타")), "supported": F.coalesce("supported", F.lit(False))})
