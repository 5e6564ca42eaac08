"""Steps over tables of a container's entries (one row for each part of a file) and of tagged values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary as B
from ..functions import text as T
from . import markup as M

# Tags that are looked for in DICOM bytes (group, element, name).
DICOM_TAGS = [
    (0x0010, 0x0010, "PatientName"), (0x0010, 0x0020, "PatientID"), (0x0008, 0x0060, "Modality"), (0x0008, 0x0020, "StudyDate"),
    (0x0008, 0x1030, "StudyDescription"), (0x0028, 0x0010, "Rows"), (0x0028, 0x0011, "Columns"),
]

# Fields of DICOM files that results show, in this order, and names of transfer syntaxes.
DICOM_FIELDS = [
    ("PatientName", "환자명"), ("PatientID", "환자 ID"), ("PatientBirthDate", "생년월일"), ("PatientSex", "성별"), ("Modality", "모달리티"), ("Manufacturer", "제조사"), ("StudyDescription", "검사 설명"),
    ("SeriesDescription", "시리즈 설명"), ("StudyDate", "검사 날짜"), ("StudyTime", "검사 시간"), ("AccessionNumber", "접수 번호"), ("InstitutionName", "기관명"), ("ReferringPhysicianName", "의뢰의"),
    ("ProtocolName", "프로토콜"), ("InstanceNumber", "인스턴스 번호"), ("Rows", "행 수"), ("Columns", "열 수"), ("PixelSpacing", "픽셀 간격"), ("BitsAllocated", "비트 할당"), ("BitsStored", "비트 저장"),
    ("PhotometricInterpretation", "포토메트릭"), ("SamplesPerPixel", "샘플/픽셀"), ("SliceThickness", "슬라이스 두께"), ("KVP", "kVp"), ("Exposure", "노출량"),
]
TRANSFER_SYNTAXES = {
    "1.2.840.10008.1.2": "Implicit VR Little Endian", "1.2.840.10008.1.2.1": "Explicit VR Little Endian", "1.2.840.10008.1.2.2": "Explicit VR Big Endian", "1.2.840.10008.1.2.4.50": "JPEG Baseline",
    "1.2.840.10008.1.2.4.70": "JPEG Lossless", "1.2.840.10008.1.2.4.90": "JPEG 2000 Lossless", "1.2.840.10008.1.2.4.91": "JPEG 2000",
}


def dicom_dimension(spark: SparkSession) -> DataFrame:
    """(key, label, pos) of the fields, for fields_in_order()."""
    return spark.createDataFrame([(k, label, pos) for pos, (k, label) in enumerate(DICOM_FIELDS)], "key string, label string, pos int")


def joined_parts(entries: DataFrame, by: str, pattern: str, text, sep: str = "\n\n", number: bool = True) -> DataFrame:
    """Texts of the entries whose whole name fits ``pattern``, joined in the order of the number in their name (or of the names): ``by``, parts, text.

    ``text`` maps the column xml to a string; blank ones and their entries go.  Of names that aren't unique all count, in the order of their texts.
    """
    own = entries.where(F.col("name").rlike(f"^(?:{pattern})$")).withColumn("__t", text(F.col("xml"))).where("trim(__t) != ''")
    nth = F.regexp_extract("name", r"(\d+)\D*$", 1).cast("long") if number else F.lit(0)
    got = own.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(nth.alias("nth"), "name", "__t"))).alias("l"))
    return got.select(by, F.size("l").alias("parts"), F.array_join(F.transform("l", lambda x: x["__t"]), sep).alias("text"))


def epub_books(entries: DataFrame, by: str) -> DataFrame:
    """Books from their entries (``by``, name, xml): title, creator, publisher, chapters, characters, words and text.

    The container names the package (OEBPS/content.opf by default); its spine refers to items of the manifest, whose HTML parts are the chapters in the spine's order. References without an item or
    a part go, repeated ones repeat, of items with one id the last counts. A book without any such chapter is read from all its HTML parts in the order of their names. Books without entries
    of a package have null fields.
    """
    attribute = lambda tag, name: F.nullif(F.regexp_extract(tag, rf'\b{name}="([^"]+)"', 1), F.lit(""))
    container = entries.where("name = 'META-INF/container.xml'").groupBy(by).agg(F.max(attribute(F.col("xml"), "full-path")).alias("opf"))
    books = entries.select(by).distinct().join(container, by, "left").select(by, F.coalesce("opf", F.lit("OEBPS/content.opf")).alias("name"))
    package = books.join(entries, [by, "name"]).select(by, folder_of(F.col("name")).alias("dir"), "xml")
    item = package.select(by, "dir", F.posexplode(F.regexp_extract_all("xml", F.lit(r"<item\b[^>]*>"), F.lit(0))).alias("pos", "tag"))
    item = item.select(by, attribute(F.col("tag"), "id").alias("id"), "pos", F.concat("dir", attribute(F.col("tag"), "href")).alias("name"), attribute(F.col("tag"), "media-type").alias("media")).where("id is not null and name is not null")
    item = item.groupBy(by, "id").agg(F.max_by(F.struct("name", "media"), "pos").alias("i")).where("i.media like '%html%'").select(by, "id", "i.name")
    spine = package.select(by, F.posexplode(F.regexp_extract_all("xml", F.lit(r"<itemref\b[^>]*>"), F.lit(0))).alias("pos", "tag")).select(by, "pos", attribute(F.col("tag"), "idref").alias("id"))
    chapter = spine.join(item, [by, "id"]).join(entries, [by, "name"]).select(by, "pos", F.lit("").alias("name"), T.strip_html(F.col("xml")).alias("t")).where("t != ''")
    other = entries.where(F.col("name").rlike(r"(?i)\.(x?html?|htm)$")).join(chapter.select(by).distinct(), by, "left_anti")
    other = other.select(by, F.lit(0).alias("pos"), "name", M.mail_text(F.col("xml")).alias("t")).where("t != ''")
    told = chapter.union(other).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "t"))).alias("l"))
    field = lambda name: T.dublin_core(F.col("xml"), name).alias(name)
    text = F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), "\n\n"), F.lit(""))
    out = books.select(by).join(package.select(by, field("title"), field("creator"), field("publisher")), by, "left").join(told, by, "left")
    return out.select(by, "title", "creator", "publisher", F.coalesce(F.size("l"), F.lit(0)).alias("chapters"), F.length(text).alias("characters"), F.regexp_count(text, F.lit(r"\S+")).alias("words"), text.alias("text"))


def folder_of(path: Column) -> Column:
    """A path up to its last slash, or nothing."""
    return F.regexp_extract(path, "^(.*/)", 1)


def fields_in_order(values: DataFrame, dimension: DataFrame, by: str) -> DataFrame:
    """Values (``by``, key, value) that a dimension (key, label, pos) knows and that aren't empty: ``by``, fields, an array of "label: value" in the dimension's order, values trimmed.

    The dimension is broadcast by Spark if it is small.
    """
    known = values.withColumn("value", T.trim_all(F.col("value"))).where("value is not null and value != ''").join(dimension, "key")
    got = known.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("label", F.lit(": "), "value").alias("f")))).alias("l"))
    return got.select(by, F.transform("l", lambda x: x["f"]).alias("fields"))


def dicom_scan(files: DataFrame, by: str, content: str = "content", window: int = 5000) -> DataFrame:
    """Tags found by looking at every second place from 132 on in the first bytes: ``by``, at, name, value (text of fewer than 200 bytes, in explicit form)."""
    spark = files.sparkSession
    tags = spark.createDataFrame(DICOM_TAGS, "grp long, elem long, name string")
    c = F.substring(content, 1, window)
    places = files.where(F.octet_length(content) > 140).select(by, c.alias("c"), F.explode(F.expr(f"sequence(132, least({window}, octet_length({content})) - 8, 2)")).alias("at"))
    u16 = lambda off: F.conv(F.concat(F.hex(F.substr("c", F.col("at") + (off + 2), F.lit(1))), F.hex(F.substr("c", F.col("at") + (off + 1), F.lit(1)))), 16, 10).cast("long")
    found = places.select(by, "c", "at", u16(0).alias("grp"), u16(2).alias("elem"), u16(6).alias("n")).join(F.broadcast(tags), ["grp", "elem"])
    value = B.latin1(F.substr("c", F.col("at") + 9, F.col("n").cast("int")))
    return found.where("n > 0 and n < 200").select(by, F.col("at").cast("long").alias("at"), "name", F.rtrim(F.replace(value, F.lit("\0"), F.lit(""))).alias("value"))


def parties(recipients: Column, kind: str) -> Column:
    """Addresses of the recipients (type, address) of a kind, joined."""
    return F.array_join(F.transform(F.filter(recipients, lambda r: r["type"] == kind), lambda r: r["address"]), ", ")


def texts_of(entities: Column, kinds: tuple[str, ...] = ("TEXT", "MTEXT")) -> Column:
    """Texts that aren't empty, of the entities (type, text) of some types."""
    return F.transform(F.filter(entities, lambda e: e["type"].isin(*kinds) & (e["text"] != "")), lambda e: e["text"])


def user_blocks(names: Column) -> Column:
    """Block names without those of the system, which begin with a star."""
    return F.filter(names, lambda n: ~F.startswith(n, F.lit("*")))


def with_note(items: Column, most: int, total: Column | None = None) -> Column:
    """The first items, a line each, and how many more there are (of ``total``, by default those of the array)."""
    more = (F.size(items) if total is None else total) - most
    shown = F.array_join(F.slice(items, 1, most), "\n")
    return F.when(more > 0, F.concat(shown, F.lit("\n... +"), more.cast("string"))).otherwise(shown)
