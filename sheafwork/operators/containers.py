"""Binary containers as rows: records, archive headers, boxes, blocks, sectors and tagged strings, found where the bytes say that they are.

What one record says of the next is a link; links and walks are chains.Chain. Only places that can begin a record are rows, found by a signature where the format has one. No decoder stands
behind this: fields are column expressions over the bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import binary as B
from ..functions import text as T
from ..sources.shared import joined, written
from .chains import Chain, places

# Boxes that hold boxes; of meta the boxes begin after four more bytes.
BOXES = ("moov", "trak", "mdia", "minf", "stbl", "dinf", "edts", "udta", "mvex", "moof", "traf", "mfra", "iprp", "ipco", "meta")
#: The first number that is no sector.
NO_SECTOR = 0xFFFFFFFA


def _named(files: DataFrame, key: str, content: str) -> DataFrame:
    return files.select(F.col(key).alias("file"), F.col(content).alias("content"))


def _starts(links: DataFrame, at: Column | int) -> DataFrame:
    return links.select("file").distinct().withColumn("start", F.lit(at).cast("long") if isinstance(at, int) else at)


def shape_records(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, nth, at, bytes): the records of a shape file with their places and how many bytes follow each head.

    Records have any lengths; the walk ends where no head fits before the end, and where a length leads back to a record that was there before. Files without the code 9994 have no records.
    """
    f = _named(files, key, content).where(B.number_at(F.col("content"), F.lit(0), 4) == 9994)
    c, at = F.col("content"), F.col("at")
    links = places(f, "file", "content", start=100, step=2).where(at + 8 < F.octet_length(c)).select("file", "at", (B.number_at(c, at + 4, 4, signed=True) * 2).alias("bytes"))
    links = written(links.withColumn("next", at + 8 + F.col("bytes")), "shapes")
    chain = Chain(links)
    seen = chain.walk(_starts(links, 100))
    return joined(seen, links.drop("next"), ["file", "at"]).select(F.col("file").alias(key), "nth", "at", "bytes")


def zip_entries(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, nth, at, name, size, packed, encrypted): entries of archives by their local heads, from the first byte on, up to the first place that has no head.

    Signatures inside stored data are no entries, as the walk doesn't come there.
    """
    f = _named(files, key, content)
    c, at = F.col("content"), F.col("at")
    n = lambda o, size: B.number_at(c, at + o, size, little=True)
    heads = places(f, "file", "content", "504B0304").where(at < F.octet_length(c) - 4)
    heads = heads.select("file", "at", n(6, 2).alias("flags"), n(18, 4).alias("packed"), n(22, 4).alias("size"), n(26, 2).alias("names"), n(28, 2).alias("extra"), T.text_of(F.substr(c, (at + 31).cast("int"), n(26, 2).cast("int"))).alias("name"))
    heads = written(heads.withColumn("next", at + 30 + F.col("names") + F.col("extra") + F.col("packed")), "heads")
    seen = Chain(heads).walk(_starts(heads, 0))
    return joined(seen, heads, ["file", "at"]).select(F.col("file").alias(key), "nth", "at", "name", "size", "packed", (F.col("flags") % 2 == 1).alias("encrypted"))


def archive_reports(entries: DataFrame, key: str, most: int = 50, largest: str = "GB") -> DataFrame:
    """(key, files, encrypted, bytes, listing, note): what a listing says of each archive's entries: how many there are and how many of them encrypted, the first ones line by line, in order, and how many more.

    Lines of each archive are limited before they are gathered. Sizes have no unit above ``largest``.
    """
    mark = F.when(F.col("encrypted"), F.lit(" [암호화]")).otherwise("")
    line = F.concat("name", mark, F.lit(" ("), T.file_size_label(F.col("size"), largest), F.lit(")"))
    totals = entries.groupBy(key).agg(F.count("*").alias("files"), F.count_if("encrypted").alias("encrypted"), F.sum("size").alias("bytes"))
    first = entries.where(F.col("nth") < most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))).alias("l"))
    out = joined(totals, first, [key]).withColumn("listing", F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return out.select(key, "files", "encrypted", "bytes", "listing", F.when(F.col("files") > most, F.concat(F.lit("... 외 "), (F.col("files") - most).cast("string"), F.lit("개"))).alias("note"))


def tar_entries(files: DataFrame, key: str, content: str, most: int = 100) -> DataFrame:
    """(key, nth, at, name, size): entries of tar archives, so many at most as a listing has; the walk ends at a block of zeros or a blank name. Sizes are octal."""
    f = _named(files, key, content)
    c, at = F.col("content"), F.col("at")
    clean = lambda o, size: T.trim_all(F.replace(T.text_of(F.substr(c, (at + o + 1).cast("int"), F.lit(size))), F.lit("\0"), F.lit("")))
    size = F.coalesce(F.conv(F.nullif(F.regexp_extract(clean(124, 12), "^([0-7]+)", 1), F.lit("")), 8, 10).cast("long"), F.lit(0))
    heads = places(f, "file", "content", step=512).where(at + 512 <= F.octet_length(c)).select("file", "at", clean(0, 100).alias("name"), size.alias("size")).where("name <> ''")
    heads = written(heads.withColumn("next", at + 512 + F.ceil(F.col("size") / 512) * 512), "heads")
    seen = Chain(heads).walk(_starts(heads, 0)).where(F.col("nth") < most)
    return joined(seen, heads, ["file", "at"]).select(F.col("file").alias(key), "nth", "at", "name", "size")


def _walked(files: DataFrame, walk, fields: dict) -> DataFrame:
    """Rows (file, …) that ``walk`` finds in the bytes of each file (file, content), one after the other; ``fields``: their names and Spark's types.

    A file is a value: its walk needs no more memory than the value, and files spread over the tasks without a shuffle. Rows go out some at a time.
    """
    arrow = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    kinds, names, some = [arrow[t] for t in fields.values()], ["file", *fields], 1 << 14

    def run(batches):
        for batch in batches:
            keys, at, found = batch.column(0), [], []

            def out():
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *[pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]], names)

            for i, c in enumerate(batch.column(1)):
                for row in walk(c.as_py() or b""):
                    at.append(i)
                    found.append(row)
                    if len(found) == some:
                        yield out()
                        at, found = [], []
            if found:
                yield out()

    return files.select("file", "content").mapInArrow(run, StructType([StructField("file", files.schema["file"].dataType), *[StructField(n, {"int": IntegerType(), "long": LongType()}.get(t) or (StringType() if t == "string" else BinaryType())) for n, t in fields.items()]]))


def _box_walk(inner: tuple[str, ...]):
    """Boxes (path, at, size, level, width, height) of a file's bytes."""
    letters = bytes([*range(0x20, 0x7F), 0xA9])

    def walk(c: bytes):
        todo = [(0, len(c), "", 0)]
        while todo:
            at, end, above, level = todo.pop()
            while at < end and at + 8 <= len(c) and not c[at + 4 : at + 8].strip(letters):
                size, head = int.from_bytes(c[at : at + 4], "big"), 8
                if size == 1:
                    size, head = int.from_bytes(c[at + 8 : at + 16], "big", signed=True) if at + 16 <= len(c) else 0, 16
                elif size == 0:
                    size = len(c) - at
                if size < head or at + size > end:
                    break
                kind = c[at + 4 : at + 8].decode("latin-1")
                path, sides = f"{above}/{kind}", [None, None]
                if kind == "ispe":
                    sides = [int.from_bytes(x, "big") if len(x) == 4 else None for x in (c[at + head + 4 : at + head + 8], c[at + head + 8 : at + head + 12])]
                yield path, at, size, level, *sides
                if kind in inner:
                    todo.append((at + head + (4 if kind == "meta" else 0), at + size, path, level + 1))
                at += size

    return walk


def boxes(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, path, at, size, level, width, height): the boxes of ISO media files, however deep they are; width and height of ``ispe`` boxes.

    A box lies within the one that holds it: one that doesn't fit ends the walk there. Sizes of 64 bits, and size 0 for all that is left of the file, are known.
    """
    found = _walked(_named(files, key, content), _box_walk(BOXES), {"path": "string", "at": "long", "size": "long", "level": "int", "width": "long", "height": "long"})
    return found.withColumnRenamed("file", key)


def _avro_sync(c: Column) -> Column:
    """(at, sync): where the first block of an Avro file begins, and the 16 bytes that end each; null without a whole head.

    The head is a map: counts, then so many keys and values, until a count of 0. All steps of it are taken in a row's own fold, as many as the first count asks for and two more.
    """
    first = B.varint(c, F.lit(4).cast("long"))["value"]
    state = "struct<at:bigint,left:bigint,done:boolean>"

    def step(s, _):
        def entry(one):
            opened = F.struct(F.when(one["value"] < 0, B.varint(c, one["next"])["next"]).otherwise(one["next"]).alias("at"), F.abs(one["value"]).alias("left"), (one["value"] == 0).alias("done")).cast(state)
            passed = T.let(B.varint(c, one["next"] + one["value"]), lambda two: F.struct((two["next"] + two["value"]).alias("at"), (s["left"] - 1).alias("left"), F.lit(False).alias("done")).cast(state))
            return F.when(s["left"] == 0, opened).otherwise(passed)

        return F.when(s["done"], s).otherwise(T.let(B.varint(c, s["at"]), entry))

    steps = F.sequence(F.lit(1).cast("long"), F.least(F.abs(first) + 2, F.octet_length(c).cast("long")))
    end = F.aggregate(steps, F.struct(F.lit(4).cast("long").alias("at"), F.lit(0).cast("long").alias("left"), F.lit(False).alias("done")).cast(state), step)
    return F.transform(F.array(end), lambda e: F.when(e["done"] & (e["at"] + 16 <= F.octet_length(c)), F.struct((e["at"] + 16).alias("at"), F.substr(c, (e["at"] + 1).cast("int"), F.lit(16)).alias("sync"))))[0]


def avro_blocks(files: DataFrame, key: str, content: str, ranged: int = 1 << 20) -> DataFrame:
    """(key, nth, at, records, bytes): the blocks of Avro files, where each begins, with their counts and sizes.

    A file is searched for its marker in ranges, each a row of its own that reaches as far into the next as a marker at the border, a count and a size need, so that ranges may go to different tasks.
    Blocks begin after markers; which markers are no data is told by the walk from the first block on. A block that isn't whole, or has no records or bytes, ends the walk.
    """
    f = _named(files, key, content).where(B.starts_with(F.col("content"), "4F626A01")).withColumn("head", _avro_sync(F.col("content"))).where("head is not null")
    whole, more = F.octet_length("content").cast("long"), 16 + 20
    ranges = f.select("file", "content", "head", whole.alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), whole - 1, F.lit(ranged).cast("long"))).alias("from"))
    ranges = ranges.select("file", "head", "whole", "from", F.substr("content", (F.col("from") + 1).cast("int"), F.lit(ranged + more)).alias("part")).repartition("file", "from")
    within = F.transform(F.array("part"), lambda p: F.filter(F.sequence(F.lit(0), F.least(F.lit(ranged), F.octet_length(p)) - 1), lambda i: F.substr(p, i + 1, F.lit(16)) == F.col("head.sync")))
    marks = ranges.select("file", "head", "whole", "from", "part", F.explode(F.flatten(within)).alias("i"))
    count = marks.withColumn("n", B.varint(F.col("part"), F.col("i").cast("long") + 16)).withColumn("s", B.varint(F.col("part"), F.col("n.next")))
    blocks = count.select("file", "head", "whole", (F.col("from") + F.col("i") + 16).alias("at"), F.col("n.value").alias("records"), F.col("s.value").alias("bytes"), (F.col("from") + F.col("s.next")).alias("data"))
    good = (F.col("at") < F.col("whole") - 16) & (F.col("records") > 0) & (F.col("bytes") > 0) & (F.col("data") + F.col("bytes") <= F.col("whole"))
    blocks = written(blocks.where(good).withColumn("next", F.col("data") + F.col("bytes") + 16), "blocks")
    seen = Chain(blocks).walk(blocks.groupBy("file").agg(F.min("head.at").alias("start")))
    return joined(seen, blocks, ["file", "at"]).select(F.col("file").alias(key), "nth", "at", "records", "bytes")


def _string_walk(most: int):
    """Strings (nth, text) of a pickled object's bytes by their opcodes."""
    code, control = re.compile(rb"[\x8c\x55\x58]"), re.compile(r"[\x00-\x1f\x7f]")

    def walk(c: bytes):
        at = nth = 0
        while nth < most and (m := code.search(c, at)):
            at = m.start()
            head = 5 if c[at] == 0x58 else 2
            begin, n = at + head, int.from_bytes(c[at + 1 : at + head], "little")
            if begin > len(c) or begin + n > len(c) or (head == 5 and not 0 < n < 10_000):
                at += 1
                continue
            at = begin + n
            try:
                text = c[begin:at].decode()
            except UnicodeDecodeError:
                continue
            if len(text.encode("utf-16-le")) > 2 and not (head == 2 and control.search(text)):
                yield nth, text
                nth += 1

    return walk


def pickled_strings(files: DataFrame, key: str, content: str, most: int = 50) -> DataFrame:
    """(key, nth, text): strings of pickled objects by their opcodes, in order, so many at most as a preview has.

    An opcode with a length of one byte (8C, 55) or of four (58, below 10,000) whose string fits takes it whole, so what looks like an opcode inside it isn't one. Strings of one character, those that
    aren't UTF-8, and short ones with control characters don't count, but hide what is in them all the same.
    """
    found = _walked(_named(files, key, content), _string_walk(most), {"nth": "long", "text": "string"})
    return found.withColumnRenamed("file", key)


def _chain(table: list[int], at: int) -> list[int]:
    """Sectors from one on by their table, up to one that it says nothing of or that was there before."""
    seen: dict[int, None] = {}
    while at < len(table) and table[at] != 0xFFFFFFFF and at not in seen:
        seen[at] = None
        at = table[at]
    return list(seen)


def _chains_of(table: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([[_chain(t, int(s)) for s in begin] for t, begin in ((np.frombuffer(x, "<u4").tolist(), y) for x, y in zip(table, starts, strict=True))], dtype=object)


#: Chains by a table and the sectors they begin with. As it isn't deterministic to Spark, it stays a column of its own and never moves into a lambda that names it.
_chains = F.pandas_udf(_chains_of, ArrayType(ArrayType(LongType()))).asNondeterministic()


def _computed(f: DataFrame, **columns: Column) -> DataFrame:
    """Further columns, computed in a step of their own: Spark can't take a Python function of a column whose lambdas it has moved into the function's arguments."""
    return f.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


class Compound:
    """A file system of sectors in a file (compound files of old office documents): its table of sectors, directory and streams.

    A file is a value, and its table of sectors is a small part of it (four bytes a sector), so chains are followed where the value is: no sector is shuffled, and only tables go to Python. Values
    that lambdas look into are bound first, as each look at a column would copy it.
    """

    def __init__(self, files: DataFrame, key: str, content: str):
        self.key = key
        f = _named(files, key, content).where(B.starts_with(F.col("content"), "D0CF11E0A1B11AE1"))
        n = lambda at, size: B.number_at(F.col("content"), F.lit(at), size, little=True)
        f = f.withColumns({"size": F.call_function("shiftleft", F.lit(1).cast("long"), n(30, 2).cast("int")), "mini": F.call_function("shiftleft", F.lit(1).cast("long"), n(32, 2).cast("int")), "dir": n(48, 4), "cutoff": n(56, 4), "minifat": n(60, 4), "more": n(68, 4)})
        f = f.where(n(30, 2).between(7, 16) & n(32, 2).between(2, 16) & F.col("more").isNotNull())
        # The table's own sectors: 109 named in the head, further ones in a chain of sectors that end with the number of the next.
        size, c = F.col("size"), F.col("content")
        nexts = T.let(c, lambda b: F.array_join(F.transform(_upto(F.floor(F.octet_length(b) / size) - 1), lambda i: F.hex(F.substr(b, ((i + 2) * size - 3).cast("int"), F.lit(4)))), ""))
        f = _computed(f, nexts=F.unhex(F.when(F.col("more") < NO_SECTOR, nexts).otherwise("")))
        f = f.withColumn("further", F.get(_chains("nexts", F.array("more")), F.lit(0))).drop("nexts", "more")
        numbers = lambda x, m: F.transform(_upto(m), lambda i: B.number_at(x, i * 4, 4, little=True))
        more = T.let(c, lambda b: F.flatten(F.transform("further", lambda s: T.let(self._sector(b, s), lambda x: numbers(x, size / 4 - 1)))))
        f = f.withColumn("tables", F.concat(T.let(F.substr(c, F.lit(77), F.lit(436)), lambda x: numbers(x, F.lit(109))), more)).drop("further")
        last = F.array_max(F.transform("tables", lambda s, i: F.when(s < NO_SECTOR, i + 1)))
        f = _computed(f, fat=self._table(F.slice("tables", F.lit(1), F.coalesce(last, F.lit(0))))).drop("tables")
        f = f.withColumn("heads", _chains("fat", F.array(F.coalesce("dir", F.lit(NO_SECTOR)), F.coalesce("minifat", F.lit(NO_SECTOR)))))
        self.files = _computed(f, entries=self._directory(F.col("heads")[0]), minitable=self._table(F.col("heads")[1])).drop("heads", "dir", "minifat")

    @staticmethod
    def _sector(b: Column, s: Column) -> Column:
        """The bytes of a sector; null without any."""
        size = F.col("size")
        return F.when((s < NO_SECTOR) & ((s + 1) * size < F.octet_length(b)), F.substr(b, ((s + 1) * size + 1).cast("int"), size.cast("int")))

    def _table(self, sectors: Column) -> Column:
        """Sectors end to end; what isn't there says nothing of any sector."""
        hexed = lambda b, s: F.rpad(F.coalesce(F.hex(self._sector(b, s)), F.lit("")), (2 * F.col("size")).cast("int"), F.lit("F"))
        return F.unhex(T.let(F.col("content"), lambda b: F.array_join(F.transform(sectors, lambda s: hexed(b, s)), "")))

    @staticmethod
    def _entry(place: Column, b: Column) -> Column:
        n = lambda at, size: B.number_at(b, F.lit(at), size, little=True)
        kind = n(66, 1).cast("int")
        name = F.decode(F.substr(b, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(64), n(64, 2).cast("int")) - 2)), "UTF-16LE")
        return F.when(kind.isin(1, 2, 5), F.struct(place.alias("place"), name.alias("name"), kind.alias("type"), n(116, 4).alias("start"), n(120, 4).alias("length")))

    def _directory(self, sectors: Column) -> Column:
        each = lambda x, nth: F.transform(_upto(F.col("size") / 128), lambda i: T.let(F.substr(x, (i * 128 + 1).cast("int"), F.lit(128)), lambda e: self._entry(nth * 32 + i, e)))
        found = T.let(F.col("content"), lambda b: F.flatten(F.transform(sectors, lambda s, nth: T.let(self._sector(b, s), lambda x: each(x, nth)))))
        return F.filter(found, lambda e: e.isNotNull())

    def directory(self) -> DataFrame:
        """(file, place, name, type, start, length): entries of the directory; 1 is a storage, 2 a stream, 5 the root. A chain that leads back to itself is read once."""
        return self.files.select("file", F.inline("entries"))

    def _parts(self, wanted: Column | None) -> DataFrame:
        """Streams with the list of their parts (nth, bytes): the sectors of their chains, the last cut to the stream's length; of short streams the small sectors inside the root's."""
        f = self.files.withColumn("streams", F.filter("entries", lambda e: (e["type"] == 2) & (e["length"] > 0)))
        small = lambda e: e["length"] < F.col("cutoff")
        starts = lambda on: F.transform("streams", lambda e: F.when(on(e), e["start"]).otherwise(F.lit(NO_SECTOR)))
        root = F.get(F.transform(F.filter("entries", lambda e: e["type"] == 5), lambda e: e["start"]), F.lit(0))
        f = _computed(f, of_fat=F.array_append(starts(lambda e: ~small(e)), F.coalesce(root, F.lit(NO_SECTOR))), of_mini=starts(small))
        f = f.withColumns({"large": _chains("fat", "of_fat"), "minis": _chains("minitable", "of_mini")})
        f = f.withColumn("root", F.element_at("large", -1))
        size, mini = F.col("size"), F.col("mini")

        def parts(b, e, k):
            unit = F.when(small(e), mini).otherwise(size)
            of = lambda s: F.when(small(e), T.let(self._sector(b, F.get("root", F.floor(s * mini / size).cast("int"))), lambda x: F.substr(x, (s * mini % size + 1).cast("int"), mini.cast("int")))).otherwise(self._sector(b, s))
            cut = lambda x, nth: F.substr(x, F.lit(1), F.greatest(F.lit(0), F.least(unit, e["length"] - nth * unit)).cast("int"))
            chain = F.when(small(e), F.col("minis")[k]).otherwise(F.col("large")[k])
            got = F.transform(chain, lambda s, nth: F.struct(nth.cast("long").alias("nth"), cut(of(s), nth).alias("bytes")))
            return F.filter(got, lambda p: p["bytes"].isNotNull() & (p["nth"] * unit < e["length"]))

        streams = T.let(F.col("content"), lambda b: F.transform("streams", lambda e, k: F.struct(e["place"].alias("place"), e["name"].alias("name"), e["type"].alias("type"), e["start"].alias("start"), e["length"].alias("length"), parts(b, e, k).alias("parts"))))
        got = f.select("file", F.inline(streams)).where(F.size("parts") > 0)
        return got if wanted is None else got.where(wanted)

    def pieces(self, wanted: Column | None = None) -> DataFrame:
        """(file, place, name, nth, bytes): the sectors of streams in the order of their chains, cut to their lengths. ``wanted`` chooses entries."""
        return self._parts(wanted).select(F.col("file").alias(self.key), "place", "name", F.inline("parts"))

    def streams(self, wanted: Column | None = None) -> DataFrame:
        """(file, name, content): streams whole, as their chains give them; a stream is a value, so it must fit one."""
        whole = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), ""))
        return self._parts(wanted).select(F.col("file").alias(self.key), "name", whole.alias("content"))


def document_text(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, text): text of old word processor files: of the stream of that name, or else of all streams that have more than 20 characters, line by line; the longer of their UTF-16 and ASCII text."""
    of = Compound(files, key, content).streams()
    c = F.col("content")
    wide, narrow = B.utf16_document(c), F.coalesce(B.ascii_text(c), F.lit(""))
    rows = of.select(key, F.lower("name").alias("name"), T.longer(wide, narrow).alias("text"))
    main = F.col("name") == "worddocument"
    got = rows.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.when(main & (F.col("text") != ""), F.col("text")))), "\n").alias("main"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~main & (F.length("text") > 20), F.struct("name", "text")))), lambda x: x["text"]), "\n").alias("other"),
    )
    return got.select(key, F.when(F.col("main") != "", F.col("main")).otherwise(F.col("other")).alias("text"))
