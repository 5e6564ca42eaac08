"""Nested and linked layouts on odd files: broken chains, cycles, borders, nulls; and functions on long hostile input."""

import struct
import time

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import binary as B
from sheafwork.functions import text as T
from sheafwork.operators import chains as C
from sheafwork.operators import containers as K
from sheafwork.operators import markup as M
from sheafwork.operators import nesting as E
from sheafwork.operators import subtitles as S


def files(spark, *contents, kind="binary"):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], f"f string, c {kind}")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_walks(spark):
    links = [("a", i, i + 1) for i in range(37)] + [("b", 0, 5), ("b", 5, 2), ("b", 2, 5), ("c", 4, 9)] + [("d", 3, None), ("d", 1, 3)]
    chain = C.Chain(spark.createDataFrame(links, "file string, at long, next long"))
    starts = spark.createDataFrame([("a", 0, None), ("b", 0, None), ("c", 3, None), ("d", 1, None), ("e", 0, None)], "file string, start long, end long")
    got = chain.walk(starts.drop("end"))
    assert [r.at for r in got.where("file = 'a'").orderBy("nth").collect()] == list(range(37))
    assert rows(got.where("file <> 'a'").select("file", "at", "nth")) == [("b", 0, 0), ("b", 2, 2), ("b", 5, 1), ("d", 1, 0), ("d", 3, 1)]
    bounded = chain.walk(spark.createDataFrame([("a", 5, 9), ("a", 30, 300), ("a", 9, 9)], "file string, start long, end long"))
    assert sorted((r.start, r.at) for r in bounded.collect()) == [(5, i) for i in range(5, 9)] + [(30, i) for i in range(30, 37)]


def test_running_sums_and_nearest_smaller(spark):
    levels = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9] * 4
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(levels)] + [("one", 0, 7)], "k string, i long, v int")
    got = {(r.k, r.i): r.s for r in C.running(df, ["k"], "i", F.col("v"), "s", block=7).collect()}
    assert got == {("k", i): sum(levels[: i + 1]) for i in range(60)} | {("one", 0): 7}
    near = {(r.k, r.i): r.parent for r in C.nearest_smaller(df, "k", "i", "v").collect()}
    want = {("k", i): max((j for j in range(i) if levels[j] < levels[i]), default=None) for i in range(60)} | {("one", 0): None}
    assert near == want
    flat = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("i"), F.lit(1).alias("v"))
    assert C.nearest_smaller(flat, "k", "i", "v").where("parent is not null").count() == 0


def test_yaml(spark):
    text = """
a: 1
b:
  - x
  -   y: "q: #1"  # no comment inside
      z: [1, two, ~]
  - - 1
    - {a: b}
c: &anchor v
"d e": 'single'
b:   # again
- last
f:
   g:
      h: -1.5
   i: http://x/y
not a pair
a: 2
  under: scalar
url:http
j: "unclosed
"""
    got = {r.path: (r.kind, r.value) for r in E.yaml_values(files(spark, text, None, "", "# only\n---\n...\n", "- a\n- b\r\n", kind="string"), "f", "c").collect() if r.f == "f0"}
    assert got == {
        "b": ("list", None), "b[0]": ("string", "last"), "c": ("string", "&anchor v"), "d e": ("string", "single"), "f": ("map", None), "f.g": ("map", None), "f.g.h": ("float", "-1.5"), "f.i": ("string", "http://x/y"),
        "a": ("int", "2"), "under": ("string", "scalar"), "j": ("string", '"unclosed'),
    }
    more = rows(E.yaml_values(files(spark, None, "", "- a\n- b\r\n-\n  - 1\n  - k: v\n    l:\n", kind="string"), "f", "c"))
    assert more == [("f2", "[0]", "string", "a"), ("f2", "[1]", "string", "b"), ("f2", "[2]", "list", None), ("f2", "[2][0]", "int", "1"), ("f2", "[2][1]", "map", None), ("f2", "[2][1].k", "string", "v"), ("f2", "[2][1].l", "null", None)]


def test_proto(spark):
    got = rows(E.proto_definitions(files(spark, "message A { int32 a = 1; message B { bytes b = 2; ", "}} message C { string s = 3; }", "", None, 'package x; enum E { A = 0x; } service S {}', kind="string"), "f", "c"))
    assert [g[:4] for g in got if g[0] == "f0"] == [("f0", "field", "A.B.b", "bytes"), ("f0", "field", "A.a", "int32"), ("f0", "message", "A", None), ("f0", "message", "A.B", None)]
    assert ("f1", "field", "C.s", "string", 3) in got and [g[1:3] for g in got if g[0] == "f4"] == [("enum", "E"), ("package", "x"), ("service", "S"), ("value", "E.A")]


def test_records_and_archives_on_odd_files(spark):
    shp = struct.pack(">i", 9994) + bytes(96)
    one = struct.pack(">ii", 1, 4) + bytes(8)
    odd = files(spark, None, b"", shp, shp + one, shp + one[:8], shp + one + one[:9], b"x" * 200, shp + struct.pack(">ii", 1, -8) + bytes(20))
    assert [(r[0], r[2], r[3]) for r in rows(K.shape_records(odd, "f", "c"))] == [("f3", 100, 8), ("f5", 100, 8), ("f5", 116, 8), ("f7", 100, -16)]
    entry = lambda name, data, flag=0: struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, flag, 0, 0, 0, 0, len(data), 9, len(name), 0) + name + data
    zips = files(spark, None, b"", b"PK\x03\x04", entry(b"a", b"PK\x03\x04" * 3) + entry("é".encode(), b"", 1) + b"PK\x01\x02", b"\0" + entry(b"b", b""))
    assert [(r[0], r[3], r[4], r[5], r[6]) for r in rows(K.zip_entries(zips, "f", "c"))] == [("f3", "a", 9, 12, False), ("f3", "é", 9, 0, True)]
    tar = lambda name, size: name.ljust(100, b"\0") + bytes(24) + size.ljust(12, b"\0") + bytes(376)
    tars = files(spark, None, b"", bytes(1024), tar(b"a", b"0000001") + bytes(512) + tar(b" b ", b"junk") + tar(b"", b"1") + tar(b"c", b"1"), tar(b"x", b"9")[:500])
    assert [(r[0], r[3], r[4]) for r in rows(K.tar_entries(tars, "f", "c"))] == [("f3", "a", 1), ("f3", "b", 0)]
    many = b"".join(tar(b"n%d" % i, b"0") for i in range(130))
    assert K.tar_entries(files(spark, many), "f", "c").count() == 100 and K.tar_entries(files(spark, many), "f", "c", most=1000).count() == 130


def test_places_across_block_borders(spark):
    body = bytearray(b"." * 100)
    for i in (0, 6, 7, 13, 21, 96):
        body[i : i + 4] = b"MARK"
    want = [i for i in range(97) if body[i : i + 4] == b"MARK"]
    for block in (1, 3, 7, 64, 1000):
        assert [r.at for r in C.places(files(spark, bytes(body)), "f", "c", b"MARK".hex(), block=block).orderBy("at").collect()] == want
    assert [r.at for r in C.places(files(spark, bytes(20)), "f", "c", start=3, step=5, block=2).orderBy("at").collect()] == [3, 8, 13, 18]


def test_boxes(spark):
    box = lambda kind, body, size=None: struct.pack(">I", 8 + len(body) if size is None else size) + kind + body
    deep = b""
    for _ in range(12):
        deep = box(b"moov", deep)
    large = struct.pack(">I4sQ", 1, b"free", 20) + b"1234"
    broken = box(b"moov", box(b"free", b"", 8) + box(b"free", b"xx", 500)) + box(b"skip", b"")
    got = rows(K.boxes(files(spark, deep, large + box(b"mdat", b"tail", 0), broken, b"", None, b"\0\0\0\x08\x01\x02\x03\x04"), "f", "c").select("f", "path", "at", "size", "level"))
    assert [g for g in got if g[0] == "f0"] == sorted(("f0", "/moov" * (i + 1), 8 * i, 96 - 8 * i, i) for i in range(12))
    assert [g for g in got if g[0] == "f1"] == [("f1", "/free", 0, 20, 0), ("f1", "/mdat", 20, 12, 0)]
    assert [g for g in got if g[0] == "f2"] == [("f2", "/moov", 0, 26, 0), ("f2", "/moov/free", 8, 8, 1), ("f2", "/skip", 26, 8, 0)] and len(got) == 17


def zigzag(n):
    n, out = (n << 1) ^ (n >> 63), bytearray()
    n &= 2**64 - 1
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_varints(spark):
    numbers = [0, -1, 1, 63, 64, -64, -65, 8191, 8192, 2**31, -(2**31), 2**62, -(2**63), 2**63 - 1]
    got = files(spark, *[b"x" + zigzag(n) + b"\xff" for n in numbers], b"x", b"x\x80\x80", None).select("f", B.varint(F.col("c"), F.lit(1).cast("long")).alias("v")).collect()
    by = {r.f: r.v for r in got}
    assert [(by[f"f{i}"].value, by[f"f{i}"].next) for i in range(len(numbers))] == [(n, 1 + len(zigzag(n))) for n in numbers]
    assert all(by[f"f{len(numbers) + i}"] is None or by[f"f{len(numbers) + i}"].value is None for i in range(3))


@pytest.mark.parametrize("ranged", [1, 17, 1 << 20])
def test_avro_blocks(spark, ranged):
    sync = bytes(range(16))
    pair = lambda k, v: zigzag(len(k)) + k + zigzag(len(v)) + v
    head = b"Obj\x01" + zigzag(2) + pair(b"avro.schema", b'"int"' * 30) + pair(b"avro.codec", b"null") + b"\0" + sync
    sized = b"Obj\x01" + zigzag(-1) + zigzag(14) + pair(b"k", b"v" * 11) + b"\0" + sync
    block = lambda n, body: zigzag(n) + zigzag(len(body)) + body + sync
    a, b, c = block(3, b"abc"), block(1000, sync + b"z" * 300), block(1, b"!")
    got = rows(K.avro_blocks(files(spark, head + a + b + c, sized + a, head, head + a + block(0, b"x") + c, head + a + b[:40], b"Obj\x01", b"", None, head[:20]), "f", "c", ranged=ranged))
    at = len(head)
    assert got == [("f0", 0, at, 3, 3), ("f0", 1, at + len(a), 1000, 316), ("f0", 2, at + len(a) + len(b), 1, 1), ("f1", 0, len(sized), 3, 3), ("f3", 0, at, 3, 3), ("f4", 0, at, 3, 3)]


def test_pickled_strings(spark):
    short = lambda code, s: code + bytes([len(s)]) + s
    long = lambda s: b"\x58" + struct.pack("<I", len(s)) + s
    body = b"\x80\x04" + short(b"\x8c", b"ab") + short(b"\x8c", b"x") + long(short(b"\x8c", b"inner")) + short(b"U", b"\xff\xfe") + short(b"\x8c", b"a\x01") + long(b"a\x01") + long(b"") + long(b"z" * 300) + b"\x8c\xff."
    got = [r.text for r in K.pickled_strings(files(spark, body, b"", None, b"\x8c"), "f", "c").orderBy("nth").collect()]
    assert got == ["ab", "a\x01", "z" * 300]  # the string that isn't UTF-8 hides the one inside it
    assert K.pickled_strings(files(spark, short(b"\x8c", b"ab") * 80), "f", "c").count() == 50


def compound(streams, cycle=False, tables=1):
    """A compound file: sectors of 512 bytes, small sectors of 64, large streams backwards."""
    n_fat = max(tables, 1)
    fat, data = [0xFFFFFFFD] * n_fat, [b""] * n_fat
    difat = [*range(min(n_fat, 109))]
    more = [*range(109, n_fat)]
    difat_at = []
    for i in range(0, len(more), 127):
        difat_at.append(len(fat))
        fat.append(0xFFFFFFFC)
        data.append(more[i : i + 127])
    for j, at in enumerate(difat_at):
        data[at] = struct.pack("<128I", *[*data[at], *[0xFFFFFFFF] * (127 - len(data[at]))], difat_at[j + 1] if j + 1 < len(difat_at) else 0xFFFFFFFE)

    def put(raw, backwards=True):
        parts = [raw[i : i + 512].ljust(512, b"\0") for i in range(0, len(raw), 512)]
        first = len(fat)
        order = list(range(len(parts)))[::-1] if backwards else list(range(len(parts)))
        place = {p: first + order.index(p) for p in range(len(parts))}
        for p in order:
            fat.append(place[p + 1] if p + 1 < len(parts) else 0xFFFFFFFE)
            data.append(parts[p])
        return place[0] if parts else 0xFFFFFFFE

    mini, minifat, entries = b"", [], []
    for name, raw in streams:
        if len(raw) >= 4096:
            entries.append((name, 2, put(raw), len(raw)))
        else:
            k = -(-len(raw) // 64)
            first = len(minifat)
            minifat += [first + i + 1 for i in range(k - 1)] + [0xFFFFFFFE] * (k > 0)
            mini += raw.ljust(k * 64, b"\0")
            entries.append((name, 2, first, len(raw)))
    root = put(mini) if mini else 0xFFFFFFFE
    minis = put(struct.pack(f"<{len(minifat)}I", *minifat).ljust(-(-len(minifat) * 4 // 512) * 512, b"\xff")) if minifat else 0xFFFFFFFE
    rows_ = b""
    for name, kind, start, size in [("Root Entry", 5, root, len(mini)), *entries]:
        raw = name.encode("utf-16-le")
        rows_ += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + b"\xff" * 12 + bytes(36) + struct.pack("<IQ", start, size)
    directory = put(rows_.ljust(-(-len(rows_) // 512) * 512, b"\0"), backwards=False)
    if cycle:
        fat[directory] = directory
    fat += [0xFFFFFFFF] * (n_fat * 128 - len(fat))
    for i in range(n_fat):
        data[i] = struct.pack("<128I", *fat[i * 128 : i * 128 + 128])
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", n_fat, directory, 0, 4096, minis, 1, difat_at[0] if difat_at else 0xFFFFFFFE, len(difat_at))
    return head + struct.pack("<109I", *difat, *[0xFFFFFFFF] * (109 - len(difat))) + b"".join(data)


def test_compound_files(spark):
    big, small = bytes(range(256)) * 20, b"small stream " * 9
    got = K.Compound(files(spark, compound([("WordDocument", big), ("1Table", small), ("Empty", b""), ("Other", b"o" * 64)]), compound([("A", small)], cycle=True), b"", None, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "f", "c").streams()
    assert sorted((r.f, r.name, bytes(r.content)) for r in got.collect()) == [("f0", "1Table", small), ("f0", "Other", b"o" * 64), ("f0", "WordDocument", big), ("f1", "A", small)]
    word = "가나다라 text of it\r\nsecond".encode("utf-16-le")
    texts = K.document_text(files(spark, compound([("worddocument", word), ("Data", b"ascii that is longer than twenty")]), compound([("b", b"ascii that is longer than twenty"), ("a", b"short")])), "f", "c")
    assert rows(texts) == [("f0", "가나다라 text of it\n\nsecond"), ("f1", "ascii that is longer than twenty")]


def test_tables_of_sectors_beyond_the_head(spark):
    raw = bytes(i % 251 for i in range(7_200_000))
    got = K.Compound(files(spark, compound([("Big", raw)], tables=112)), "f", "c").streams().collect()
    assert len(got) == 1 and bytes(got[0].content) == raw


def test_utf16_runs(spark):
    le = lambda s: s.encode("utf-16-le")
    odd = files(spark, le("abc\u00e9de\u00e9fghi"), le("ab\ncd\n한\u00e9 x \u00e9"), b"a", b"", None, le("first line\r\nsecond\ttab 漢字") + b"x", le("12345\u00e9abc\u00e9"))
    strings = lambda f: [r.x for r in odd.select("f", f(F.col("c")).alias("x")).orderBy("f").collect()]
    assert strings(B.utf16_strings) == [["abc"], [" x "], [], [], None, ["first line", "second"], ["abc"]]
    assert strings(B.utf16_lines) == [[], ["ab", "cd"], [], [], None, ["first line"], []]
    assert strings(B.utf16_document) == ["", "", "", "", "", "first line\n\nsecond\ttab 漢字", ""]
    shifted = odd.select("f", B.utf16_strings(F.concat(F.unhex(F.lit("EA")), "c"), 1).alias("x")).orderBy("f").collect()
    assert [r.x for r in shifted] == strings(B.utf16_strings)


HOSTILE = {
    "strip_html body": (T.strip_html, "<body " * 150_000),
    "strip_html style": (T.strip_html, "<style>" * 150_000),
    "strip_html script": (T.strip_html, "<script " * 120_000),
    "strip_tags": (T.strip_tags, "<" * 1_000_000),
    "trim_all": (T.trim_all, "x" + " " * 1_000_000 + "x"),
    "headings": (lambda c: F.size(S.html_headings(c)), "<h1>" * 250_000),
    "tables": (lambda c: F.size(M.html_tables(c)), "<table>" * 140_000),
    "rows": (lambda c: F.size(M.html_tables(c)), "<table>" + "<tr>" * 200_000 + "</table>"),
    "text_strings": (lambda c: F.size(B.text_strings(F.encode(c, "UTF-8"))), "a" * 1_000_000),
    "utf16_strings": (lambda c: F.size(B.utf16_strings(F.encode(c, "UTF-16LE"))), "a" * 500_000),
    "ascii_text": (lambda c: B.ascii_text(F.encode(c, "UTF-8")), "abcde\0" * 160_000),
    "toml": (lambda c: F.size(M.toml_entries(c)), "[a]\nk = 1\n" * 50_000),
    "listing": (lambda c: F.size(M.listed_7z(c)), "-" * 20 + "\n" + "a b c d e f\n" * 80_000),
    "merged": (lambda c: F.size(T.merged_short(F.split(c, ","))), "short,a much longer item of a list," * 20_000),
    "csv": (lambda c: F.size(M.csv_rows(c, F.lit(","))), '"' * 1_000_000),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_that_is_never_closed(spark, name):
    f, text = HOSTILE[name]
    df = files(spark, text, kind="string")
    began = time.time()
    df.select(f(F.col("c")).alias("x")).collect()
    assert time.time() - began < 15, name


def test_lines_of_many_items(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.struct((i % 7).cast("double").alias("x"), (F.floor(i / 5) * 10).cast("double").alias("y"), i.cast("string").alias("str"))).alias("items"))
    began = time.time()
    assert df.select(F.size(T.lines_of_items(F.col("items"))).alias("n")).first().n == 40_001
    assert time.time() - began < 20


def test_what_is_never_closed_stays(spark):
    got = lambda f, text: files(spark, text, kind="string").select(f(F.col("c")).alias("x")).first().x
    assert got(T.strip_html, "a<style>b</style>c<style>d") == "ac\nd" and got(T.strip_html, "<BODY a>x</Body>y<body>z") == "x" and got(T.strip_html, "x<body>y") == "x\ny"
    assert got(T.strip_html, "a<style </style>b</style>c") == "ac" and got(T.strip_tags, "a<>b<i>c<d") == "a<>bc<d" and got(T.trim_all, " \u00a0 a  b \n") == "a  b"
    assert got(lambda c: F.size(S.html_headings(c)), "<h1>a</h1><h2>b<h3>c</h3><h4>d") == 2
    assert got(lambda c: M.csv_rows(c, F.lit(",")), 'a\x1e,"b\x1fc"\x0e,\x0eS\nd') == [["a\x1e", "b\x1fc\x0e", "\x0eS"], ["d"]]


def test_chains_of_sectors_need_no_job_of_their_own(spark):
    """A compound file is read where it is: however long its chains are, planning it starts no job."""
    df = files(spark, compound([("WordDocument", bytes(range(256)) * 200)]))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("compound", "")
    got = K.document_text(df, "f", "c")
    jobs = len(tracker.getJobIdsForGroup("compound"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 0 and got.count() == 1


def test_sectors_of_4096_bytes_where_a_head_names_too_few(spark, tmp_path):
    """A stream beyond the sectors that 109 sectors of a table can name, as the query's files have at larger sizes."""
    from sheafwork.plans import catalog

    spark.range(200_000).selectExpr("id as c_custkey", "1 as c_nationkey", "concat('Customer#', lpad(id, 9, '0'))  as c_name").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.queries()["sector_streams"](spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].text == "\n".join(f"Customer#{i:09}" for i in range(200_000))


def test_tables_that_grow_are_never_sent_through_the_driver(spark):
    """Joins of written tables are dealt by key, however small their compressed files look."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    yaml = E.yaml_values(files(spark, "a:\n- b: 1\n  c: 2\n", kind="string"), "f", "c")
    level = C.nearest_smaller(spark.createDataFrame([("k", 0, 1), ("k", 1, 2)], "k string, i long, v int"), "k", "i", "v")
    assert "Broadcast" not in plan(yaml) + plan(level)
    assert rows(yaml.select("path")) == [("a",), ("a[0]",), ("a[0].b",), ("a[0].c",)]


def test_boxes_are_found_without_rounds(spark):
    """Walks of media files start no job of their own, and rows of one file may be more than go out at once."""
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    df = files(spark, box(b"moov", box(b"trak", box(b"free", b"ab")) * 20_000), box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", box(b"ispe", bytes(4) + struct.pack(">II", 7, 9))))), None)
    spark.sparkContext.setJobGroup("boxes", "")
    got = K.boxes(df, "f", "c")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boxes"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 0 and rows(got.groupBy("f", "path").count()) == [("f0", "/moov", 1), ("f0", "/moov/trak", 20_000), ("f0", "/moov/trak/free", 20_000), *[("f1", p, 1) for p in ("/meta", "/meta/iprp", "/meta/iprp/ipco", "/meta/iprp/ipco/ispe")]]
    assert [tuple(r) for r in got.where("width is not null").select("at", "size", "level", "width", "height").collect()] == [(28, 20, 3, 7, 9)]


def test_strings_are_found_without_rounds(spark):
    """Strings of pickled objects need no job of their own; an opcode whose length doesn't fit is passed over by a byte."""
    df = files(spark, b"\x58\xff\xff\xff\xff\x55\x02ab\x8c\x03\xe2\x82\xac\x8c\x02cd" + b"\x58\x02\0\0\0e\x01" * 3, b"\x8c\x02xy" * 70_000, b"\x55", None)
    spark.sparkContext.setJobGroup("strings", "")
    got = K.pickled_strings(df, "f", "c")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("strings"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 0 and [r for r in rows(got) if r[0] == "f0"] == [("f0", i, t) for i, t in enumerate(["ab", "cd", "e\x01", "e\x01", "e\x01"])]
    assert got.where("f <> 'f0'").count() == 50 and K.pickled_strings(df, "f", "c", most=100_000).where("f = 'f1'").count() == 70_000
