"""Column functions and steps on odd rows: nulls, empty strings, ties, broken input."""

import datetime

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import binary as B
from sheafwork.functions import text as T
from sheafwork.operators import entries as N
from sheafwork.operators import exports as X
from sheafwork.operators import markup as M
from sheafwork.operators import parse as P
from sheafwork.operators import subtitles as S
from sheafwork.operators import views as V
from sheafwork.sources import files as files_
from sheafwork.sources import registry as R


def values(spark, f, *inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    plain = lambda v: v.asDict(recursive=True) if hasattr(v, "asDict") else [plain(e) for e in v] if isinstance(v, list) else v
    return [plain(r.y) for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_rtf(spark):
    got = values(spark, T.strip_rtf, r"{\rtf1{\fonttbl\f0 Arial;}Hello\par World a\\ b}", "", None, "plain\n\n\ntext", r"\u8364? \'e9")
    assert got == ["HelloWorld a\\ b", "", None, "plain\ntext", r"? \'e9"]


def test_markdown(spark):
    assert values(spark, S.markdown_html, "# a\n\n**b** *c* `d`\n- e\n#### f", "", None) == ["<p><h1>a</h1></p><p><strong>b</strong> <em>c</em> <code>d</code>\n<li>e</li>\n#### f</p>", "<p></p>", None]
    heads = values(spark, S.headings, "# \n## two  \n#three\n####### seven\n###### six", "", None)
    assert heads == [[{"level": 2, "text": "two  "}, {"level": 6, "text": "six"}], [], None]


def test_html(spark):
    assert values(spark, T.strip_html, "<title>t</title><BODY class=x><p>a&amp;lt;</p><script>no</script>\n\n\n\nb</BODY>tail", "no body <b>x</b>", "", None) == ["a<\n\nb", "no body \nx", "", None]
    tables = values(spark, M.html_tables, "<table><tr><th>a<th>b</th></tr></table>", "<table><tr><td>1</td></tr><tr><td> 2 </td><td><i>3</i></td></tr></table>", "<table></table>", "", None)
    assert tables[1] == [{"headers": ["1"], "rows": [["2", "3"]]}] and tables[2] == tables[3] == [] and tables[4] is None


def test_csv_rows(spark):
    rows = lambda c: M.csv_rows(c, F.lit(","))
    got = values(spark, rows, 'a,"b,""c""\r\nd",e\r\n\r\nx\n  \n', '""', '""""', "", None, "a,,\n,")
    assert got == [[["a", 'b,"c"\r\nd', "e"], ["x"], ["  "]], [], [['"']], [], None, [["a", "", ""], ["", ""]]]
    assert values(spark, M.csv_cells_of_lines, ' a , "b c" \n\n \nd', "") == [[["a", "b c"], ["d"]], []]


def test_subtitles(spark):
    assert values(spark, S.srt_cues, "", None, "1\n00:00:00,000 --> 00:00:01,000", "x\ny\nz") == [[], None, [], []]
    vtt = values(spark, S.vtt_cues, "WEBVTT", "WEBVTT\n\n00:01.000 --> 00:02.000\n12\n<b>hi</b>")
    assert vtt == [[], [{"start": "00:01.000", "end": "00:02.000", "text": "hi"}]]
    assert values(spark, S.ass_cues, "Dialogue: 0,1,2,3,4,5,6,7,8", "Dialogue: 0, 1 ,2,3,4,5,6,7,8,a,b", None) == [[], [{"start": "1", "end": "2", "text": "a,b"}], None]
    assert values(spark, lambda c: S.cue_table(S.srt_cues(c)), "1\n00:00:00,000 --> 00:00:01,000\n") == [[]]


def test_mail(spark):
    got = values(spark, M.mail_parts, "From: a\r\n\r\nbody", "no headers at all", "", "Subject: x\n\n--b\nContent-Type: text/plain\n\ninner\n--b--", None)
    assert got[0]["from"] == "a" and got[0]["body"] == "body" and got[1]["body"] == "" and got[2]["from"] is None and got[3]["body"] == "inner" and got[4]["body"] == ""
    assert values(spark, lambda c: M.address(c, F.lit("x@y")), "n", "", None) == ["n <x@y>", "x@y", "x@y"]


def test_binary(spark):
    number = lambda at, n, little=False: values(spark, lambda c: B.number(c, at, n, little), b"\x01\x02\x03\xff", b"\x01", b"", None, kind="binary")
    assert number(0, 2) == [258, None, None, None] and number(2, 2, True) == [65283, None, None, None] and number(-2, 2) == [1023, None, None, None] and number(3, 1) == [255, None, None, None]
    assert values(spark, B.text_strings, b"abc\x00ab\x00abc\x00x1y\x0012345\x00tail", b"", None, kind="binary") == [["abc", "x1y"], [], None]
    assert values(spark, B.archive_strings, b"a.txt\x00dir/x\x00plain\x00c\\d.e\x00a.txt\x00", kind="binary") == [["a.txt", "dir/x", "c\\d.e"]]
    assert values(spark, B.ascii_text, b"short", b"x" * 21 + b"\x00abc", b"", kind="binary") == [None, "x" * 21, None]
    assert values(spark, P.msgpack_type, b"\x83", b"\x9f", b"\xdc", b"\xdd", b"\xde", b"\xdf", b"\x01", b"", None, kind="binary") == ["fixmap(3)", "fixarray(15)", "array16", "array32", "map16", "map32", None, None, None]
    lines = values(spark, B.hex_lines, b"", b"A\x00~" * 6, None, kind="binary")
    assert lines[0] == [] and lines[1][1] == "00000010  00 7e" + "   " * 6 + "  " + " " * 23 + "  |.~" + " " * 14 + "|" and lines[2] == []
    assert values(spark, R.likely_text, b"", b"a\tb\n", b"\x01", b"\x7f", "é".encode(), kind="binary") == [True, True, False, False, True]


def test_configuration_and_listings(spark):
    assert values(spark, M.toml_entries, "", "# c\n[a]\n", None) == [[], [], None]
    got = values(spark, lambda c: F.transform(M.toml_entries(c), lambda e: F.concat_ws("|", e["section"], e["key"], e["kind"], e["value"])), "x = -1\n[s]\ny='q'\nz = 1.5\nn = ~\nv = a = b")
    assert got == [["|x|int|-1", "s|y|string|q", "s|z|float|1.5", "s|n|null", "s|v|string|a = b"]]
    assert values(spark, M.listed_7z, "", "-" * 20 + "\nd t A x y\n" + "-" * 20, None) == [[], [], None]
    assert values(spark, lambda c: M.counted(M.dxf_types(c)), "0\nA\n0\nB\n 0\n A\n", "") == [[{"item": "A", "n": 2}, {"item": "B", "n": 1}], []]
    assert values(spark, lambda c: N.with_note(F.split(c, ","), 2), "a,b,c,d", "a,b") == ["a\nb\n... +2", "a\nb"]
    assert values(spark, M.table_of_lines, ["a  b", "c"], ["a  b", "c  d"], [], None, kind="array<string>") == [None, {"headers": ["a", "b"], "rows": [["c", "d"]]}, None, None]


def test_exports(spark):
    assert values(spark, X.notebook, "{}", "no json", '{"cells": [{"source": []}]}', None)[0]["cells"] == 0
    broken = values(spark, X.json_export, "{", "[]", "3", '[{"a": {"b": 1}}, 5]', '{"b": 1, "a": 2}')
    assert broken[0] is None and broken[1]["records"] == 0 and broken[2]["type"] is None and broken[3]["rows"] == [['{"b":1}'], [""]] and broken[4]["keys"] == ["b", "a"]
    assert values(spark, lambda c: X.sniff(c, F.lit("x.txt")), "", "  \n[", "<html>", "<a/>", "a,b") == ["unknown", "json", "html", "xml", "unknown"]
    assert values(spark, V.value_type, "[1]", "{}", '"s"', "1.5", "false", "null", "nope", None) == ["array", "object", "string", "number", "boolean", "null", "invalid", "invalid"]
    assert values(spark, V.rendered_value, '[1, "a", {"b": 2}]', "{}", "[]", "x") == ['1, a, {"b":2}', "{}", "", "x"]


def test_entries(spark):
    e = spark.createDataFrame([(1, "s10.xml", "ten"), (1, "s2.xml", "two"), (1, "s2.xml", "again"), (1, "t1.xml", "no"), (1, "s3.xml", " "), (2, "t1.xml", "no"), (1, None, "x"), (1, "s4.xml", None)], "f int, name string, xml string")
    join = lambda **k: [tuple(r) for r in N.joined_parts(e, "f", r"s\d+\.xml", lambda x: x, sep="|", **k).collect()]
    assert join() == [(1, 3, "again|two|ten")] and join(number=False) == [(1, 3, "ten|again|two")]
    values_ = spark.createDataFrame([(1, "b", "2"), (1, "a", ""), (1, "c", None), (1, "z", "9")], "f int, key string, value string")
    dim = spark.createDataFrame([("a", "A", 0), ("b", "B", 1), ("c", "C", 2)], "key string, label string, pos int")
    assert [tuple(r) for r in N.fields_in_order(values_, dim, "f").collect()] == [(1, ["B: 2"])]
    assert N.dicom_scan(spark.createDataFrame([(1, b""), (2, None), (3, bytes(200))], "f int, content binary"), "f").count() == 0


def test_detection_of_odd_files(spark):
    rows = [(None, None, None, 7), ("", b"", None, 7), ("A.PDF", b"x", "text/csv", 7), ("x.TAR.GZ", None, None, 7), ("noext", b"  \n# head", None, 7), ("noext", b"%PD", None, 7), ("n", b"x", "text/csv", 7)]
    got = [(r.format_id, r.detected_by) for r in R.detect(spark.createDataFrame(rows, "name string, content binary, mime string, format_id int").coalesce(1).withColumn("i", F.monotonically_increasing_id()), mime="mime").orderBy("i").collect()]
    assert got == [(0, "unknown"), (0, "unknown"), (1, "extension"), (98, "extension"), (59, "text"), (0, "unknown"), (71, "mime")]
    assert R.detect(spark.createDataFrame([], "name string, content binary")).count() == 0


def test_files_and_results(spark, tmp_path):
    rows = spark.createDataFrame([("a.csv", "x,y\n1,2"), ("b/c.md", None), ("d.sqlite", "SQLite format 3\0" + "\x01" * 60), ("e.gz", "\x1f"), ("f.docx", "<w:t>one</w:t><w:t/><w:t xml:space='p'>two</w:t>")], "name string, content string")
    written = files_.write_files(rows, str(tmp_path)).collect()
    assert {r.name: r.bytes for r in written}["b/c.md"] == 0 and (tmp_path / "b/c.md").exists()
    files = files_.read_files(spark, str(tmp_path))
    assert {r.name: r.size for r in files.select("name", "size").collect()} == {"a.csv": 7, "d.sqlite": 76, "e.gz": 1, "f.docx": 48}  # Spark leaves out files without bytes
    got = {r.name: r.result for r in P.parse(R.detect(files)).collect()}
    assert got["a.csv"].tables[0].rows == [["1", "2"]] and got["a.csv"].error is None and got["a.csv"].metadata["fileSize"] == "7"
    assert got["f.docx"].text == "one two"
    assert got["d.sqlite"].metadata["pageSize"] == str(0x0101) and got["d.sqlite"].metadata["textEncoding"] == "unknown"
    assert not got["e.gz"].supported and got["e.gz"].metadata.keys() == {"fileName", "fileSize"}
    datetime.datetime.strptime(got["a.csv"].metadata["lastModified"], "%Y-%m-%dT%H:%M:%S.%fZ")
    with pytest.raises(Exception, match="name"):
        files_.write_files(rows.limit(1).select(F.lit("../x").alias("name"), "content"), str(tmp_path)).collect()
    assert P.parse(R.detect(files.limit(0))).count() == 0 and P.parse(R.detect(files), parsers={}).where("result.supported").count() == 0


def test_every_parser_takes_empty_and_odd_bytes(spark):
    suffixes = sorted({e for f in R.FORMATS for e in f[2]})
    rows = [(f"x{s}", len(c or b""), None, c) for s in suffixes for c in (b"", None, b"\xff\xfe\x00broken", bytes(range(256)))]
    df = R.detect(spark.createDataFrame(rows, "name string, size long, modified timestamp, content binary"))
    got = P.parse(df).collect()
    assert len(got) == len(rows) and all(r.result.text is not None and (r.result.error is None) == r.result.supported for r in got)


def test_views_of_odd_results(spark):
    rows = [("a.csv", 0, None, b""), ("b.nope", 1, None, b"x")]
    r = P.parse(R.detect(spark.createDataFrame(rows, "name string, size long, modified timestamp, content binary")))
    assert {x.name: x.raw.body for x in V.raw_view(r).collect()} == {"a.csv": "(데이터 없음)", "b.nope": "(데이터 없음)"}
    assert V.table_view(r, "name").count() == 0 and V.metadata_view(r, "name").where("name = 'b.nope'").count() == 2
    hexed = r.withColumn("result", F.col("result").withField("metadata", F.create_map(F.lit("hexPreview"), F.lit("true"))))
    assert {x.raw.kind for x in V.raw_view(hexed).collect()} == {"hex"}


def test_files_as_a_stream(spark, tmp_path):
    """Files are parsed once each, in the batch after they have come."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    names = lambda: sorted((r.name, r.result.metadata["rows"]) for r in spark.read.parquet(out).collect())
    for batch in (["a", "b"], ["c"]):
        files_.write_files(spark.createDataFrame([(f"{x}.csv", f"h\n{x}\n{x}") for x in batch], "name string, content string"), source).collect()
        stream = P.parse(R.detect(files_.read_files(spark, source, stream=True))).select("name", "result")
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    assert names() == [("a.csv", "2"), ("b.csv", "2"), ("c.csv", "2")]
