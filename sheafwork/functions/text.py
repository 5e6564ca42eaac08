"""Column functions of the parsing engine; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(content: Column) -> Column:
    """Bytes as text: malformed bytes become U+FFFD and a leading byte-order mark goes."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\ufeff", "")


def data_url(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(mime, F.lit("application/octet-stream")), F.lit(";base64,"), F.base64(content))


def trim_all(c: Column) -> Column:
    """Without white space of any kind at both ends; SQL's trim() takes spaces only. A run of it is looked at once, wherever it stands."""
    return F.regexp_replace(c, r"^[\s\u00a0\ufeff]++|(?<![\s\u00a0\ufeff])[\s\u00a0\ufeff]++\z", "")


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def body_of(html: Column) -> Column:
    """What stands in a page's body, or the page if none is opened and closed. Only the first opening counts: if it isn't closed, no later one is."""
    inner = lambda b: F.substr(b, F.locate(">", b) + 1, F.length(b) - F.locate(">", b) - len("</body>"))
    return let(html, lambda c: let(F.regexp_extract(c, "(?is)(<body[^>]*+>.*?</body>)|<body.*+", 1), lambda b: F.when(b == "", c).otherwise(inner(b))))


def closed_only(c: Column, opening: str, closing: str, start: str) -> Column:
    """A text without what follows the first element that is never closed.

    No element behind such a one is closed either, so patterns that look for whole elements find the same in what is left, and each of them is then read once. ``start``: what an ``opening``
    begins with, such that it fails only for want of an end.
    """
    return F.regexp_replace(c, f"(?is)({opening}.*?{closing})|{start}.*+", "$1")


def without(c: Column, opening: str, closing: str, start: str) -> Column:
    """A text without whole elements; what follows the first one that is never closed stays as it is."""
    return F.regexp_replace(c, f"(?is){opening}.*?{closing}|({start}.*+)", "$1")


def last_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def detector_suffix(name: Column) -> Column:
    """The last suffix, but .tar.gz and .tar.bz2 whole."""
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit(".tar.gz")), F.lit(".tar.gz")).when(F.endswith(low, F.lit(".tar.bz2")), F.lit(".tar.bz2")).otherwise(last_suffix(name))


def file_size_label(size: Column, largest: str = "GB") -> Column:
    """A size in B, KB, MB or GB, in no unit above ``largest``."""
    unit = lambda power, name: F.format_string(f"%.1f {name}", size.cast("double") / F.lit(float(1024**power)))
    units = ("KB", "MB", "GB")[: ("KB", "MB", "GB").index(largest) + 1]
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, name in enumerate(units[:-1], 1):
        out = out.when(size < 1024 ** (i + 1), unit(i, name))
    return out.otherwise(unit(len(units), largest))


def _pad(c: Column, n: int) -> Column:
    s = c.cast("long").cast("string")
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, "0"))


def cue_timestamp(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours aren't wrapped."""
    part = lambda unit, of: F.floor(ms / unit) % of if of else F.floor(ms / unit)
    return F.concat(_pad(part(3_600_000, 0), 2), F.lit(":"), _pad(part(60_000, 60), 2), F.lit(":"), _pad(part(1000, 60), 2), F.lit(","), _pad(ms % 1000, 3))


def duration_label(seconds: Column, unknown: str = "알 수 없음") -> Column:
    whole = F.floor(seconds)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds < float("inf"))
    long = F.concat(h.cast("string"), F.lit(":"), _pad(m, 2), F.lit(":"), _pad(s, 2))
    return F.when(~usable, F.lit(unknown)).when(h > 0, long).otherwise(F.concat(m.cast("string"), F.lit(":"), _pad(s, 2)))


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def strip_html(c: Column) -> Column:
    """A page's text: the body if there is one, without styles and scripts; tags become line ends, five entities are decoded in a fixed order."""
    out = without(without(body_of(c), "<style[^>]*>", "</style>", "<style"), "<script[^>]*>", "</script>", "<script")
    out = strip_tags(out, "\n")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(collapsed(out), r"^\s++|(?<!\s)\s++\z", "")


def strip_tags(c: Column, by: str = "") -> Column:
    """A text with ``by`` for each tag.  Behind the last closing bracket there are none, so nothing is looked for there."""
    cut = lambda x, n: F.concat(F.regexp_replace(F.substr(x, F.lit(1), n), "<[^>]+>", by), F.substr(x, n + 1))
    return let(c, lambda x: let(F.length(x) - F.length(F.substring_index(x, ">", -1)), lambda n: cut(x, n)))


# What is replaced in RTF, in this order.
RTF = [(r"\{\\[^{}]*\}", ""), (r"(?i)\\[a-z]+\d*\s?", ""), (r"[{}]", ""), (r"\\\\", r"\\"), (r"\n+", "\n")]


def strip_rtf(c: Column) -> Column:
    """Plain text of RTF: groups that begin with a control and hold no other group go, then control words and braces; a doubled backslash is one."""
    for pattern, by in RTF:
        c = F.regexp_replace(c, pattern, by)
    return trim_all(c)


def all_of(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def element_texts(xml: Column, tag: str) -> Column:
    """Texts of an XML element, entities not decoded: element_texts(x, "w:t")."""
    return all_of(closed_only(xml, f"(?-i:<{tag}(?: [^>]*)?>)", f"(?-i:</{tag}>)", f"(?-i:<{tag})(?=[ >])"), f"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>")


def dublin_core(xml: Column, field: str) -> Column:
    return F.nullif(F.regexp_extract(xml, f"(?s)<dc:{field}[^>]*>(.*?)</dc:{field}>", 1), F.lit(""))


def utf16_length(c: Column) -> Column:
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def longer(a: Column, b: Column) -> Column:
    return F.when(F.length(a) >= F.length(b), a).otherwise(b)


def rounded(c: Column) -> Column:
    """To the next integer, halves up."""
    return F.floor(c + 0.5)


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: Items that are folded in one go: Spark copies a fold's state at each step, so no state may grow with all items.
_GO = 512


def _fold(items: Column, kind: str, state: str, step) -> Column:
    """(lists, now): what a fold gives out, in order, and its last state.  ``step(state, item)`` is (whether something is given out, what, the next state); the first state is null.

    Items are folded in pieces, each with a list of its own, and pieces among each other.
    """
    pieces = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items), F.lit(_GO)), lambda at: F.slice(items, at, _GO))).otherwise(F.array().cast("array<array<string>>") if kind == "string" else F.array().cast("array<array<int>>"))
    empty = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        out, what, now = step(acc["now"], x)
        return F.struct(F.when(out, F.array_append(acc["list"], what)).otherwise(acc["list"]).alias("list"), now.alias("now"))

    def piece(acc, xs):
        got = F.aggregate(xs, F.struct(empty.alias("list"), acc["now"].alias("now")), one)
        return F.transform(F.array(got), lambda g: F.struct(F.array_append(acc["lists"], g["list"]).alias("lists"), g["now"].alias("now")))[0]

    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("lists"), F.lit(None).cast(state).alias("now"))
    return F.aggregate(pieces, start, piece)


def merged_short(items: Column, least: int = 20) -> Column:
    """An ordered fold: an item joins the one before, with a blank, while both are shorter than ``least``."""

    def step(now, x):
        together = F.coalesce((F.length(now) < least) & (F.length(x) < least), F.lit(False))
        return now.isNotNull() & ~together, now, F.when(together, F.concat(now, F.lit(" "), x)).otherwise(x)

    whole = lambda items: F.transform(F.array(_fold(items, "string", "string", step)), lambda g: F.when(g["now"].isNull(), F.flatten(g["lists"])).otherwise(F.array_append(F.flatten(g["lists"]), g["now"])))[0]
    return F.when(items.isNotNull(), F.transform(F.array(items), whole)[0])


def lines_of_items(items: Column, tolerance: float = 3.0) -> Column:
    """Positioned items, array of (x, y, str), as lines: from top to bottom, an item is on a line while its y is within ``tolerance`` of that of the line's first item.

    The fold notes where lines begin; then each line is cut out of the ordered items.
    """

    def lines(ordered):
        def step(anchor, at):
            y = ordered[at]["k"]
            near = F.coalesce(F.abs(y - anchor) < tolerance, F.lit(False))
            return ~near, at, F.when(near, anchor).otherwise(y)

        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
        begins = F.transform(F.array(places), lambda p: F.flatten(_fold(p, "int", "double", step)["lists"]))[0]
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda at, n: F.slice(ordered, at + 1, F.coalesce(F.get(b, n + 1), F.size(ordered)) - at)))[0]

    ordered = F.array_sort(F.transform(items, lambda i: F.struct((-i["y"]).alias("k"), i["x"].alias("x"), i["str"].alias("str"))))
    cut = F.when(items.isNotNull(), F.transform(F.array(ordered), lines)[0])  # bound once, however often it is named
    return F.transform(cut, lambda line: F.array_join(F.transform(F.array_sort(F.transform(line, lambda i: F.struct(i["x"].alias("x"), i["str"].alias("str")))), lambda i: i["str"]), " "))
