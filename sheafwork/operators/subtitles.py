"""Subtitles and Markdown as column expressions: text in, arrays of structs out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# Hours have two digits or more.
_TIME = r"(?<!\d)(\d{2,}+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2,}+:\d{2}:\d{2}[,.]\d{3})"


def _clean(c: Column) -> Column:
    return T.trim_all(F.regexp_replace(T.strip_tags(c), r"\{[^}]*\}", ""))


def _cue(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))


def _blocks(text: Column) -> Column:
    return F.split(T.trim_all(F.replace(text, F.lit("\r\n"), F.lit("\n"))), r"\n\s*\n")


def srt_cues(text: Column) -> Column:
    """Cues (start, end, text) of SRT: blocks of three lines at least with the times on the second."""
    lines = F.transform(_blocks(text), lambda b: F.split(b, "\n"))
    whole = F.filter(lines, lambda x: (F.size(x) >= 3) & F.get(x, F.lit(1)).rlike(_TIME))
    return F.transform(whole, lambda x: _cue(F.regexp_extract(x[1], _TIME, 1), F.regexp_extract(x[1], _TIME, 2), _clean(F.array_join(F.slice(x, 3, F.size(x)), " "))))


def vtt_cues(text: Column) -> Column:
    """Cues of WebVTT: the first block is the head; the times may be on any line; lines of digits are cue numbers."""
    time = r"((?:(?<!\d)\d{2,}+:)?\d{2}:\d{2}\.\d{3})\s*-->\s*((?:\d{2,}+:)?\d{2}:\d{2}\.\d{3})"
    blocks = _blocks(text)
    timed = F.filter(F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1))), lambda b: b.rlike(time))
    body = lambda b: F.array_join(F.filter(F.split(b, "\n"), lambda x: ~x.rlike("-->") & ~x.rlike(r"^\d+$")), " ")
    return F.transform(timed, lambda b: _cue(F.regexp_extract(b, time, 1), F.regexp_extract(b, time, 2), _clean(body(b))))


def ass_cues(text: Column) -> Column:
    """Cues of ASS and SSA: lines "Dialogue:" with ten fields at least; the text is all from the tenth on."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.startswith(x, F.lit("Dialogue:")))
    parts = F.filter(F.transform(lines, lambda x: F.split(x, ",")), lambda p: F.size(p) >= 10)
    return F.transform(parts, lambda p: _cue(T.trim_all(p[1]), T.trim_all(p[2]), T.trim_all(F.regexp_replace(F.array_join(F.slice(p, 10, F.size(p)), ","), r"\{[^}]*\}", ""))))


def render_srt(cues: Column) -> Column:
    """SRT of cues with start_ms, end_ms and text."""
    block = lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), T.cue_timestamp(c["start_ms"]), F.lit(" --> "), T.cue_timestamp(c["end_ms"]), F.lit("\n"), c["text"])
    return F.array_join(F.transform(cues, block), "\n\n")


def headings(text: Column) -> Column:
    """Markdown headings (level, text), in order; those without a text go, code fences aren't known."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s+."))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#{1,6})", 1)).cast("int").alias("level"), F.regexp_extract(x, r"^#{1,6}\s+(.+)", 1).alias("text")))


def html_headings(html: Column) -> Column:
    whole = T.all_of(T.closed_only(html, "<h[1-6][^>]*>", "</h[1-6]>", "<h[1-6]"), r"(?is)<h[1-6][^>]*>.*?</h[1-6]>", 0)
    return F.transform(whole, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), T.strip_tags(h).alias("text")))


# What is replaced in Markdown, in this order.
MARKDOWN = [
    (r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"(?m)^## (.+)$", "<h2>$1</h2>"), (r"(?m)^# (.+)$", "<h1>$1</h1>"), (r"\*\*(.+?)\*\*", "<strong>$1</strong>"),
    (r"\*(.+?)\*", "<em>$1</em>"), ("`(.+?)`", "<code>$1</code>"), (r"(?m)^- (.+)$", "<li>$1</li>"), (r"\n\n", "</p><p>"),
]


def markdown_html(text: Column) -> Column:
    """A plain rendering of Markdown: three levels of headings, bold, italics, code, list items and paragraphs; nothing is escaped."""
    for pattern, by in MARKDOWN:
        text = F.regexp_replace(text, pattern, by)
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def subtitle_cues(text: Column, suffix: Column) -> Column:
    """Cues by the file's suffix: .srt, .vtt, any other as ASS."""
    return F.when(suffix == ".srt", srt_cues(text)).when(suffix == ".vtt", vtt_cues(text)).otherwise(ass_cues(text))


def cue_table(cues: Column) -> Column:
    """Rows (number from 1, start, end, text) as strings."""
    return F.transform(cues, lambda c, i: F.array((i + 1).cast("string"), c["start"], c["end"], c["text"]))


def cue_text(cues: Column) -> Column:
    """Texts of the cues, a line each; empty ones go."""
    return F.array_join(F.filter(F.transform(cues, lambda c: c["text"]), lambda t: t != ""), "\n")
