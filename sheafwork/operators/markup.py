"""Text and tables from markup and text layers, as column expressions: HTML tables, mail, PDF, FDF, Office XML parts, CSV, TOML, DXF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

STRINGS = "array<string>"


def html_tables(html: Column) -> Column:
    """Tables (headers, rows) of a page: the first row's cells are headers, rows without cells go; texts without tags, trimmed. Tables inside tables aren't known."""
    opening = lambda tag: rf"<{tag}(?:\s[^>]*)?>"
    whole = lambda c, tag, end: T.all_of(T.closed_only(c, opening(tag), f"</{end}>", rf"<{tag}(?=[\s>])"), rf"(?is){opening(tag)}(.*?)</{end}>")
    cells = lambda row: F.transform(whole(row, "t[hd]", "t[hd]"), lambda c: T.trim_all(T.strip_tags(c)))
    rows = lambda t: F.transform(whole(t, "tr", "tr"), cells)
    tables = F.transform(whole(html, "table", "table"), rows)
    none = F.array().cast(STRINGS)
    split = lambda r: F.struct(F.coalesce(F.get(r, F.lit(0)), none).alias("headers"), F.filter(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda c: F.size(c) > 0).alias("rows"))
    return F.filter(F.transform(tables, split), lambda t: (F.size(t["headers"]) > 0) | (F.size(t["rows"]) > 0))


def mail_text(html: Column) -> Column:
    """Plain text of a mail's HTML: tags become line ends, entities stay."""
    return T.trim_all(T.collapsed(T.strip_tags(html, "\n")))


def address(name: Column, mail: Column) -> Column:
    """name <mail>, or the mail alone without a name."""
    return F.when(F.coalesce(name, F.lit("")) == "", mail).otherwise(F.concat(name, F.lit(" <"), mail, F.lit(">")))


def mail_parts(text: Column) -> Column:
    """(from, to, subject, date, content_type, body) of a mail: header lines up to the first blank line, the text/plain part if the body has one, 10,000 characters of it.

    Line ends CRLF count as LF. Of a repeated header the last counts. Without a blank line the first 2000 characters are headers and there is no body.
    """
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    end = F.instr(t, "\n\n")
    lines = F.split(F.when(end > 1, F.substr(t, F.lit(1), end - 1)).otherwise(F.substring(t, 1, 2000)), "\n")
    body = F.when(end > 1, F.substr(t, end + 2)).otherwise("")
    mark = "Content-Type: text/plain"
    part = F.substr(body, F.instr(body, mark))
    start = F.instr(part, "\n\n")
    inner = F.substr(part, start + 2)
    plain = F.when(F.contains(body, F.lit(mark)) & (start > 0), F.substring_index(inner, "\n--", 1)).otherwise(body)

    def header(name):
        own = F.filter(lines, lambda x: x.rlike(rf"^{name}:\s*."))
        return F.when(F.size(own) > 0, T.trim_all(F.regexp_replace(F.element_at(own, -1), rf"^{name}:\s*", "")))

    fields = [header(h).alias(a) for a, h in (("from", "From"), ("to", "To"), ("subject", "Subject"), ("date", "Date"), ("content_type", "Content-Type"))]
    return F.struct(*fields, F.substring(plain, 1, 10_000).alias("body"))


def pdf_strings(latin1: Column) -> Column:
    """Strings shown in the text blocks of an uncompressed PDF, joined by blanks: 10,000 characters."""
    blocks = T.all_of(latin1, r"(?s)BT(.*?)ET")
    return F.substring(F.array_join(F.flatten(F.transform(blocks, lambda b: T.all_of(b, r"\(([^)]*)\)\s*Tj"))), " "), 1, 10_000)


def fdf_fields(text: Column) -> Column:
    """Form fields (name, value), in order."""
    pattern = r"(?s)/T\s*\(([^)]+)\).*?/V\s*\(([^)]*)\)"
    return F.zip_with(T.all_of(text, pattern, 1), T.all_of(text, pattern, 2), lambda a, b: F.struct(a.alias("name"), b.alias("value")))


def table_of_lines(lines: Column) -> Column:
    """(headers, rows) of lines whose cells are two blanks or more apart; null unless the first line and one more have two cells."""
    cells = F.transform(lines, lambda x: F.filter(F.split(x, r"\s{2,}"), lambda c: c != ""))
    headers = F.get(cells, F.lit(0))
    rows = F.filter(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda r: F.size(r) >= 2)
    return F.when((F.size(lines) >= 2) & (F.size(headers) >= 2) & (F.size(rows) > 0), F.struct(headers.alias("headers"), rows.alias("rows")))


def paragraphs(xml: Column, close: str = "</a:p>", text: str = "<a:t>([^<]*)</a:t>") -> Column:
    """Texts of an XML part, a string for each paragraph that isn't blank; entities aren't decoded."""
    parts = F.transform(F.split(xml, close), lambda p: F.array_join(T.all_of(p, text), ""))
    return F.filter(parts, lambda p: T.trim_all(p) != "")


def attribute_texts(xml: Column, name: str = "UnicodeString") -> Column:
    return T.all_of(xml, f'{name}="([^"]+)"')


def odf_paragraphs(xml: Column) -> Column:
    whole = T.all_of(xml, r"<text:p[^>]*>([^<]*(?:<[^>]+>[^<]*)*?)</text:p>", 0)
    return F.filter(F.transform(whole, lambda p: T.strip_tags(p)), lambda p: p != "")


def csv_rows(text: Column, delimiter: Column) -> Column:
    """Rows of delimited text as arrays of cells, ragged ones as they are; lines without any character go.

    A quoted cell may hold delimiters, line ends and doubled quotes. The text is cut at quotes: every second piece is inside them, and an empty piece outside,
    between two that are inside, is a doubled quote. Delimiters and line ends outside are turned to the unit and record separators of ASCII; those that a text has itself are written as a shift
    and a letter while it is cut, and so are shifts.
    """
    hidden = (("\x0e", "\x0eS"), ("\x1e", "\x0eR"), ("\x1f", "\x0eU"))
    safe = text
    for x, y in hidden:
        safe = F.replace(safe, F.lit(x), F.lit(y))

    def turned(pieces):
        def piece(p, i):
            outside = F.replace(F.replace(F.replace(p, F.lit("\r\n"), F.lit("\n")), delimiter, F.lit("\x1f")), F.lit("\n"), F.lit("\x1e"))
            return F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit('"')).otherwise(outside)

        return F.array_join(F.transform(pieces, piece), "")

    records = F.split(T.let(F.split(safe, '"', -1), turned), "\x1e", -1)

    def shown(cell):
        plain = cell
        for x, y in reversed(hidden):
            plain = F.replace(plain, F.lit(y), F.lit(x))
        return F.when(F.contains(cell, F.lit("\x0e")), plain).otherwise(cell)

    return F.transform(F.filter(records, lambda r: r != ""), lambda r: F.transform(F.split(r, "\x1f", -1), shown))


def csv_cells_of_lines(text: Column, delimiter: str = ",", most: int | None = None) -> Column:
    """The plain reading, line by line: blank lines go, cells are trimmed, quotes can't hold line ends."""
    lines = F.filter(F.split(text, "\n"), lambda x: T.trim_all(x) != "")
    if most:
        lines = F.slice(lines, 1, most)
    return F.transform(lines, lambda x: F.transform(F.get(csv_rows(x, F.lit(delimiter)), F.lit(0)), lambda c: T.trim_all(c)))


def scalar(literal: Column) -> Column:
    """(kind, value as text) of a plain literal: string in quotes, true, false, null, int, float or a bare string."""
    quoted = literal.rlike("(?s)^(\".*\"|'.*')$") & (F.length(literal) >= 2)
    kind = F.when(quoted, "string").when(literal.isin("true", "false"), "boolean").when(literal.isin("null", "~"), "null").when(literal.rlike(r"^-?\d+$"), "int").when(literal.rlike(r"^-?\d+\.\d+$"), "float").otherwise("string")
    number = F.when(kind == "int", literal.cast("decimal(38,0)").cast("string"))
    value = F.when(quoted, F.substr(literal, F.lit(2), F.length(literal) - 2)).when(kind == "null", F.lit(None)).when(number.isNotNull(), number).otherwise(literal)
    return F.struct(kind.alias("kind"), value.alias("value"))


def toml_entries(text: Column) -> Column:
    """Entries (section, key, kind, value) of flat TOML, in order: every entry carries the section whose line was last before it, the empty one at first.

    The text is cut before each line that names a section, so each part knows its own.
    """
    blank = r"[ \t\r\x0b\f\u00a0\ufeff]*"
    parts = F.split(text, rf"(?m)^(?={blank}\[[^\]\n]+\]{blank}$)")

    def entries(part):
        lines = F.transform(F.split(part, "\n"), lambda x: T.trim_all(x))
        section = T.trim_all(F.regexp_extract(F.get(lines, F.lit(0)), r"^\[([^\]]+)\]$", 1))
        known = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~x.rlike(r"^\[[^\]]+\]$") & x.rlike(r"^[^=]+=\s*.+$"))

        def entry(line):
            s = scalar(T.trim_all(F.regexp_extract(line, r"^[^=]+=\s*(.+)$", 1)))
            return F.struct(section.alias("section"), T.trim_all(F.regexp_extract(line, r"^([^=]+)=", 1)).alias("key"), s["kind"].alias("kind"), s["value"].alias("value"))

        return F.transform(known, entry)

    return F.flatten(F.transform(parts, entries))


def dxf_types(text: Column) -> Column:
    """Types of the entities of a DXF, one for each group code 0, in order."""
    return T.all_of(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?m)^[ \t]*0\n\s*(\w+)")


def dxf_drawing(text: Column) -> Column:
    """(version, units, variables, layers, blocks, types, texts, dimensions) of a DXF: header variables, names of layers and blocks, and the types of the entities of its section of entities, in order; a hundred texts."""
    t = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    pairs = r"(?:[ \t]*[1-9]\d*\n[^\n]*\n)*?"  # group codes and values up to what is looked for, within one entity
    entities = F.regexp_extract(t, r"(?s)\n[ \t]*2\nENTITIES\n(.*?\n)[ \t]*0\nENDSEC", 1)
    named = lambda kind: T.all_of(t, rf"(?m)^[ \t]*0\n{kind}\n{pairs}[ \t]*2\n([^\n]*)$")
    variable = lambda name, code: F.nullif(T.trim_all(F.regexp_extract(t, rf"(?m)^[ \t]*9\n\${name}\n[ \t]*{code}\n([^\n]*)$", 1)), F.lit(""))
    lines = F.split(entities, "\n")
    codes = F.filter(lines, lambda x, i: i % 2 == 0)
    values = F.filter(lines, lambda x, i: i % 2 == 1)
    kinds = F.filter(F.zip_with(codes, values, lambda c, v: F.when(T.trim_all(c) == "0", T.trim_all(v))), lambda k: k.isNotNull())
    texts = F.filter(T.all_of(entities, rf"(?m)^[ \t]*0\nM?TEXT\n{pairs}[ \t]*1\n([^\n]*)$"), lambda x: x != "")
    return F.struct(
        variable("ACADVER", 1).alias("version"), variable("INSUNITS", 70).alias("units"), F.regexp_count(t, F.lit(r"(?m)^[ \t]*9\n\$")).alias("variables"), named("LAYER").alias("layers"), named("BLOCK").alias("blocks"),
        kinds.alias("types"), F.slice(texts, 1, 100).alias("texts"), F.size(F.filter(kinds, lambda k: k == "DIMENSION")).alias("dimensions"),
    )


def counted(items: Column) -> Column:
    """(item, n) of an array, in the order of the first places."""
    return F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("item"), F.size(F.filter(items, lambda y: y == x)).alias("n")))


def listed_7z(output: Column) -> Column:
    """Entries (name, size, packed, dir) of a listing: lines between two rules of dashes with six fields at least; the name is all from the sixth on."""
    parts = F.split(output, r"(?m)^-{19}[^\n]*\n?", -1)
    inside = F.flatten(F.transform(F.filter(parts, lambda p, i: i % 2 == 1), lambda p: F.split(p, "\n")))
    fields = F.filter(F.transform(inside, lambda line: F.split(T.trim_all(line), r"\s+")), lambda part: F.size(part) >= 6)

    def entry(part):
        number = lambda i: F.coalesce(F.regexp_extract(F.get(part, F.lit(i)), r"^(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
        return F.struct(F.array_join(F.slice(part, 6, F.size(part)), " ").alias("name"), number(3).alias("size"), number(4).alias("packed"), F.contains(F.get(part, F.lit(2)), F.lit("D")).alias("dir"))

    return F.transform(fields, entry)
