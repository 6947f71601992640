"""Text functions as column expressions: normalizers, cleaners, classifiers and renderers.

Lower case stands for case folding (they differ on a few letters such as the German sharp s, which ``casefold`` in
``folioscope.functions.unicode`` handles where it matters).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SOFT_HYPHEN, BOM, BAD, NBSP, BULLETS = "­", "﻿", "�", " ", "●•▪‣◦"


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Regular expression replacements, one after the other."""
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def spaces_folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise_text(text: Column) -> Column:
    """Drop invisible characters, make line ends LF, cut trailing blanks, outer blank lines and runs of over two blank lines."""
    clean = F.translate(F.translate(text, SOFT_HYPHEN + BOM + BAD + "\0", ""), NBSP, " ")
    return chain(clean, ("\r\n?", "\n"), ("[ \t\f\x0b]+(\n|$)", "$1"), ("^\n+|\n+$", ""), ("\n{4,}", "\n\n\n"))


def heading_lookup(text: Column) -> Column:
    """Key under which headings are looked up."""
    return F.lower(F.trim(F.regexp_replace(spaces_folded(F.translate(text, "*_`", "")), r"[. ]+$", "")))


def match_key(text: Column) -> Column:
    """Key under which table and callout text is compared: embeds, emphasis and invisible characters do not count."""
    plain = F.translate(F.regexp_replace(text, r"!\[\[[^\]]*\]\]", ""), "*_`" + BOM + SOFT_HYPHEN, "")
    return F.lower(spaces_folded(plain))


def title_key(text: Column) -> Column:
    """Title key without compatibility folding: quotes and dashes made plain, markup dropped, separators tightened."""
    plain = F.translate(text, "‘’“”‐‑‒–—−`*~", "''\"\"------")
    return F.lower(spaces_folded(chain(plain, (r"\s*([_.])\s*", "$1"), (r"(^|\s)_+|_+(\s|$)", "$1$2"))))


def clean_pdf_text(text: Column) -> Column:
    """Text of a page with backspaces, zero-width spaces and broken dashes and apostrophes mended."""
    mended = chain(F.translate(text, "\b​", ""), ("â€[“”]", "–"), ("â€™", "’"))
    return spaces_folded(mended)


def clean_span_text(text: Column) -> Column:
    return F.translate(F.translate(text, SOFT_HYPHEN + BAD, ""), NBSP, " ")


def safe_component(text: Column, fallback: str = "Untitled") -> Column:
    """A name that file systems take."""
    name = F.regexp_replace(spaces_folded(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', " ")), r"[. ]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


_LINK_EDGE = r"(https?:/[^`\s]*/)"


def merge_code_urls(text: Column, passes: int = 8) -> Column:
    """Join adjacent code spans where a URL was cut after a slash."""
    return reduce(lambda t, _: F.regexp_replace(t, rf"`{_LINK_EDGE}`\s*`([A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+)`", "`$1$2`"), range(passes), text)


def merge_plain_urls(text: Column) -> Column:
    """Join a URL that a line end cut after a slash."""
    return F.regexp_replace(text, r"(?i)(https?://(?:[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]*/)?)\n([A-Za-z0-9])", "$1$2")


def number_sort_key(value: Column) -> Column:
    """Numbers first and by value, others after them by lower-case text."""
    number = value.try_cast("int")
    return F.struct(F.coalesce(number, F.lit(1_000_000_000)).alias("number"), F.when(number.isNull(), F.lower(value)).otherwise("").alias("text"))


def page_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def merge_tags(*values: Column) -> Column:
    """Distinct trimmed tags in order; null arrays and blank tags count for nothing."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(*(F.coalesce(v, none) for v in values)), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))


CHAPTER = r"(?i)^\s*chapter\s+([0-9ivxlcdm]+)\s*[:.\-–—]?\s*(.*?)\s*$"


def parse_heading(line: Column, pattern: str = CHAPTER) -> Column:
    """number and title of a chapter heading; null for other lines."""
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("number"), F.regexp_extract(line, pattern, 2).alias("title")))


def is_page_number(text: Column) -> Column:
    """Digits only or letters of roman numerals only, whether or not they make a numeral."""
    return F.trim(text).rlike("^([0-9]+|(?i)[ivxlcdm]+)$")


def is_list_marker(text: Column) -> Column:
    return F.trim(text).rlike(rf"^([-*+{BULLETS}]|[0-9]+[.)])(\s|$)")


def code_language(text: Column) -> Column:
    """Language of a code block by its looks, the first that fits."""
    return (
        F.when(text.rlike(r"#include|\bUPROPERTY\b|\bUFUNCTION\b|::"), "cpp")
        .when(text.rlike(r"(?m)^\s*(\$ |sudo |cd |git |npm |pip )"), "bash")
        .when(text.rlike(r"(?m)^\s*\[[^\]]+\]\s*$"), "ini")
        .when(text.rlike(r"(?m)^\s*#!"), "bash")
        .otherwise("text")
    )


def output_name(pattern: str, number: Column, title: Column, book: Column) -> Column:
    """Fill {number}, {number:02d}, {title} and {book} of a name pattern."""
    padded = F.when(number.try_cast("int").isNotNull(), F.lpad(number, 2, "0")).otherwise(number)
    out = F.lit(pattern)
    for mark, value in (("{number:02d}", padded), ("{number}", number), ("{title}", title), ("{book}", book)):
        out = F.replace(out, F.lit(mark), value)
    return out


def relative_path(target: Column, base: Column) -> Column:
    """Path of target as seen from the folder of base; both are posix paths under one root."""
    to, own = F.split(target, "/"), F.split(base, "/")
    own = F.slice(own, 1, F.size(own) - 1)
    shared = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(to) - 1, F.size(own)), F.lit(1))), lambda i: (i <= F.least(F.size(to) - 1, F.size(own))) & (F.slice(to, 1, i) == F.slice(own, 1, i))), lambda x: x))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(own) - shared), F.slice(to, shared + 1, F.size(to))), "/")


def percent_encoded(path: Column) -> Column:
    """URL-encoded path that keeps slashes; a space is %20."""
    return chain(F.url_encode(path), (r"\+", "%20"), ("%2F", "/"), ("%7E", "~"))


def note_link(path: Column, label: Column, style: str = "wiki") -> Column:
    if style == "wiki":
        return F.concat(F.lit("[["), path, F.lit("|"), label, F.lit("]]"))
    return F.concat(F.lit("["), F.regexp_replace(label, r"([\[\]])", r"\\$1"), F.lit("]("), percent_encoded(path), F.lit(")"))


def heading_without_markup(line: Column) -> Column:
    return spaces_folded(F.regexp_replace(F.translate(line, "*`", ""), r"^\s*#+\s*", ""))


def toc_heading(line: Column) -> Column:
    """A heading whose page number was set off by a backspace becomes ``heading — p. N``."""
    pattern = "^(#+)\\s+(.*?)\\s*\b\\**\\s*\\**([0-9]+)\\**\\s*$"
    body = heading_without_markup(F.regexp_extract(line, pattern, 2))
    return F.when(line.rlike(pattern), F.concat_ws(" ", F.regexp_extract(line, pattern, 1), body, F.lit("— p."), F.regexp_extract(line, pattern, 3))).otherwise(line)


def split_unescaped(text: Column, mark: str) -> Column:
    return F.split(text, rf"(?<!\\){mark}")


def labels_split(label: Column) -> Column:
    """Parts of a label between commas outside parentheses."""
    return F.transform(F.split(label, r",(?![^(]*\))"), lambda x: F.trim(x))


def trailing_bold_space(line: Column) -> Column:
    """No space before a closing ``**``; a span's closing marks are those at odd places."""
    parts = F.split(line, r"(?<!\*)\*\*(?!\*)")
    trimmed = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), F.rtrim(x)).otherwise(x))
    return F.when(F.size(parts) % 2 == 1, F.array_join(trimmed, "**")).otherwise(line)


def broken_emphasis(line: Column, joins: int = 4) -> Column:
    """Bold spans that were cut by a space are joined."""
    # ``**a ** **b`` and ``**a **b**`` around one phrase
    joined = reduce(lambda t, _: F.regexp_replace(t, r"\*\*([^*\s][^*]*?) \*\* ?\*\*([^*\s])", "**$1 $2"), range(joins), line)
    return F.regexp_replace(joined, r"(\*\*[^*\s][^*]*?) \*\*(?=[A-Za-z])", "$1** ")


def shortcut_item(line: Column) -> Column:
    """A list item whose label is a keyboard shortcut gets the label as code."""
    pattern = r"^(\s*[-*+] )[* ]*((?:Ctrl|Alt|Shift|Cmd|F[0-9]{1,2}|[A-Z])(?:[* ]*\+[* ]*[A-Za-z0-9]+)+)[* ]*:[* ]*(.*)$"
    keys = spaces_folded(F.regexp_replace(F.translate(F.regexp_extract(line, pattern, 2), "*", ""), r"\s*\+\s*", " + "))
    return F.when(line.rlike(pattern), F.concat(F.regexp_extract(line, pattern, 1), F.lit("`"), keys, F.lit("`: "), F.regexp_extract(line, pattern, 3))).otherwise(line)


def line_ends(text: Column, crlf: bool) -> Column:
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return F.replace(lf, F.lit("\n"), F.lit("\r\n")) if crlf else lf


def newline_of(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r\n")), "\r\n").otherwise("\n")


# Three escapers of table cells, which differ on purpose.
def cell_with_breaks(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def cell_escaped_once(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"(?<!\\)\|", r"\\|")


def cell_on_one_line(text: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(text, r"(?U)\s+", " "), F.lit("|"), F.lit("\\|")))


def is_monospace(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(8) != 0) | F.lower(font).rlike("mono|courier|consol|code|menlo")


def styled_span(text: Column, font: Column, flags: Column, inline_code: bool = False) -> Column:
    """A span in its marks: flag 16 is bold, flag 2 italic; monospace is code if asked for."""
    inner, lead, tail = F.trim(text), F.regexp_extract(text, r"^(\s*)", 1), F.regexp_extract(text, r"(\s*)$", 1)
    bold = (flags.bitwiseAND(16) != 0) | F.lower(font).contains("bold")
    italic = (flags.bitwiseAND(2) != 0) | F.lower(font).rlike("italic|oblique")
    mark = F.when(bold & italic, "***").when(bold, "**").when(italic, "*").otherwise("")
    if inline_code:
        mark = F.when(is_monospace(font, flags), "`").otherwise(mark)
    return F.when(inner == "", text).otherwise(F.concat(lead, mark, inner, mark, tail))


def contains_word(text: Column, needle: Column) -> Column:
    """Containment; a needle that begins and ends alphanumeric must stand as whole words."""
    edged = needle.rlike(r"(?U)^\w(.*\w)?$")
    found = F.instr(text, needle) > 0
    whole = F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), needle, F.lit(r"\E(?!\w)")))
    return (needle != "") & F.when(edged, found & whole).otherwise(found)


CALLOUTS = {"note": "note", "tip": "tip", "warning": "warning", "important": "important", "caution": "caution", "example": "example", "info": "info", "hint": "tip", "danger": "danger"}


def callout_label(text: Column) -> Column:
    """Callout type of a box's label; a plural is its singular."""
    word = F.lower(F.regexp_replace(F.trim(text), r"[:.!\s]+$", ""))
    known = F.create_map(*(F.lit(x) for kv in CALLOUTS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, word), F.try_element_at(known, F.regexp_replace(word, "s$", "")))


SOURCE_LINE = r"^>?\s*\[?Source PDF, p\. ?([0-9]+)"


def line_kind(line: Column) -> Column:
    """source, image, figure, heading, item, fence, blank or text."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank")
        .when(t.rlike(r"^(```|~~~)"), "fence")
        .when(t.rlike(SOURCE_LINE), "source")
        .when(t.rlike(r"^!\[\[[^\]]+\]\]$|^!\[[^\]]*\]\([^)]+\)$"), "image")
        .when(t.rlike(r"^\*{0,2}Figure [0-9]"), "figure")
        .when(t.rlike(r"^#{1,6} "), "heading")
        .when(t.rlike(r"^([-*+]|[0-9]+[.)]) "), "item")
        .otherwise("text")
    )


def source_page(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, SOURCE_LINE, 1), F.lit("")).cast("int")


def source_url(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"\]\(([^)\s]+)\)", 1), F.lit(""))


def indentation(line: Column) -> Column:
    """Width of the indent, tabs going to the next multiple of four."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    return F.aggregate(F.filter(F.split(lead, ""), lambda c: c != ""), F.lit(0), lambda n, c: F.when(c == "\t", n + 4 - n % 4).otherwise(n + 1))


def iso_date(text: Column) -> Column:
    """A date written exactly as YYYY-MM-DD; null otherwise."""
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(day, "yyyy-MM-dd") == text, day)


def is_revision(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{7,64}$")


def zoned_timestamp(text: Column) -> Column:
    """An ISO-8601 time that names its offset; null otherwise."""
    return F.when(text.rlike(r"T.*(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def is_reliable(left: Column, right: Column) -> Column:
    return ~(F.contains(left, F.lit(BAD)) | F.contains(right, F.lit(BAD)))


DEFINITION = r"^[-*+] (?:\*\* ?)?(?:\*\*)?\*\*([^*]+)\*\*\s*(?:—|–|:)\s*(.*)$"


def definition(line: Column) -> Column:
    """label and description of a definition item; null for other lines."""
    return F.when(line.rlike(DEFINITION), F.struct(F.trim(F.regexp_extract(line, DEFINITION, 1)).alias("label"), F.trim(F.regexp_extract(line, DEFINITION, 2)).alias("description")))


def is_safe_relative(path: Column) -> Column:
    """A relative path without a drive, a scheme, an empty part or a step upward, of at most 4096 characters."""
    return (path != "") & (F.length(path) <= 4096) & ~path.rlike(r"^[/\\~]|^[A-Za-z]:|\x00|(^|/)\.\.(/|$)|//|\\")


def yaml_quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', 1)


def utc_stamp(at: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def table_rows(markdown: Column) -> Column:
    """Cells of a Markdown table's rows without its header and rule; an escaped bar is part of its cell."""
    rows = F.filter(F.split(markdown, "\n"), lambda line: F.trim(line).startswith("|"))
    body = F.filter(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda line: ~F.trim(line).rlike(r"^\|[\s:|-]+\|?$"))
    inner = lambda line: F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(body, lambda line: F.transform(split_unescaped(inner(line), r"\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|")))))


def first_cells(rows: Column) -> Column:
    """Distinct first cells in order."""
    return F.array_distinct(F.transform(rows, lambda r: r[0]))
