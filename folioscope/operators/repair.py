"""The repair of a Markdown text: ordered passes over its lines with a log of changes.

The passes depend on each other's results, so a document is repaired as a whole. Each pass takes the lines and returns new
ones, and logs what it did as (kind, before, after). Running a repair again changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Log = list[tuple[str, str, str]]

_SOURCE = re.compile(r"^>?\s*\[?Source PDF, p\. ?(\d+)\]?(?:\(([^)]*)\))?\s*$")
_HEADING = re.compile(r"^(#{1,6}) +(.*)$")
_ITEM = re.compile(r"^([ \t]*)([-*+]) +(\S.*)$")
_ORDERED = re.compile(r"^([ \t]*)\d+[.)] +\S")
_ROMAN = re.compile(r"^[ivxlcdmIVXLCDM]+$")
_KEYS = re.compile(r"^(\s*[-*+] )[* ]*((?:Ctrl|Alt|Shift|Cmd|Tab|Esc|F\d{1,2}|[A-Z])(?:[* ]*\+[* ]*[A-Za-z0-9]+)*)[* ]*:[* ]*(.+)$")
_TOC = re.compile(r"^(#{1,6}) +(.*?)\s*\x08[* ]*(\d+)[* ]*$")
_LABEL = re.compile(r"^\*\*(Note|Tip|Warning|Important|Caution|Example|Info)(?::\*\*|\*\*:?)\s*(.*)$|^(Note|Tip|Warning|Important|Caution|Example|Info):\s+(.*)$")


def _fences(lines: list[str]) -> list[bool]:
    """Whether each line is a fence or inside of one."""
    inside, out = False, []
    for line in lines:
        fence = line.lstrip().startswith(("```", "~~~"))
        out.append(inside or fence)
        inside ^= fence
    return out


def _key(title: str) -> str:
    return re.sub(r"[. ]+$", "", " ".join(re.sub(r"[*_`]", "", title).split())).lower()


def _each(lines: list[str], log: Log, kind: str, change) -> list[str]:
    out = []
    for line, kept in zip(lines, _fences(lines), strict=True):
        new = line if kept else change(line)
        if new != line:
            log.append((kind, line, new))
        out.append(new)
    return out


def _without(lines: list[str], log: Log, kind: str, drop: set[int]) -> list[str]:
    log += [(kind, lines[i], "") for i in sorted(drop)]
    return [x for i, x in enumerate(lines) if i not in drop]


def chrome(lines: list[str], log: Log, title: str) -> list[str]:
    """Running headers: the title and a page number."""
    head = re.compile(rf"^\s*{re.escape(title.strip())}\s+\d+\s*$", re.I) if title.strip() else None
    return _without(lines, log, "page-chrome", {i for i, x in enumerate(lines) if head and head.match(x)})


def roman(lines: list[str], log: Log) -> list[str]:
    drop = set()
    for i, x in enumerate(lines):
        if _ROMAN.match(x.strip()):
            after = next((y for y in lines[i + 1 : i + 4] if y.strip()), "")
            if _SOURCE.match(after):
                drop.add(i)
    return _without(lines, log, "roman-page-number", drop)


def toc(line: str) -> str:
    m = _TOC.match(line)
    if not m:
        return line
    return f"{m[1]} {' '.join(re.sub(r'[*`]', '', m[2]).split())} — p. {m[3]}"


def shortcut(line: str) -> str:
    m = _KEYS.match(line)
    if not m or "+" not in m[2]:
        return line
    return f"{m[1]}`{' + '.join(k.strip(' *') for k in m[2].split('+'))}`: {m[3].strip()}"


def emphasis(line: str) -> str:
    """Bold spans that a cut has split are joined when only white space stands between and the first ends or the second begins
    with it; a space before a closing mark goes outside."""
    parts = re.split(r"(?<!\*)\*\*(?!\*)", line)
    if len(parts) % 2 == 0 or len(parts) < 3:
        return line
    for _ in range(4):
        for i in range(1, len(parts) - 2, 2):
            if not parts[i + 1].strip() and (parts[i] != parts[i].rstrip() or parts[i + 2] != parts[i + 2].lstrip()):
                parts[i : i + 3] = [f"{parts[i].rstrip()} {parts[i + 2].lstrip()}"]
                break
        else:
            break
    for i in range(1, len(parts), 2):
        inner = parts[i].rstrip()
        if inner and inner != parts[i]:
            parts[i] = inner
            if parts[i + 1] and not parts[i + 1][0].isspace():
                parts[i + 1] = " " + parts[i + 1]
    return "**".join(parts)


def callouts(lines: list[str], log: Log) -> list[str]:
    """A labelled paragraph and the prose behind it, up to a structural line or another label, as a callout."""
    out, i, masked = [], 0, _fences(lines)
    stop = lambda x: bool(re.match(r"^\s*(#{1,6} |[-*+] |\d+[.)] |>|\||```|~~~|!\[)", x))
    while i < len(lines):
        m = None if masked[i] else _LABEL.match(lines[i])
        if not m:
            out.append(lines[i])
            i += 1
            continue
        kind, first = (m[1] or m[3]), (m[2] if m[1] else m[4]) or ""
        body, j = [first] if first else [], i + 1
        while j < len(lines) and not masked[j] and not stop(lines[j]) and not _LABEL.match(lines[j]):
            if lines[j].strip() or (any(x.strip() for x in lines[j : j + 2]) and not first):
                body.append(lines[j])
            elif first or not any(x.strip() and not stop(x) for x in lines[j : j + 2]):
                break
            j += 1
        while body and not body[-1].strip():
            body.pop()
            j -= 1
        new = [f"> [!{kind.lower()}] {kind}", *(f"> {x}".rstrip() for x in body)]
        log.append(("callout", "\n".join(lines[i:j]), "\n".join(new)))
        out += new
        i = j
    return out


def references(lines: list[str], log: Log) -> list[str]:
    plain = lambda x: f"> Source PDF, p. {m[1]}" if (m := _SOURCE.match(x)) and m[2] is not None else x
    return _each(lines, log, "source-reference-style", plain)


_IMAGE = re.compile(r"^!\[\[[^\]]+\]\]$|^!\[[^\]]*\]\([^)]+\)$")
_FIGURE = re.compile(r"^\*{0,2}Figure \d")


def figures(lines: list[str], log: Log) -> list[str]:
    """An image, its caption (up to three lines on) and its source line (up to three lines before the image, or four behind the
    caption) in this order, a blank line between. Figures with sources on both sides stay as they are."""

    def near(start: int, step: int, reach: int) -> int | None:
        for j in range(start + step, start + step * (reach + 1), step):
            if 0 <= j < len(lines) and lines[j].strip():
                return j
        return None

    i = 0
    while i < len(lines):
        if _IMAGE.match(lines[i].strip()) and not _fences(lines)[i]:
            c, a = near(i, 1, 3), near(i, -1, 3)
            if c is not None and _FIGURE.match(lines[c]):
                b = near(c, 1, 4)
                before = a is not None and bool(_SOURCE.match(lines[a]))
                behind = b is not None and bool(_SOURCE.match(lines[b]))
                if before != behind:
                    first, last, source = (a, c, a) if before else (i, b, b)
                    new = [lines[i], "", lines[c], "", lines[source]]
                    if lines[first : last + 1] != new:
                        log.append(("figure-source", "\n".join(lines[first : last + 1]), "\n".join(new)))
                        lines = lines[:first] + new + lines[last + 1 :]
                    i = first + len(new)
                    continue
        i += 1
    return lines


def repeated_references(lines: list[str], log: Log) -> list[str]:
    """A source line of the same page as the one before, with headings and blanks alone between."""
    drop, page, heads, other = set(), None, 0, False
    for i, x in enumerate(lines):
        m = _SOURCE.match(x)
        if m:
            if page == m[1] and heads and not other:
                drop.add(i)
            else:
                page = m[1]
            heads, other = 0, False
        elif _HEADING.match(x):
            heads += 1
        elif x.strip():
            other = True
    return _without(lines, log, "repeated-source-reference", drop)


def leading_heading(lines: list[str], log: Log) -> list[str]:
    heads = [i for i, x in enumerate(lines[:16]) if _HEADING.match(x)]
    if len(heads) > 1:
        a, b = heads[:2]
        quiet = all(not x.strip() or _SOURCE.match(x) for x in lines[a + 1 : b])
        if quiet and _key(_HEADING.match(lines[a])[2]) == _key(_HEADING.match(lines[b])[2]):
            return _without(lines, log, "repeated-heading", {b})
    return lines


def ordered_spacing(lines: list[str], log: Log) -> list[str]:
    drop = set()
    for i in range(1, len(lines) - 1):
        a, b = _ORDERED.match(lines[i - 1]), _ORDERED.match(lines[i + 1])
        if not lines[i].strip() and a and b and len(a[1]) == len(b[1]):
            drop.add(i)
    return _without(lines, log, "ordered-list-spacing", drop)


def unordered_spacing(lines: list[str], log: Log) -> list[str]:
    """Blanks before the next item of the same indent, when the item's own lines are plain continuations."""
    drop, masked = set(), _fences(lines)
    width = lambda x: len(re.match(r"[ \t]*", x)[0].expandtabs(4))
    for i, x in enumerate(lines):
        m = None if masked[i] else _ITEM.match(x)
        if not m:
            continue
        blanks, j = [], i + 1
        while j < len(lines) and not _ITEM.match(lines[j]):
            if not lines[j].strip():
                blanks.append(j)
            elif blanks or width(lines[j]) <= width(x) or masked[j] or re.match(r"^\s*(#{1,6} |>|\||\d+[.)] )", lines[j]):
                blanks = []
                break
            j += 1
        if j < len(lines) and (n := _ITEM.match(lines[j])) and width(n[1]) == width(m[1]):
            drop |= set(blanks)
    return _without(lines, log, "unordered-list-spacing", drop)


def blanks(lines: list[str], log: Log) -> list[str]:
    inside, drop = False, set()
    for i, x in enumerate(lines):
        if x.lstrip().startswith("```"):
            inside = not inside
        elif not inside and not x.strip() and i and not lines[i - 1].strip():
            drop.add(i)
    return _without(lines, log, "blank-lines", drop)


def code_urls(line: str) -> str:
    """Adjacent code spans where the first is a URL that ends at an edge."""
    join = re.compile(r"`(https?:(?://)?[^`\s]*(?<=[/?&=#\-.:]))`\s*`([A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+)`")
    while (new := join.sub(r"`\1\2`", line, count=1)) != line:
        line = new
    return line


def repair_text(text: str, title: str = "") -> tuple[str, Log]:
    """The repaired text and the log. Frontmatter and line ends stay as they are."""
    newline = "\r\n" if "\r\n" in text else "\n"
    head = re.match(r"\A---\r?\n.*?\r?\n---(?:\r?\n|\Z)", text, re.S)
    front, body = (text[: head.end()], text[head.end() :]) if head else ("", text)
    if not title and head and (m := re.search(r"^title:\s*[\"']?(.*?)[\"']?\s*$", front, re.M)):
        title = m[1]
    log: Log = []
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = roman(chrome(lines, log, title), log)
    for kind, change in (("toc-heading", toc), ("shortcut", shortcut), ("emphasis", emphasis)):
        lines = _each(lines, log, kind, change)
    for step in (callouts, references, figures, repeated_references, leading_heading, ordered_spacing, unordered_spacing, blanks):
        lines = step(lines, log)
    lines = _each(lines, log, "code-url", code_urls)
    return front + newline.join(lines), log


#: Fixed value: characters of repaired texts and their changes after which a worker hands on what it has.
HANDED_ON = 1 << 20

_CHANGES = pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "before", "after")]))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, original_sha256 and text with repaired and changes for the text. Those that come in hold up to 10,000
    documents, those that go out a few: as Python objects all of them would take many times their texts."""
    for batch in batches:
        done, held, at = [], 0, 0
        for n, text in enumerate(batch.column("text"), 1):
            new, log = repair_text(text.as_py() or "")
            done.append((new, log))
            held += len(new) + sum(len(before) + len(after) for _, before, after in log)
            if held >= HANDED_ON or n == batch.num_rows:
                kept = batch.slice(at, n - at)
                arrays = [kept.column("doc_id"), kept.column("original_sha256"), pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], _CHANGES)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "original_sha256", "repaired", "changes"])
                done, held, at = [], 0, n


def repair(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, original_sha256, repaired_sha256, repaired, changed and changes (kind, before, after) of every document."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("original_sha256"), F.col(text).alias("text"))
    found = rows.mapInArrow(_repaired, "doc_id string, original_sha256 string, repaired string, changes array<struct<kind:string,before:string,after:string>>")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "original_sha256", F.sha2("repaired", 256).alias("repaired_sha256"), "repaired",
        (F.size("changes") > 0).alias("changed"), "changes",
    )


def totals(repaired: DataFrame) -> DataFrame:
    """Files, changed files and changes, over the corpus."""
    return repaired.agg(F.count(F.lit(1)).alias("n_files"), F.count_if("changed").alias("n_changed"), F.coalesce(F.sum(F.size("changes")), F.lit(0)).alias("n_changes"))
