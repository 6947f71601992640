"""Worked examples of the operators."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import scalar as s
from folioscope.functions import unicode as u
from folioscope.operators import anchors as an
from folioscope.operators import drift, integrity, layout, links, ranges, repair
from folioscope.operators import lines as ln
from folioscope.sources import changes, frontmatter
from folioscope.sources.tables import markdown_files, stored


def one(spark, make, text):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (s.normalise_text, "\n\nA­ b c  \r\n\n\n\n\nD﻿\n", "A b c\n\n\nD"),
        (s.heading_lookup, "  **My  `Title`**. ", "my title"),
        (s.safe_component, ' a<b>:"c" ... ', "a b c"),
        (s.safe_component, " . ", "Untitled"),
        (s.merge_code_urls, "`https://` `example.com/path`", "`https://example.com/path`"),
        (s.merge_code_urls, "`left/` `right`", "`left/` `right`"),
        (s.merge_plain_urls, "see https://a.com/\nb/c", "see https://a.com/b/c"),
        (s.cell_escaped_once, r"a|b\|c", r"a\|b\|c"),
        (s.cell_with_breaks, "a|b\nc", r"a\|b<br>c"),
        (s.trailing_bold_space, "**a **b", "**a**b"),
        (s.is_page_number, "mix", True),
        (s.is_page_number, "12a", False),
        (s.callout_label, " Notes: ", "note"),
        (s.code_language, "#include <x>", "cpp"),
        (s.code_language, "plain", "text"),
        (s.line_kind, "> Source PDF, p. 14", "source"),
        (s.source_page, "> [Source PDF, p. 14](x.pdf)", 14),
        (s.indentation, "\t  x", 6),
        (s.percent_encoded, "Chapters/Chapter 01.md", "Chapters/Chapter%2001.md"),
        (s.toc_heading, "## **Creating Your First Unreal C++ Game\b** **3**", "## Creating Your First Unreal C++ Game — p. 3"),
        (s.shortcut_item, "- * **Ctrl* + *Shift* + *F*: Searches", "- `Ctrl + Shift + F`: Searches"),
        (s.is_safe_relative, "../x", False),
        (s.is_safe_relative, "a/b.md", True),
        (u.casefold, "Straße", "strasse"),
        (u.nfkc, "ﬁne", "fine"),
        (u.link_targets, r"[PDF](../Book (Author).pdf#page=2) [x](a\)b)", ["../Book (Author).pdf#page=2", "a)b"]),
        (u.declared_version, 'VERSION = "3.4.0"\n', "3.4.0"),
        (u.declared_version, "VERSION = f()\n", None),
        (s.labels_split, "Ctrl + A (x, y), B", ["Ctrl + A (x, y)", "B"]),
    ],
)
def test_scalars(spark, make, text, want):
    assert one(spark, make, text) == want


def test_dates(spark):
    rows = spark.createDataFrame([("2024-02-30",), ("2024-2-3",), ("2024-02-03",), (None,)], "t string").select(s.iso_date(F.col("t")).cast("string").alias("d")).collect()
    assert [r.d for r in rows] == [None, None, "2024-02-03", None]


def test_note_links(spark):
    row = spark.createDataFrame([("Chapters/Chapter 01.md", "Chapter 1")], "p string, l string").select(s.note_link(F.col("p"), F.col("l")).alias("w"), s.note_link(F.col("p"), F.col("l"), "markdown").alias("m"), s.relative_path(F.lit("a/b/c.md"), F.lit("a/x/y.md")).alias("r")).first()
    assert row == ("[[Chapters/Chapter 01.md|Chapter 1]]", "[Chapter 1](Chapters/Chapter%2001.md)", "../b/c.md")


def lines_of(spark, text):
    return ln.explode_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))


def test_blank_collapse(spark):
    text = "Before\n\n\n```cpp\n\n\nint main() {}\n```\n\n\nAfter\n"
    assert ln.join_lines(ln.collapse_blank(lines_of(spark, text))).first().text == "Before\n\n```cpp\n\n\nint main() {}\n```\n\nAfter\n"


def test_matched_fences(spark):
    text = "````\n```\nx\n````\ny\n~~~\n```\n~~~"
    assert [r.in_fence for r in ln.matched_fences(lines_of(spark, text)).orderBy("line_no").collect()] == [False, True, True, True, False, False, True, True]


def test_roman_and_lists(spark):
    assert [r.line for r in ln.roman_footers(lines_of(spark, "mix\n\nxviii\n\n> Source PDF, p. 19")).collect()] == ["xviii"]
    assert [r.line_no for r in ln.unordered_spacing(lines_of(spark, "- a\n\n- b\n  more\n\n- c\n\nplain\n\n- d")).orderBy("line_no").collect()] == [1, 4]
    assert ln.unordered_spacing(lines_of(spark, "- First item\n\nPossible paragraph boundary.\n\n- Second item\n")).count() == 0


def test_tables_and_fences(spark):
    md = "| A | B |\n| --- | :-: |\n| x \\| y | 1 |\n| z |  |\n| z | 2 |"
    row = spark.createDataFrame([(md,)], "t string").select(s.table_rows(F.col("t")).alias("r")).select("r", s.first_cells(F.col("r")).alias("f")).first()
    assert row.r == [["x | y", "1"], ["z", ""], ["z", "2"]] and row.f == ["x | y", "z"]
    text = "a\n```cpp\none\n```\n\n> Source PDF, p. 3\n\n```cpp\ntwo\n```\nb\n```sh\nx\n```\nc"
    assert ln.join_lines(ln.merged_fences(lines_of(spark, text))).first().text == "a\n```cpp\none\ntwo\n```\n> Source PDF, p. 3\nb\n```sh\nx\n```\nc"


def test_definition_tables(spark):
    wrapped = "- **Animation**—brings pages alive\n  and responsive.\n- ** ****Operating system**: Windows 10"
    assert ln.definition_tables(lines_of(spark, wrapped)).first().table_md.split("\n")[2:] == ["| **Animation** | brings pages alive and responsive. |", "| **Operating system** | Windows 10 |"]
    text = "- **Animation**—brings pages alive\n- **Anthropology**: study | of\n\ntext\n\n- **Only one**—stays"
    rows = ln.definition_tables(lines_of(spark, text)).collect()
    assert [(r.first_line, r.n_rows) for r in rows] == [(0, 2)] and "| **Anthropology** | study \\| of |" in rows[0].table_md


def test_callouts(spark):
    text = "**Note:** Keep\nthis.\n\nNote that ordinary prose\n\nTip: do\n## Next"
    assert [(r.callout_type, r.body) for r in ln.callouts(lines_of(spark, text)).orderBy("first_line").collect()] == [("note", "Keep this."), ("tip", "do")]


def test_ranges(spark):
    outline = spark.createDataFrame([(1, 24, "A", 0, 100), (1, 42, "B", 1, 100), (1, 64, "C", 2, 100), (1, 64, "C2", 3, 100)], "doc long, page int, title string, ord int, last int")
    assert sorted((r.start_page, r.end_page, r.title) for r in ranges.chapter_ranges(outline, "doc", "page", "title", "last").collect()) == [(24, 41, "A"), (42, 63, "B"), (64, 100, "C")]
    a = spark.createDataFrame([(1, 10, 5), (1, 30, 6)], "doc_id long, line_no int, page int")
    m = spark.createDataFrame([(1, 8, 5), (1, 11, 5), (1, 25, 6), (1, 25, 6)], "doc_id long, marker_no int, page int")
    assert [(r.line_no, r.marker_no) for r in ranges.nearest_marker(a, m).collect()] == [(10, 8)]


def differences(spark, a, b):
    make = lambda t: an.anchors(spark.createDataFrame([(1, t)], "doc_id long, text string"))
    return [(r.category, r.source_value, r.candidate_value) for r in an.first_differences(make(a), make(b)).collect()]


def test_fidelity(spark):
    assert differences(spark, "foo_v2 uses H264 and build3.2", "foo_v3 uses H265 and build4.2") == []
    assert differences(spark, "It is 0.08 and 1,024 ms", "- It is 0.08\n- and 1,024 ms") == []
    assert differences(spark, "a 1 b 2", "a 2 b 1") == [("numbers", "1", "2")]
    assert differences(spark, "---\na: 1\n---\nx", "---\na: 2\n---\nx")[0][0] == "frontmatter"
    assert differences(spark, "It is good, 5 times", "It is bad, 5 times") == []
    assert differences(spark, "```\nx = 1\n```\n", "```\nx = 2\n```\n") == [("fenced_code", "```\nx = 1\n```", "```\nx = 2\n```")]


def test_fidelity_of_rows(spark):
    texts = ["", "---\na: 1\n---\nx 3", "---\nall front\n---", "It is 5\n```\nx = 1\n```\n[1:02] `c` 7", "~~~\n1\n```\n2", "a 1 b 2 {x}", "a 1 b 2", None]
    pairs = spark.createDataFrame([(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "doc_id long, a string, b string")
    joined = an.first_differences(an.anchors(pairs, text="a"), an.anchors(pairs, text="b"))
    got = sorted(map(str, an.row_differences(pairs, "a", "b").collect()))
    assert got == sorted(map(str, joined.collect())) and len(got) > 40


def test_anchor_lines(spark):
    text = "n 0\n" + "```\n1\n```\n2 `c`\n" * 300 + "```\nopen 9"
    found = an.anchors(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r.line_no for r in found if r.category == "numbers"] == [0, *range(4, 1204, 4)]
    assert [r.line_no for r in found if r.category == "fenced_code"] == [*range(1, 1201, 4), 1201]


def test_links(spark):
    docs = spark.createDataFrame([(1, "[[A|b]] [x](c (d).md) \n[r]: e.md")], "doc_id long, text string")
    assert sorted((r.kind, r.target) for r in links.extract(docs.select("doc_id", F.replace("text", F.lit("c (d)"), F.lit("c(d)")).alias("text"))).collect()) == [("markdown", "c(d).md"), ("reference", "e.md"), ("wiki", "A")]
    files = spark.createDataFrame([("a/x.md",), ("b/y.md",), ("c/y.md",)], "path string")
    asked = spark.createDataFrame([("s", t) for t in ("a/x.md", "a/x", "x", "y", "q", "../x")], "src string, target string")
    got = {r.target: (r.path, r.reason) for r in links.resolve(asked, files).collect()}
    assert got == {"a/x.md": ("a/x.md", None), "a/x": ("a/x.md", None), "x": ("a/x.md", None), "y": (None, "ambiguous"), "q": (None, "missing"), "../x": (None, "escaping")}
    changed = spark.createDataFrame([("src/new.py", "src/old.py"), ("doc/a.md", None)], "path string, previous_path string")
    sources = spark.createDataFrame([("p1", "src/old.py"), ("p2", "src"), ("p3", "doc/b.md")], "page string, source string")
    assert {r.page: r.n_changes for r in links.impact(changed, sources).collect()} == {"p1": 1, "p2": 1}
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "src long, dst long")
    assert {r.node for r in links.cycles(ring, stored).collect()} == {1, 2, 3}
    assert links.cycles(spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long"), stored).isEmpty()
    assert {r.node for r in links.cycles(spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "src long, dst long"), stored).collect()} == {1}
    with pytest.raises(ValueError):
        links.cycles(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"), stored)


def test_integrity(spark):
    schema = "path string, type string, status string, updated string, topic string, verified string, verified_rev string, kind string, task_status string, sources array<string>, source_logs array<string>, supersedes string, body string"
    pages = spark.createDataFrame(
        [("d/ADR-001.md", "decision", "active", "2026-01-01", "t", None, None, None, None, ["a"], None, None, ""), ("d/ADR-1.md", "decision", "active", "2026-01-01", "t", "2020-01-01", None, None, None, ["a"], None, None, ""),
         ("k.md", "knowledge", "active", "2026-10-01", "u", "2020-01-01", None, None, None, [], None, "gone.md", "")], schema)
    found = {(r.rule, r.path) for r in integrity.inspect(pages, F.lit("2026-10-07").cast("date")).collect()}
    assert {("several-active", "d/ADR-001.md"), ("several-active", "d/ADR-1.md"), ("stale", "k.md"), ("no-evidence", "k.md"), ("supersedes-missing", "k.md")} == found
    assert [(r.number, r.n_pages) for r in integrity.duplicate_numbers(pages).collect()] == [(1, 2)]
    calls = spark.createDataFrame([("c", "read", "a", 5), ("c", "read", "a", None), ("c", "write", "b", None)], "`case` string, operation string, path string, characters int")
    assert tuple(integrity.trace_metrics(calls).first()) == ("c", 2, 1, 1, 1, None)


def test_frontmatter(spark):
    text = '---\ntitle: "A: b"\ncount: 3\ntags: ["x", "y"]\nsources:\n  - a.md\n  - "b.md"\ncount: 4\n!bad\n---\nbody'
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = {(r.key, r.line_no): r for r in frontmatter.fields(docs).collect()}
    assert rows["title", 0].value == "A: b" and rows["count", 1].kind == "integer" and rows["tags", 2]["items"] == ["x", "y"]
    assert rows["sources", 3]["items"] == ["a.md", "b.md"] and rows["count", 6].error == "duplicate-key" and rows[None, 7].error == "unreadable"
    assert frontmatter.split(docs).first().body == "body" and docs.select(frontmatter.title(F.col("text"))).first()[0] == "A: b"
    region = spark.createDataFrame([("a<!--b-->x<!--e-->c",), ("none",)], "t string").select(frontmatter.replaced_region(F.col("t"), F.lit("new"), "<!--b-->", "<!--e-->").alias("x")).collect()
    assert [r.x for r in region] == ["a<!--b-->\nnew\n<!--e-->c", None]


def test_changes(spark):
    raw = spark.createDataFrame([("commit", "M\0a\0R090\0b\0c\0D\0d\0"), ("commit", "M\0a\0")], "scope string, raw string")
    assert sorted(tuple(r) for r in changes.changes(raw).orderBy("path").collect()) == sorted([("commit", "modified", "a", None), ("commit", "renamed", "c", "b"), ("commit", "deleted", "d", None)], key=lambda r: r[1])
    bad = spark.createDataFrame([("s", x) for x in ("M\0a", "R100\0a\0", "Z\0a\0", "M1234\0a\0", "M\0a\0B\0b\0", "")] + [("untracked", "x\0M\0")], "scope string, raw string")
    assert sorted(r.error for r in changes.change_errors(bad).collect()) == ["truncated_git_change_record", "unsupported_git_change_record", "unterminated_git_path_list"]
    assert {tuple(r) for r in changes.changes(bad).collect()} == {("s", "modified", "a", None), ("s", "broken_pair", "b", None), ("untracked", "untracked", "x", None), ("untracked", "untracked", "M", None)}
    index = spark.createDataFrame([("100644 abc 0\tx y\x00100644 def 1\tz\x00",)], "raw string")
    assert {r.path: len(r.entries) for r in changes.index_entries(index).collect()} == {"x y": 1, "z": 1}


def test_rollback(spark):
    backup = spark.createDataFrame([("a", "h0", "h1"), ("b", "h0", "h1")], "path string, before_sha256 string, after_sha256 string")
    created = spark.createDataFrame([("c", "h1")], "path string, after_sha256 string")
    current = spark.createDataFrame([("a", "h1"), ("b", "changed"), ("c", "h1")], "path string, current_sha256 string")
    assert {r.path: r.action for r in drift.rollback_plan(backup, created, current).collect()} == {"a": "restore", "b": "refuse", "c": "delete"}


REPAIRS = [
    ("The **Desktop ** **development with C++ **group is one phrase.", "The **Desktop development with C++** group is one phrase."),
    ("**Operator** **Operation** labels", "**Operator** **Operation** labels"),
    ("1. First step\n\n2. Second step\n\n3. Third step", "1. First step\n2. Second step\n3. Third step"),
    ("- * **Ctrl* + *Shift* + *F*: Searches", "- `Ctrl + Shift + F`: Searches"),
    ("## **Creating Your First Unreal C++ Game\b** **3**", "## Creating Your First Unreal C++ Game — p. 3"),
    ("text\n\nxviii\n\n> Source PDF, p. 19", "text\n\n> Source PDF, p. 19"),
    ("> [Source PDF, p. 14](a.pdf)\n# Preface\n> [Source PDF, p. 14](a.pdf)\ntext\n> Source PDF, p. 15", "> Source PDF, p. 14\n# Preface\ntext\n> Source PDF, p. 15"),
    ("**Note** Keep this.\n\nNote that prose stays.", "> [!note] Note\n> Keep this.\n\nNote that prose stays."),
    ("**Note**\n\nOne.\n\nTwo.\n\n## Next", "> [!note] Note\n>\n> One.\n>\n> Two.\n\n## Next"),
    ("- First item\n\nPossible paragraph boundary.\n\n- Second item\n", "- First item\n\nPossible paragraph boundary.\n\n- Second item\n"),
    ("- a\n\n- b\n  wrapped\n\n- c", "- a\n- b\n  wrapped\n- c"),
    ("# Part One\n\n## *Part one.*\ntext", "# Part One\n\ntext"),
    ("---\ntitle: My Book\n---\nMy Book 12\n\ntext", "---\ntitle: My Book\n---\n\ntext"),
    ("see `https://` `example.com/path`", "see `https://example.com/path`"),
    ("a\r\n\r\n\r\nb", "a\r\n\r\nb"),
]


@pytest.mark.parametrize(("text", "want"), REPAIRS)
def test_repair(text, want):
    new, _ = repair.repair_text(text)
    assert new == want
    assert repair.repair_text(new) == (new, [])


def test_repair_corpus(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REPAIRS)] + [(99, None)], "doc_id long, text string")
    out = repair.repair(docs)
    assert {r.doc_id: r.repaired for r in out.collect()} == {i: w for i, (_, w) in enumerate(REPAIRS)} | {99: ""}
    assert repair.totals(out).first().n_files == len(REPAIRS) + 1


def span(text, x0, y0, x1, size=10.0, font="Serif", flags=0):
    return {"text": text, "bbox": [float(v) for v in (x0, y0, x1, y0 + size)], "size": float(size), "font": font, "flags": flags}


def block(*lines):
    rows = [{"bbox": [min(x["bbox"][0] for x in l), l[0]["bbox"][1], max(x["bbox"][2] for x in l), l[0]["bbox"][3]], "spans": list(l)} for l in lines]
    return {"bbox": rows[0]["bbox"], "lines": rows}


def page(spark, *blocks, n=1):
    return spark.createDataFrame([(1, n, 600.0, 800.0, list(blocks))], layout.PAGES_SCHEMA)


def test_layout(spark):
    p = page(
        spark, block([span("Running", 50, 20, 120, 14)]), block([span("A heading", 50, 100, 200, 18)]), block([span("Text that", 50, 200, 100), span("goes on.", 103, 200, 150)]),
        block([span("int main() {", 50, 300, 200, font="Mono")], [span("}", 50, 312, 60, font="Mono")]), block([span("12", 300, 780, 310)]),
    )
    rows = layout.without_page_numbers(layout.entries(p), p)
    assert [(r.kind, r.level, r.text) for r in rows.orderBy("y0").collect()] == [("header", None, "Running"), ("heading", 3, "A heading"), ("text", None, "Text that goes on."), ("code", None, "int main() {\n}")]
    events = spark.createDataFrame([(1, 1, 250.0, 50.0, 0, "![[image]]")], "doc long, page int, y0 double, x0 double, priority int, markdown string")
    assert layout.rendered(rows, events).first().text == "### A heading\n\nText that goes on.\n\n![[image]]\n\n```text\nint main() {\n}\n```"
    boxes = layout.line_boxes(page(spark, block([span("left", 50, 100, 80)]), block([span("right", 90, 100.5, 120)]), block([span("far", 400, 100, 420)])))
    assert sorted(r.text for r in boxes.collect()) == ["far", "left right"]
    assert layout.probe(p).first().likely_scanned is False


def test_tables(spark):
    ys, xs = [100.0, 120.0, 140.0], [50.0, 150.0, 250.0, 350.0]
    draw = [(1, 1, 50.0, y, 350.0, y) for y in ys] + [(1, 1, x, 100.0, x, 140.0) for x in xs] + [(1, 1, 0.0, 0.0, 5.0, 5.0)]
    p = page(spark, *(block([span(t, xs[c] + 5, ys[r] + 5, xs[c] + 40)]) for r, row in enumerate([["Name", "Kind", "Use"], ["Compiler", "tool", ""]]) for c, t in enumerate(row) if t))
    segments = layout.grid_segments(spark.createDataFrame(draw, "doc long, page int, ax double, ay double, bx double, by double"))
    runs = layout.grid_runs(layout.grid_boundaries(segments, p), segments)
    tables = layout.discovered_tables(layout.grid_cells(runs, layout.grid_columns(runs, segments), layout.line_boxes(p)))
    row = layout.merged_tables(tables).first()
    assert (row.headers, row.rows) == (["Name", "Kind", "Use"], [["Compiler", "tool", ""]])
    assert tables.select(layout.table_markdown(F.col("headers"), F.col("rows")).alias("m")).first().m == "| Name | Kind | Use |\n| --- | --- | --- |\n| Compiler | tool |  |"


def test_boxes_and_images(spark):
    lines = spark.createDataFrame([(1, 1, 60.0, 102.0, 200.0, 112.0, "Tip:"), (1, 1, 60.0, 114.0, 250.0, 124.0, "Do it."), (1, 1, 60.0, 300.0, 500.0, 314.0, "line")], "doc long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame([(1, 1, 7, 50.0, 100.0, 300.0, 130.0, True, False), (1, 1, 8, 50.0, 100.0, 90.0, 130.0, True, False)], "doc long, page int, box int, x0 double, y0 double, x1 double, y1 double, curved boolean, filled boolean")
    assert [tuple(r)[3:] for r in layout.callout_boxes(boxes, lines).collect()] == [("Tip:", "tip", "Do it.", "converted", None)]
    images = spark.createDataFrame([(1, 1, 1, 180.0, 301.0, 190.0, 313.0), (1, 1, 2, 100.0, 400.0, 180.0, 480.0)], "doc long, page int, image int, x0 double, y0 double, x1 double, y1 double")
    assert {r.image: r.role for r in layout.image_roles(images, lines).collect()} == {1: "inline-icon", 2: "clear-block"}


def test_file_scan(spark, tmp_path):
    for name, text in (("a.md", "﻿A"), ("sub/b.md", "B"), ("file/c.md", "C"), (".obsidian/d.md", "D"), ("e.txt", "E")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    assert sorted(tuple(r) for r in markdown_files(spark, str(tmp_path)).collect()) == [("a.md", "A", True), ("sub/b.md", "B", False)]
    assert markdown_files(spark, str(tmp_path), ["a.md"]).count() == 1


def test_reports(spark):
    chapters = spark.createDataFrame([("b", 2, "P1", "c2.md", "Two"), ("b", 1, "P1", "c1.md", "One"), ("b", 3, None, "c3.md", "Three")], "book string, ord int, part string, path string, title string")
    from folioscope.operators import report

    assert report.contents_map(chapters).first().contents == "## P1\n\n- [[c1.md|One]]\n- [[c2.md|Two]]\n\n- [[c3.md|Three]]"
    heads = spark.createDataFrame([("a", "Beta", 2), ("a", "beta", 3), ("b", "Alpha", 4), ("b", "Top", 1)], "path string, title string, level int")
    assert [(r.key, r.path) for r in report.topics(heads).collect()] == [("alpha", "b"), ("beta", "a")]
    assert report.todo_counts(lines_of(spark, "# Next\n- [ ] a\n- [x] b\n# Done\n- [ ] c"), ["next"]).first().n_open == 1
    words = [("Part I", 50.0), ("1. Start", 50.0), ("First section 12", 60.0), ("Index", 50.0)]
    rows = [(1, 1, b, 0, i, x + 120.0 * (w.isdigit()), w) for b, (t, x) in enumerate(words) for i, w in enumerate(t.split())]
    tree = report.toc_tree(report.toc_outline(spark.createDataFrame(rows, "doc long, page int, block_no int, line_no int, word_no int, x0 double, text string"))).orderBy("block_no").collect()
    assert [(r.kind, r.title, r.print_page, r.part, r.chapter) for r in tree] == [("part", "Part I", None, "Part I", None), ("chapter", "1. Start", None, "Part I", "1. Start"), ("section", "First section", 12, "Part I", "1. Start"), ("back", "Index", None, "Part I", None)]


def test_structure(spark):
    from folioscope.operators import structure

    notes = spark.createDataFrame([("n1", "intro\nName Kind\nUse\nCompiler builds\nLinker links\n\n## Next", 1, 5), ("n2", "| A | B |", 6, 9)], "path string, text string, start_page int, end_page int")
    tables = spark.createDataFrame([(1, 2, ["Name", "Kind", "Use"], [["Compiler", "x"], ["Linker", "y"]], "| Name | Kind | Use |"), (2, 7, ["A", "B"], [["1", "2"]], "| A | B |"), (3, 50, ["Z"], [["z"]], "zz"), (4, 3, ["Gone"], [["z"]], "zz")], "table_id long, page int, headers array<string>, rows array<array<string>>, markdown string")
    owned = structure.owners(tables, notes)
    got = {r.table_id: (r.status, r.start_line, r.end_line) for r in structure.located(owned, notes.select("path", "text")).where("table_id is not null").collect()}
    assert got == {1: ("located", 1, 5), 2: ("present", None, None), 4: ("uncertain", None, None)}
    pairs = structure.figure_pairs(lines_of(spark, "> Source PDF, p. 3\n\n![[a.png]]\n\nFigure 1. A\n"))
    assert tuple(pairs.first()) == (1, 2, "![[a.png]]", "Figure 1. A", 3)
    moved = pairs.withColumn("page", F.lit(4))
    assert structure.compare_figures(moved, pairs).first().outcome == "moved" and structure.compare_figures(pairs, pairs).first().outcome == "unchanged"
    tools = spark.createDataFrame([("a", "h1", "3.4.0"), ("b", "h", "3.9.0")], "path string, sha256 string, version string")
    other = spark.createDataFrame([("a", "h2", "3.10.0"), ("b", "h", "3.9.0"), ("c", "h", "1.0.0")], "path string, sha256 string, version string")
    assert {r.path: (r.content, r.version) for r in structure.tool_versions(tools, other).collect()} == {"a": ("different", "older"), "b": ("same", "same"), "c": ("not_comparable", None)}


def test_figures_in_repair():
    text = "> Source PDF, p. 3\n\n![[a.png]]\nFigure 1. A\n\nend"
    new, log = repair.repair_text(text)
    assert new == "![[a.png]]\n\nFigure 1. A\n\n> Source PDF, p. 3\n\nend" and [k for k, _, _ in log] == ["figure-source"]
    assert repair.repair_text(new) == (new, [])


def test_sinks(spark, tmp_path):
    from folioscope.sources import sinks

    files = spark.createDataFrame([("a", "x", "x")], "path string, text string, content string").withColumn("sha256", F.sha2("content", 256))
    sinks.write_snapshot(files.select("path", "content", "sha256"), str(tmp_path / "s"), "one")
    assert sinks.read_snapshot(spark, str(tmp_path / "s"), "one").first().is_readable
    preview = spark.createDataFrame([("a", "new"), ("b", "made")], "path string, text string").withColumn("original_sha256", F.when(F.col("path") == "a", F.sha2(F.lit("x"), 256)))
    current = files.select("path", "text")
    assert {tuple(r) for r in sinks.merged(current, preview).collect()} == {("a", "new"), ("b", "made")}
    drifted = spark.createDataFrame([("a", "edited by hand")], "path string, text string")
    assert {tuple(r) for r in sinks.merged(drifted, preview).collect()} == {("a", "edited by hand")}


def test_stream(spark, tmp_path):
    from folioscope.streaming import drift_stream

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", "chapter", "x"), ("b", "chapter", "y")], "path string, kind string, text string").write.parquet(source)
    manifest = spark.createDataFrame([("a", "chapter", "zz", True)], "path string, kind string, after_sha256 string, marker boolean")
    stream = spark.readStream.schema("path string, kind string, text string").parquet(source)
    drift_stream.watch(stream, lambda: manifest, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.path, r.action) for r in spark.read.parquet(f"{out}/0").collect()} == {("a", "update"), ("b", "create")}


def test_knowledge(spark):
    from folioscope.operators import knowledge as k

    docs = spark.createDataFrame([(1, "a `x` b\n```\n[l](c)\n```\n<!-- [m](n) --> end ``y`z``")], "doc_id long, text string")
    assert k.without_code(docs).first().text == "a  b\n end "
    hooks = spark.createDataFrame([(1, "<b>x<e>"), (2, "<e>x<b>"), (3, "read memory first"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.status for r in k.hook_status(hooks, "<b>", "<e>", "read memory").collect()} == {1: "managed", 2: "invalid", 3: "legacy", 4: "missing"}
    pages = spark.createDataFrame([("a", "active", "abcdef1", ["src"]), ("b", "active", "abcdef2", []), ("c", "archived", None, ["src"]), ("d", "active", "zzz", ["src/x.py"]), ("e", "active", "abcdef9", ["other"])], "path string, status string, verified_rev string, sources array<string>")
    revisions = spark.createDataFrame([("abcdef1", "c1"), ("abcdef2", "c2"), ("main", "c1")], "name string, commit string")
    changed = spark.createDataFrame([("src/x.py", None), ("src/x.py", None)], "path string, previous_path string")
    got = {(r.path, r.n_changes, r.assessment, r.baseline) for r in k.impact_report(changed, pages, revisions, "main").collect()}
    assert got == {("a", 1, "affected", "matches_base"), ("b", 0, "unassessable", "differs_from_base"), ("d", 1, "affected", "invalid")}
    assert {r.baseline for r in k.baselines(pages, revisions, "main").where("path in ('c', 'e')").collect()} == {"missing", "unresolved"}
    typed = spark.createDataFrame([("m", "moc"), ("p", "knowledge"), ("q", "log")], "path string, type string")
    assert [r.path for r in k.uncovered(typed, spark.createDataFrame([("m", "p"), ("p", "q")], "src string, path string")).collect()] == ["q"]
    logs = spark.createDataFrame([("logs/bug/a.md", "log", "bug"), ("logs/ui/b.md", "log", "bug"), ("x.md", "log", None)], "path string, type string, kind string")
    assert {r.path: r.issue for r in k.log_layout(logs, {"bug": "logs/bug"}).collect()} == {"logs/ui/b.md": "log-in-other-folder", "x.md": "log-without-kind"}
    sections = spark.createDataFrame([("a", "1", "5"), ("b", "6", None), ("c", "9", "3"), ("d", "x", "3"), ("e", "9", "11")], "section_id string, start_page string, end_page string")
    assert {r.section_id: r.error for r in k.checked_sections(sections, F.lit(10)).collect()} == {"a": None, "b": None, "c": "bad-range", "d": "not-a-page", "e": "beyond-last-page"}
    source = spark.createDataFrame([("b", "chapter", "t", "s.pdf", "h", 1, 2, {"title": "no", "more": "yes"})], "book string, kind string, title string, source_path string, source_hash string, start_page int, end_page int, extra map<string,string>")
    row = k.provenance(source, "g", ["book", "chapter"]).first()
    assert row.fields["title"] == "t" and row.fields["more"] == "yes" and row.fields["source_pages"] == "[1, 2]" and row.tags == ["book", "chapter"]
    entries = spark.createDataFrame([("d", 1, "P", "C", "First section", "c.md"), ("d", 2, "P", "C", "Gone", "c.md")], "doc string, ord int, part string, chapter string, title string, path string")
    heads = spark.createDataFrame([("c.md", "First  Section.")], "path string, title string")
    assert k.toc_text(entries, heads).first().text == "## P\n### C\n- [[c.md#First  Section.|First section]]\n- Gone"
    lines = spark.createDataFrame([(1, 1, 50.0, 100.0, 90.0, 110.0, "Press "), (1, 1, 105.0, 100.4, 150.0, 110.0, "now"), (1, 1, 300.0, 100.0, 350.0, 110.0, "far")], "doc long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    icon = spark.createDataFrame([(1, 1, 92.0, 101.0, 103.0, 109.0, "![[i.png]]")], "doc long, page int, x0 double, y0 double, x1 double, y1 double, embed string")
    assert sorted(r.text for r in k.fragments_joined(lines, icon).collect()) == ["Press ![[i.png]] now", "far"]
