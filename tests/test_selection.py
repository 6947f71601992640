import difflib
import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioscope.operators import anchors, selection
from folioscope.plans import catalog, views
from folioscope.sources import evidence, settings, tables

SF = "/root/testdata/sf0.001"


def test_settings(spark):
    good = {"schema_version": 2, "mode": "lite", "read_budget": {"page_chars": 0}, "moc_defaults": {"kind": "x"}}
    bad = [[], {}, good | {"schema_version": True}, good | {"schema_version": 3}, good | {"mode": "x"}, good | {"link_style": "x"}, good | {"read_budget": {"page_chars": True}}, good | {"read_budget": {"x": 1}}]
    bad += [good | {"read_budget": {"page_chars": -1}}, good | {"moc_defaults": {"kind": " "}}, good | {"moc_defaults": {"x": "a"}}]
    raw = spark.createDataFrame([(0, json.dumps(good)), (1, "﻿" + json.dumps(good)), (2, None), (3, "{")] + [(10 + i, json.dumps(x)) for i, x in enumerate(bad)], "i int, raw string")
    got = {r.i: r.s for r in raw.select("i", settings.settings(F.col("raw")).alias("s")).collect()}
    assert got[0] == got[1] and (got[0].page_chars, got[0].todo_items, got[0].link_style, got[0].kind, got[0].error) == (0, 20, "wiki", "x", None)
    assert got[2].mode is None and got[2].error is None and all(got[i].error for i in got if i > 2)


def test_options():
    assert settings.option("boxed_callout_policy", None) == "auto" and settings.option("inline_image_policy", " Block ") == "block"
    assert settings.stages({"tables": True, "moc": 1}) == ["chapterize", "tables", "moc"] and settings.stages({}) == []
    assert settings.stages({}, "moc, sections,moc") == ["chapterize", "moc", "sections"]
    assert settings.regions({"visual_tables": {"enabled": True, "regions": [{"page": 1}, 3]}}) == [{"page": 1}] and settings.regions({"visual_tables": {"regions": [{}]}}) == []
    for wrong in (lambda: settings.option("boxed_callout_policy", "x"), lambda: settings.stages({}, "x"), lambda: settings.chosen(" , ")):
        with pytest.raises(ValueError):
            wrong()


def test_selected(spark):
    rows = spark.createDataFrame([("1",), ("02",), ("A",), ("10",)], "number string")
    names = lambda said: sorted(r.number for r in selection.selected(rows, "number", said).collect())
    assert names(None) == ["02", "1", "10", "A"] and names("2, a,001") == ["02", "1", "A"]
    with pytest.raises(ValueError, match="not found: 7, b"):
        names("1,7,b")


def test_separator_reasons(spark):
    cases = [
        ([], 0, None), (["  more text"], 0, None), (["", "  more"], 0, selection.INNER_BLANK), (["", "more"], 0, selection.INNER_AMBIGUOUS), (["  ```"], 0, selection.STRUCTURED), (["  > q", "x"], 0, selection.STRUCTURED),
        (["  - sub"], 0, selection.NESTED[False]), (["  1. sub"], 0, selection.NESTED[True]), (["flat"], 0, selection.AMBIGUOUS), (["  a", "flat", "  - b"], 0, selection.AMBIGUOUS), (["  ![[x]]"], 0, selection.STRUCTURED),
    ]
    df = spark.createDataFrame([(i, b, n) for i, (b, n, _) in enumerate(cases)], "i int, body array<string>, base int")
    got = {r.i: r.r for r in df.select("i", selection.separator_reason(F.col("body"), F.col("base")).alias("r")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_captions(spark):
    df = spark.createDataFrame([("Figure 1.2 – A thing  ",), ("  > Figure 3 - B",), ("Figure one - C",), ("see ([Source PDF, p. 2](u))",)], "line string")
    of = lambda c: [r[0] for r in df.select(c).collect()]
    assert of(selection.caption_styled(F.col("line"))) == ["> Figure 1.2 – A thing", "  > Figure 3 - B", "Figure one - C", "see ([Source PDF, p. 2](u))"]
    assert of(selection.caption_styled(F.col("line"), "plain"))[:2] == ["Figure 1.2 – A thing", "  Figure 3 - B"]
    assert of(selection.caption_with_source(F.col("line"), F.lit(4), F.lit("u")))[2:] == ["Figure one - C ([Source PDF, p. 4](u))", "see ([Source PDF, p. 2](u))"]


def test_page_images(spark):
    rows = [(1, 7, "png", b"ab", 500.0, 10.0, 20.0, 30.0, 40.0), (1, 7, "png", b"ab", 500.0, 5.0, 25.0, 20.0, 60.0), (1, 8, None, b"x", 500.0, None, None, None, None), (2, 7, "png", b"", 1.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "page int, xref int, ext string, data binary, page_height double, x0 double, y0 double, x1 double, y1 double")
    got = {r.xref: tuple(r)[2:] for r in selection.page_images(df).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {7: ("Figure-p0001-7.png", 5.0, 20.0, 30.0, 60.0, "pdf-coordinate", 2, sha(b"ab")), 8: ("Figure-p0001-8.bin", 0.0, 501.0, 0.0, 501.0, "fallback-page-end", 1, sha(b"x"))}


def test_manual_metrics(spark):
    df = spark.createDataFrame([("a", True, 3, 0, 2, 5, None), ("b", False, 1, 1, 0, None, 4)], "case string, has_evidence boolean, n_facts int, n_conflicts int, n_criteria int, n_pages_read int, n_memory_calls int")
    got = {(r.case, r.metric): (r.status, r.denominator) for r in selection.manual_metrics(df).collect()}
    assert got["a", "required_facts_recovered"] == ("requires_manual_review", 3) and got["a", "conflicts_identified"] == ("not_applicable", None)
    assert got["b", "required_facts_recovered"] == ("not_run", 1) and got["b", "unnecessary_memory_calls"] == ("not_run", 4) and len(got) == 14


def test_evidence(spark):
    said = b"one\ntwo\n"
    record = {"case": "c", "variant": "v", "permissions": "p", "original_revision": "r"}
    good = record | {"schema_version": 1, "model": "m", "configuration": {}, "available_tools": ["t"], "limitations": [], "started_at": "2025-01-01T00:00:00Z", "finished_at": "2025-01-01T01:00:00+01:00"}
    good["transcript"] = {"path": "t", "sha256": hashlib.sha256(said).hexdigest()}
    bad = [{}, good | {"schema_version": True}, good | {"case": "d"}, good | {"model": " "}, good | {"limitations": [1]}, good | {"session_id": 1}, good | {"finished_at": "2024-01-01T00:00:00Z"}, good | {"started_at": "2025-01-01"}]
    bad += [good | {"transcript": {"sha256": "x"}}, good | {"configuration": []}]
    rows = [(0, json.dumps(good), said)] + [(1 + i, json.dumps(x), said) for i, x in enumerate(bad)] + [(90, "{", said), (91, json.dumps(good), None), (92, None, said)]
    df = spark.createDataFrame(rows, "i int, raw string, said binary").withColumn("record", F.struct(*(F.lit(v).alias(k) for k, v in record.items())))
    got = {r.i: r.e for r in df.select("i", evidence.checked(F.col("raw"), F.col("record"), F.col("said")).alias("e")).collect()}
    assert (got[0].n_lines, got[0].error) == (2, None) and all(got[i].error and got[i].n_lines is None for i in got if i)


def test_file_predicates(spark):
    paths = ["a.md", ".b.md", "x/File/c.md", "x/d.md", "x/.git/e.md", "s/f.md", "s/.memory.json", "s/g.MD", "node_modules/h.md", "x/.gitkeep", "Build/i.md", "x/j.txt", "s/.k/l.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    of = lambda c: {r.path for r in df.where(c).collect()}
    p = F.col("path")
    assert of(tables.is_content(p)) == {"a.md", ".b.md", "x/d.md", "x/.git/e.md", "s/f.md", "node_modules/h.md", "Build/i.md", "s/.k/l.md"}
    assert of(tables.is_kept(p)) == set(paths) - {".b.md", "x/.git/e.md", "s/.k/l.md"}
    assert of(tables.is_page(p, ["s"])) == {"a.md", "s/f.md", "s/g.MD"}
    assert of(tables.is_project_markdown(p)) == {"a.md", "x/File/c.md", "x/d.md", "s/f.md", "s/g.MD"}
    good, bad = tables.strict_text(spark.createDataFrame([(bytearray(b"caf\xc3\xa9"),), (bytearray(b"\xff"),)], "content binary"))
    assert [r.text for r in good.collect()] == ["café"] and bad.count() == 1


# Queries that SQL does not express, against plain Python


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_casefold_keys(spark, texts):
    got = {r.doc_id: r.key for r in catalog.QUERIES["casefold_keys"](spark, SF).collect()}
    assert got == {i: unicodedata.normalize("NFKC", t).casefold() for i, t in texts.items()}


def test_unified_diffs(spark, texts):
    edited = {i: t.translate(str.maketrans("0123456789", "1234567890")) if i % 3 == 0 else t for i, t in texts.items()}
    want = {}
    for i, t in texts.items():
        if t != edited[i]:
            rows = list(difflib.unified_diff(t.split("\n"), edited[i].split("\n"), "current", "desired", lineterm=""))
            want[i] = ("\n".join(rows[:500]), len(rows))
    assert want and {r.doc_id: (r.diff, r.n_lines) for r in catalog.QUERIES["unified_diffs"](spark, SF).collect()} == want


def test_fidelity_full(spark):
    def read(df):
        out = {}
        for r in sorted(anchors.anchors(df).collect(), key=lambda r: r.ord):
            out.setdefault((r.doc_id, r.category), []).append(r.value)
        return out

    a, b = read(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")), read(views.docs_candidate(spark, SF))
    want = set()
    for key in a.keys() | b.keys():
        x, y = a.get(key, []), b.get(key, [])
        for n in range(max(len(x), len(y))):
            s, c = x[n] if n < len(x) else None, y[n] if n < len(y) else None
            if s != c:
                want.add((*key, n, s, c))
                break
    assert want and {tuple(r) for r in catalog.QUERIES["fidelity_full"](spark, SF).collect()} == want
