"""Queries without SQL against plain Python, over whole tables."""

import difflib
import re
import unicodedata

from folioscope.plans import catalog
from folioscope.plans import views as v

SF = "/root/testdata/sf0.001"
CODE, MARKER, NUMBER = (
    r"`[^`\n]+`",
    r"\[(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}(?:\.[0-9]+)?\]|\[[^\[\]\n]{1,40}\](?!\()|\{[^{}\n]{1,40}\}",
    r"[0-9]{4}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?|(?<![A-Za-z0-9_.])[+-]?[0-9][0-9,]*(?:\.[0-9]+)?%?(?![A-Za-z0-9_])",
)


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def edited(i, text):
    return text.translate(str.maketrans("0123456789", "1234567890")) if i % 3 == 0 else text


def plain_anchors(text):
    lines, out = text.split("\n"), []
    at = 0
    if lines[0].strip(" ") == "---":
        ends = [n for n, x in enumerate(lines) if n and x.strip(" ") == "---"]
        if ends:
            at = ends[0] + 1
            out.append(("frontmatter", 0, "\n".join(lines[:at])))
    while at < len(lines):
        fence = re.match(r"`{3,}|~{3,}", lines[at].strip(" "))
        if fence:
            mark, end = fence[0], at + 1
            while end < len(lines):
                x = lines[end].strip(" ")
                if len(x) >= len(mark) and set(x) == {mark[0]}:
                    break
                end += 1
            out.append(("fenced_code", at, "\n".join(lines[at : end + 1])))
            at = end + 1
            continue
        line = lines[at]
        for lead in (r"^\s*[0-9]+[.)]\s+", r"^\s*\[?(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}\]?\s+", r"^\s*[A-Z][A-Za-z .]{0,30}:\s+"):
            line = re.sub(lead, "", line, flags=re.ASCII)
        for m in re.finditer(f"(?P<inline_code>{CODE})|(?P<markers>{MARKER})|(?P<numbers>{NUMBER})", line):
            out.append((m.lastgroup, at, m[0]))
        at += 1
    seen: dict[str, int] = {}
    placed = []
    for kind, n, value in out:
        placed.append((kind, seen.get(kind, 0), n, value))
        seen[kind] = seen.get(kind, 0) + 1
    return placed


def test_anchor_tokens(spark):
    got = sorted((r.doc_id, r.category, r.ord, r.line_no, r.value) for r in catalog.QUERIES["anchor_tokens"](spark, SF).collect())
    made = [(r.doc_id, r.text) for r in v.conv_md(spark, SF).collect()] + list(texts(spark).items())
    assert got == sorted((i, *a) for i, t in made for a in plain_anchors(t or ""))


def test_fidelity_full(spark):
    want = []
    for i, t in texts(spark).items():
        sides = [{(k, n): value for k, n, _, value in plain_anchors(x or "")} for x in (t, t and edited(i, t))]
        first = {}
        for k, n in sorted({*sides[0], *sides[1]}):
            if sides[0].get((k, n)) != sides[1].get((k, n)):
                first.setdefault(k, (i, k, n, sides[0].get((k, n)), sides[1].get((k, n))))
        want += first.values()
    got = [(r.doc_id, r.category, r.ord, r.source_value, r.candidate_value) for r in catalog.QUERIES["fidelity_full"](spark, SF).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, want))


def test_casefold_keys(spark):
    got = {r.doc_id: r.key for r in catalog.QUERIES["casefold_keys"](spark, SF).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFKC", t).casefold() for i, t in texts(spark).items()}


def test_unified_diffs(spark):
    got = {r.doc_id: (r.diff, r.n_lines) for r in catalog.QUERIES["unified_diffs"](spark, SF).collect()}
    want = {}
    for i, t in texts(spark).items():
        if t is not None and edited(i, t) != t:
            lines = list(difflib.unified_diff(t.split("\n"), edited(i, t).split("\n"), "current", "desired", lineterm=""))
            want[i] = ("\n".join(lines[:500]), len(lines))
    assert got == want
