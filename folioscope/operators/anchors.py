"""Literal fidelity of two versions of a text: typed anchors in order, and where their sequences first differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("frontmatter", "fenced_code", "inline_code", "markers", "numbers")

# One alternation: what is matched first is not looked at again. Numbers are not part of identifiers; a date in CJK writing
# is one number.
_CODE = r"`[^`\n]+`"
_MARKER = r"\[(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}(?:\.[0-9]+)?\]|\[[^\[\]\n]{1,40}\](?!\()|\{[^{}\n]{1,40}\}"
_NUMBER = r"[0-9]{4}年(?:[0-9]{1,2}月(?:[0-9]{1,2}日)?)?|(?<![A-Za-z0-9_.])[+-]?[0-9][0-9,]*(?:\.[0-9]+)?%?(?![A-Za-z0-9_])"
BODY = f"{_CODE}|{_MARKER}|{_NUMBER}"


def _body(line: Column) -> Column:
    """A prose line without the number of an ordered item, a leading time and a leading speaker."""
    no_item = F.regexp_replace(line, r"^\s*[0-9]+[.)]\s+", "")
    no_time = F.regexp_replace(no_item, r"^\s*\[?(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}\]?\s+", "")
    return F.regexp_replace(no_time, r"^\s*[A-Z][A-Za-z .]{0,30}:\s+", "")


_ANCHOR = "array<struct<line_no:int,value:string>>"


def _fence_blocks(body: Column) -> Column:
    """(start, end) of fenced blocks among lines: a fence is closed by the same character, at least as long, with nothing behind
    it; a block that is never closed runs to the end."""
    mark = lambda x: F.regexp_extract(F.trim(x), r"^(`{3,}|~{3,})", 1)
    fences = F.filter(F.transform(body, lambda x, i: F.struct(i.alias("i"), mark(x).alias("mark"), F.trim(x).rlike(r"^(`{3,}|~{3,})$").alias("bare"))), lambda f: f["mark"] != "")
    first = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        opens = acc["open"] == ""
        closes = ~opens & f["bare"] & (F.left(f["mark"], F.lit(1)) == F.left(acc["open"], F.lit(1))) & (F.length(f["mark"]) >= F.length(acc["open"]))
        block = F.array(F.struct(acc["at"].alias("start"), f["i"].alias("end")))
        return F.struct(
            F.when(opens, f["mark"]).when(closes, "").otherwise(acc["open"]).alias("open"), F.when(opens, f["i"]).otherwise(acc["at"]).alias("at"), F.when(closes, F.concat(acc["out"], block)).otherwise(acc["out"]).alias("out")
        )

    rest = lambda acc: F.when(acc["open"] != "", F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (F.size(body) - 1).alias("end"))))).otherwise(acc["out"])
    return F.aggregate(fences, first, step, rest)


def _anchored(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with a column of this name: a struct with an array of (line_no, value) for each category of anchors of the text."""
    part = lambda n: f"_{name}_{n}"
    ls, front, body, blocks, found = (F.col(part(n)) for n in ("ls", "front", "body", "blocks", "found"))
    rule = F.array_position(F.transform(F.slice(ls, 2, F.size(ls)), F.trim), "---")
    rows = docs.withColumn(part("ls"), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    rows = rows.withColumn(part("front"), F.when((F.trim(ls[0]) == "---") & (rule > 0), rule.cast("int") + 1).otherwise(0))
    rows = rows.withColumn(part("body"), F.slice(ls, front + 1, F.size(ls))).withColumn(part("blocks"), _fence_blocks(body))
    anchor = lambda n, value: F.struct(n.cast("int").alias("line_no"), value.alias("value"))
    top = F.when(front > 0, F.array(anchor(F.lit(0), F.array_join(F.slice(ls, 1, front), "\n")))).otherwise(F.array().cast(_ANCHOR))
    fenced = F.transform(blocks, lambda b: anchor(b["start"] + front, F.array_join(F.slice(body, b["start"] + 1, b["end"] - b["start"] + 1), "\n")))
    inside = F.flatten(F.transform(blocks, lambda b: F.sequence(b["start"], b["end"])))
    prose = F.array_except(F.transform(body, lambda _, i: i), inside)  # line numbers, so that each line is looked up once
    rows = rows.withColumn(part("found"), F.flatten(F.transform(prose, lambda i: F.transform(F.regexp_extract_all(_body(body[i]), F.lit(BODY), F.lit(0)), lambda v: anchor(i + front, v)))))
    kind = lambda x: F.when(x["value"].startswith("`"), "inline_code").when(x["value"].rlike(r"^[\[{]"), "markers").otherwise("numbers")
    of_kind = [F.filter(found, _is(kind, c)).alias(c) for c in CATEGORIES[2:]]
    return rows.select(*docs.columns, F.struct(top.alias("frontmatter"), fenced.alias("fenced_code"), *of_kind).alias(name))


def anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, category, ord, line_no, value of every anchor of every text.

    Frontmatter and fenced code are one anchor each, compared as they stand; prose lines give code, markers and numbers. A map
    over the documents, without a shuffle."""
    rows = _anchored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "found")
    placed = [F.transform(F.col("found")[c], _placed(c)) for c in CATEGORIES]
    return rows.select("doc_id", F.explode(F.concat(*placed)).alias("a")).select("doc_id", "a.category", "a.ord", "a.line_no", "a.value")


def _is(kind, category: str):
    return lambda x: kind(x) == category


def _placed(category: str):
    return lambda x, i: F.struct(F.lit(category).alias("category"), i.alias("ord"), x["line_no"].alias("line_no"), x["value"].alias("value"))


def row_differences(docs: DataFrame, before: str, after: str, doc_id: str = "doc_id") -> DataFrame:
    """first_differences of two texts that stand in one row: a map over the rows whose texts differ, without a shuffle."""
    pairs = docs.select(F.col(doc_id).alias("doc_id"), F.col(before).alias("before"), F.col(after).alias("after"))
    rows = _anchored(_anchored(pairs.where(~F.col("before").eqNullSafe(F.col("after"))), "before", "a"), "after", "b")

    def first(category: str) -> Column:
        values = lambda side: F.transform(F.col(side)[category], lambda x: x["value"]).alias(side)
        both = F.transform(F.arrays_zip(values("a"), values("b")), lambda p, i: F.struct(F.lit(category).alias("category"), i.alias("ord"), p["a"].alias("source_value"), p["b"].alias("candidate_value")))
        return F.get(F.filter(both, lambda x: ~x["source_value"].eqNullSafe(x["candidate_value"])), F.lit(0))

    found = rows.select("doc_id", F.explode(F.array(*map(first, CATEGORIES))).alias("f")).where("f is not null")
    return found.select("doc_id", "f.category", "f.ord", "f.source_value", "f.candidate_value")


def first_differences(source: DataFrame, candidate: DataFrame) -> DataFrame:
    """For each document and category the first place at which two anchor sequences differ, an absent anchor being null."""
    side = lambda df, name: df.select("doc_id", "category", "ord", F.col("value").alias(name))
    joined = side(source, "source_value").join(side(candidate, "candidate_value"), ["doc_id", "category", "ord"], "full_outer")
    differ = joined.where(~F.col("source_value").eqNullSafe(F.col("candidate_value")))
    first = differ.groupBy("doc_id", "category").agg(F.min(F.struct("ord", "source_value", "candidate_value")).alias("f"))
    return first.select("doc_id", "category", F.col("f.ord").alias("ord"), F.col("f.source_value").alias("source_value"), F.col("f.candidate_value").alias("candidate_value"))


def shown(value: Column) -> Column:
    """A value of up to 60 characters, or 57 and dots."""
    return F.when(F.length(value) > 60, F.concat(F.left(value, F.lit(57)), F.lit("..."))).otherwise(value)
