"""Frontmatter and small configuration formats.

A page's frontmatter is a restricted YAML: ``key: scalar``, ``key: ["json", "list"]`` or a key with indented items. It is
read line by line with windows; a key's items are the item lines up to the next key. What cannot be read is an error row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import lines as ln

HEAD = r"\A(---\r?\n(?s:.*?)\r?\n---(?:\r?\n|\z))"


def split(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with frontmatter (empty if there is none) and body."""
    head = F.regexp_extract(text, HEAD, 1)
    return docs.withColumn("frontmatter", head).withColumn("body", F.substring(F.col(text), F.length(head) + 1, F.length(text)))


def title(frontmatter: Column) -> Column:
    return F.regexp_extract(frontmatter, r"(?m)^title:\s*[\"']?(.*?)[\"']?\s*$", 1)


def source_pages(text: Column) -> Column:
    """(start, end) of ``source_pages: [a, b]``; null without it."""
    pattern = r"(?m)^source_pages:\s*\[\s*([0-9]+)\s*,\s*([0-9]+)\s*\]"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.struct(F.regexp_extract(text, pattern, 1).try_cast("int").alias("start"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("end")))


def scalar(raw: Column) -> Column:
    """kind and value of a scalar: null, boolean, integer, number, list (JSON) or string without its quotes."""
    t = F.trim(raw)
    plain = F.when(t.rlike(r'^".*"$'), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$.v"), t)).when(t.rlike(r"^'.*'$"), F.replace(F.regexp_extract(t, r"^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(t)
    kind = (
        F.when(t.rlike("^(?i)(null|~|)$"), "null").when(t.rlike("^(?i)(true|false)$"), "boolean").when(t.rlike("^[+-]?[0-9]+$"), "integer")
        .when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "number").when(t.rlike(r"^\[.*\]$"), "list").otherwise("string")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "string", plain).when(kind == "null", F.lit(None)).otherwise(t).alias("value"))


def fields(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, key, kind, value, items and error of every frontmatter key.

    error: duplicate-key, or unreadable for lines that are no key, item, comment or blank."""
    inner = split(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).where("frontmatter <> ''")
    rows = ln.explode_lines(inner.select("doc_id", F.regexp_replace("frontmatter", r"\A---\r?\n|\r?\n?---\s*\z", "").alias("text")))
    key = F.nullif(F.regexp_extract("line", r"^([A-Za-z_][A-Za-z0-9_-]*):(?:\s|$)", 1), F.lit(""))
    item = F.when(F.col("line").rlike(r"^\s+- "), F.regexp_extract("line", r"^\s+- (.*)$", 1))
    quiet = F.col("line").rlike(r"^\s*(#.*)?$")
    marked = rows.withColumn("key", key).withColumn("_item", item).withColumn("_part", F.sum(key.isNotNull().cast("int")).over(ln.so_far()))
    bad = marked.where(F.col("key").isNull() & F.col("_item").isNull() & ~quiet).select("doc_id", "line_no", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("kind"), F.col("line").alias("value"), F.lit(None).cast("array<string>").alias("items"), F.lit("unreadable").alias("error"))
    value = scalar(F.regexp_replace(F.regexp_extract("line", r"^[^:]+:\s*(.*)$", 1), r"\s+#.*$", ""))
    items = F.transform(F.array_sort(F.collect_list(F.when(F.col("_item").isNotNull(), F.struct("line_no", scalar(F.col("_item"))["value"].alias("v"))))), lambda x: x["v"])
    keyed = marked.where("_part > 0").groupBy("doc_id", "_part").agg(F.min("line_no").alias("line_no"), F.max("key").alias("key"), F.max(F.when(F.col("key").isNotNull(), value)).alias("_v"), items.alias("items"))
    listed = F.when(F.col("_v.kind") == "list", F.from_json("_v.value", "array<string>")).when(F.size("items") > 0, F.col("items"))
    again = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("line_no")) > 1
    good = keyed.select("doc_id", "line_no", "key", F.when(F.size("items") > 0, "list").otherwise(F.col("_v.kind")).alias("kind"), F.col("_v.value").alias("value"), listed.alias("items"), F.when(again, "duplicate-key").alias("error"))
    return good.unionByName(bad)


def emitted(keys: list[str]) -> Column:
    """A frontmatter block of columns, in this order; nulls are left out."""
    pairs = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_extract(F.to_json(F.struct(F.col(k).alias("v"))), r'^\{"v":(.*)\}$', 1))) for k in keys]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *pairs), F.lit("\n---\n"))


def merged(base: dict, override: dict) -> dict:
    """Nested settings, those of the second winning."""
    out = dict(base)
    for k, v in override.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def replaced_region(text: Column, generated: Column, begin: str, end: str) -> Column:
    """Text with what stands between two markers replaced; null unless each marker stands once and in order."""
    b, e = F.lit(begin), F.lit(end)
    count = lambda m: (F.length(text) - F.length(F.replace(text, m, F.lit("")))) / F.length(m)
    once = (count(b) == 1) & (count(e) == 1) & (F.instr(text, b) < F.instr(text, e))
    return F.when(once, F.concat(F.substring_index(text, begin, 1), b, F.lit("\n"), generated, F.lit("\n"), e, F.substring_index(text, end, -1)))
