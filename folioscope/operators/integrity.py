"""Integrity rules over pages of a knowledge base.

pages has path, type, status, updated, topic, verified, verified_rev, kind, task_status (strings), sources, source_logs
(arrays of strings), supersedes (string) and body. A finding is (severity, rule, path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import scalar as s
from folioscope.operators.links import cycles, reachable

# Fixed values.
TYPES = ("state", "knowledge", "decision", "log", "moc")
STATUSES = ("active", "proposed", "deprecated", "superseded", "archived")
HISTORICAL = ("archived", "superseded", "deprecated")
CURRENT_TYPES = ("state", "decision", "knowledge")
LOG_KINDS = ("feature", "ui", "bug", "discussion", "test", "maintenance")
TASK_STATUSES = ("completed", "in_progress", "blocked", "abandoned")
STALE_DAYS = 90


Rule = tuple[str, str, Column]


def findings(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """severity, rule and path of every rule that holds for a page; all rules are judged in one pass over the pages."""
    said = [F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"))) for severity, name, when in rules]
    return pages.select("path", F.explode(F.array_compact(F.array(*said))).alias("f")).select("f.severity", "f.rule", "path")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def field_rules(today: Column) -> list[Rule]:
    """Rules on single pages."""
    updated, verified = s.iso_date(F.col("updated")), s.iso_date(F.col("verified"))
    active = F.col("status") == "active"
    some = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0
    return [
        *(("error", f"missing-{c}", _blank(c)) for c in ("type", "status", "updated", "topic")),
        ("error", "bad-type", ~_blank("type") & ~F.col("type").isin(*TYPES)),
        ("error", "bad-status", ~_blank("status") & ~F.col("status").isin(*STATUSES)),
        ("error", "bad-date", ~_blank("updated") & updated.isNull()),
        ("warning", "updated-in-future", updated > today),
        ("error", "verified-after-updated", (verified > updated) | (verified > today)),
        ("warning", "stale", active & F.col("type").isin("state", "knowledge") & (F.datediff(today, F.coalesce(verified, updated)) > STALE_DAYS)),
        ("error", "bad-verified-rev", F.col("verified_rev").isNotNull() & (verified.isNull() | ~s.is_revision(F.col("verified_rev")))),
        ("error", "bad-log-kind", (F.col("type") == "log") & F.col("kind").isNotNull() & ~F.col("kind").isin(*LOG_KINDS)),
        ("error", "bad-task-status", (F.col("type") == "log") & F.col("task_status").isNotNull() & ~F.col("task_status").isin(*TASK_STATUSES)),
        ("warning", "no-evidence", active & F.col("type").isin(*CURRENT_TYPES) & ~some("sources") & ~some("source_logs")),
    ]


def duplicate_active(pages: DataFrame) -> DataFrame:
    """type, topic and number of active pages, where several are active."""
    return pages.where("status = 'active'").groupBy("type", "topic").agg(F.count(F.lit(1)).alias("n_active")).where("n_active > 1")


def duplicate_numbers(pages: DataFrame, pattern: str = r"(?i)adr-0*([0-9]+)") -> DataFrame:
    """Numbers, as whole numbers, that several decision pages have in their names."""
    number = F.regexp_extract("path", pattern, 1).try_cast("long")
    return pages.where("type = 'decision'").groupBy(number.alias("number")).agg(F.count(F.lit(1)).alias("n_pages")).where("number is not null and n_pages > 1")


def supersession(pages: DataFrame) -> DataFrame:
    """Findings on replaced pages: no such page, another type, or not marked as superseded."""
    old = pages.select(F.col("path").alias("_old"), F.col("type").alias("_type"), F.col("status").alias("_status"))
    joined = pages.where("supersedes is not null").join(old, F.col("supersedes") == F.col("_old"), "left")
    finding = F.when(F.col("_old").isNull(), "supersedes-missing").when(F.col("type") != F.col("_type"), "supersedes-other-type").when((F.col("_status") != "superseded") & (F.col("status") == "active") & (F.col("type") != "log"), "superseded-not-marked")
    return joined.select(F.lit("error").alias("severity"), finding.alias("rule"), "path").where("rule is not null")


def inspect(pages: DataFrame, today: Column) -> DataFrame:
    """All findings on pages, without repeats."""
    active = pages.where((F.col("status") == "active") & F.col("type").isin(*CURRENT_TYPES)).select("type", "topic", "path")
    crowded = duplicate_active(active.withColumn("status", F.lit("active"))).select("type", "topic")
    both = (active["type"].eqNullSafe(crowded["type"])) & (active["topic"].eqNullSafe(crowded["topic"]))
    several = active.join(crowded, both, "left_semi").select(F.lit("error").alias("severity"), F.lit("several-active").alias("rule"), "path")
    return findings(pages, field_rules(today)).unionByName(several).unionByName(supersession(pages)).distinct()


def navigation(pages: DataFrame, link_rows: DataFrame, entry: str, log_index: str, maps: dict[str, str], stored) -> DataFrame:
    """Findings on the way to pages: logs that the log index does not link to, pages that their type's map does not, pages
    that no links lead to from the entry, and what is wrong with the entry and the maps themselves.

    link_rows: src and path of links within the pages; maps: type to the path of its map of contents.
    """
    edges = stored(link_rows.where("path is not null").select("src", F.col("path").alias("dst")).distinct(), "edges")
    of = F.create_map(*(F.lit(x) for kv in {**maps, "log": log_index}.items() for x in kv))
    kinds = [*maps, "log"]
    owed = pages.where(F.col("type").isin(*kinds) & (F.col("type") != "state")).select("path", "type", F.try_element_at(of, F.col("type")).alias("_map"))
    seen = edges.where(F.col("src").isin(log_index, *maps.values())).select(F.col("src").alias("_map"), F.col("dst").alias("path"))
    has_entry = pages.where(F.col("path") == entry).select(F.lit(1).alias("_one"))
    missing = owed.join(seen, ["path", "_map"], "left_anti")
    missing = missing.where("type = 'log'").unionByName(missing.where("type <> 'log'").join(has_entry, F.lit(1) == F.col("_one"), "left_semi"))
    rule = F.when(F.col("type") == "log", "missing-from-log-map").otherwise("missing-from-category-map")
    reached = reachable(edges, pages.sparkSession.createDataFrame([(entry,)], "node string"), stored).select(F.col("node").alias("path"))
    lost = pages.where(F.col("type").isin(*CURRENT_TYPES, "log")).join(reached, "path", "left_anti")
    required = pages.sparkSession.createDataFrame([(entry,), (log_index,)], "path string").distinct()
    absent = required.join(pages.select("path"), "path", "left_anti")
    maps_here = pages.where(F.col("path").isin(entry, log_index, *maps.values()) & ~((F.col("type") == "moc") & (F.col("status") == "active")))
    said = lambda df, severity, name: df.select(F.lit(severity).alias("severity"), (name if isinstance(name, Column) else F.lit(name)).alias("rule"), "path")
    return (
        said(missing, "error", rule).unionByName(said(lost, "warning", "unreachable"))
        .unionByName(said(absent, "error", "navigation-missing")).unionByName(said(maps_here, "error", "navigation-no-active-map"))
    )


def link_findings(pages: DataFrame, link_rows: DataFrame) -> DataFrame:
    """Findings on links(src, target, path, reason) as resolve gives them. A historical page may name what is gone, unless
    that is a page itself."""
    bad = link_rows.where("reason is not null").join(pages.select(F.col("path").alias("src"), "type", "status"), "src")
    past = (F.col("type") == "log") | F.col("status").isin(*HISTORICAL)
    gone = past & (F.col("reason") == "missing") & ~F.lower(F.regexp_replace("target", r"[#?].*$", "")).endswith(".md")
    return bad.select(F.when(gone, "warning").otherwise("error").alias("severity"), F.when(gone, "historical-source-gone").otherwise(F.concat("reason", F.lit("-link"))).alias("rule"), F.col("src").alias("path"))


def required_states(pages: DataFrame, required: list[str]) -> DataFrame:
    """Findings on state pages that must be there and be active or proposed."""
    want = pages.sparkSession.createDataFrame([(p,) for p in required], "path string")
    joined = want.join(pages.select("path", "type", "status"), "path", "left")
    rule = F.when(~F.col("type").eqNullSafe(F.lit("state")), "required-state-missing").when(~F.coalesce(F.col("status"), F.lit("")).isin("active", "proposed"), "required-state-not-current")
    return joined.select(F.lit("error").alias("severity"), rule.alias("rule"), "path").where("rule is not null")


def full_report(pages: DataFrame, link_rows: DataFrame, today: Column, entry: str, log_index: str, maps: dict[str, str], required: list[str], number: str, stored) -> DataFrame:
    """Everything that is wrong with a knowledge base, as (severity, rule, path), without repeats: the rules on pages, links,
    numbers of decisions, replacement cycles, navigation, required states, and whether there are pages and a current state.

    A rule on the whole has a null path. number is the pattern of a decision's number in its path.
    """
    whole = pages.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("type") == "state") & (F.col("status") == "active")).alias("states"))
    none = F.lit(None).cast("string").alias("path")
    of_all = whole.where("n = 0").select(F.lit("error").alias("severity"), F.lit("no-pages").alias("rule"), none)
    of_all = of_all.unionByName(whole.where("states = 0").select(F.lit("warning").alias("severity"), F.lit("no-current-state").alias("rule"), none))
    of = F.regexp_extract("path", number, 1).try_cast("long")
    twice = duplicate_numbers(pages, number).select("number")
    numbered = pages.where("type = 'decision'").select("path", of.alias("number")).join(twice, "number", "left_semi")
    heirs = pages.where("supersedes is not null").select(F.col("path").alias("src"), F.col("supersedes").alias("dst"), "type").distinct()
    same = heirs.join(pages.select(F.col("path").alias("dst"), "type").distinct(), ["dst", "type"], "left_semi")
    error = lambda df, name, path: df.select(F.lit("error").alias("severity"), F.lit(name).alias("rule"), F.col(path).alias("path"))
    parts = [
        inspect(pages, today), of_all, link_findings(pages, link_rows), error(numbered, "duplicate-number", "path"), error(cycles(same, stored), "supersession-cycle", "node"),
        navigation(pages, link_rows, entry, log_index, maps, stored), required_states(pages, required),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def budget(pages: DataFrame, page_limit: int = 6000, total_limit: int = 16000) -> DataFrame:
    """group, n_pages, n_chars, n_over and over_total: characters read at the start, by group, against limits."""
    agg = pages.groupBy("group").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.length("body")).alias("n_chars"), F.count_if(F.length("body") > page_limit).alias("n_over"))
    return agg.withColumn("over_total", F.col("n_chars") > total_limit)


def trace_metrics(calls: DataFrame) -> DataFrame:
    """By case: reads, distinct files, files read again, writes, and characters, which are null if any count is unknown.

    calls: case, operation, path, characters."""
    reads = F.col("operation") == "read"
    per_file = calls.groupBy("case", "path").agg(
        F.count_if(reads).alias("r"), F.count_if(F.col("operation") == "write").alias("w"), F.sum(F.when(reads, F.col("characters"))).alias("c"), F.count_if(reads & F.col("characters").isNull()).alias("u")
    )
    return per_file.groupBy("case").agg(
        F.sum("r").alias("n_reads"), F.count_if(F.col("r") > 0).alias("n_files"), F.count_if(F.col("r") > 1).alias("n_repeated"), F.sum("w").alias("n_writes"),
        F.when(F.sum("u") == 0, F.coalesce(F.sum("c"), F.lit(0))).alias("characters"),
    )
