"""Change records: NUL-delimited name-status output and index listings as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status letters, the form of a status, and what is said of records that cannot be read.
KINDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed", "U": "unmerged", "X": "unknown", "B": "broken_pair"}
_STATUS = r"^(?:[ADTUXB]|[MRC][0-9]{0,3})\z"
UNTERMINATED, UNSUPPORTED, TRUNCATED = "unterminated_git_path_list", "unsupported_git_change_record", "truncated_git_change_record"

_ROWS = "array<struct<change:string,path:string,previous_path:string>>"


def name_status(raw: Column, scope: Column) -> Column:
    """(rows, error) of one raw record text: rows is an array of (change, path, previous_path); renames and copies have two
    paths. A text with a record that cannot be read has an error and null rows. Of the scope untracked, all are paths."""
    values = F.split(raw, "\u0000", -1)
    body = F.slice(values, 1, F.size(values) - 1)
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    row = lambda change, path, before: F.array(F.struct(change.alias("change"), path.alias("path"), before.alias("previous_path")))
    none = F.lit(None).cast("string")
    first = F.struct(none.alias("status"), none.alias("held"), none.alias("error"), F.array().cast(_ROWS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        ok, opens = acc["error"].isNull(), acc["status"].isNull()
        two = acc["status"].rlike("^[RC]")
        waits = ~opens & two & acc["held"].isNull()
        change = F.try_element_at(kinds, F.left(acc["status"], F.lit(1)))
        out = F.when(ok & ~opens & ~waits, F.concat(acc["out"], row(change, p, F.when(two, acc["held"])))).otherwise(acc["out"])
        return F.struct(
            F.when(opens, p).when(waits, acc["status"]).alias("status"), F.when(waits, p).alias("held"),
            F.when(ok & opens & ~p.rlike(_STATUS), UNSUPPORTED).otherwise(acc["error"]).alias("error"), out.alias("out"),
        )

    read = F.aggregate(body, first, step)
    error = F.when(F.element_at(values, -1) != "", UNTERMINATED).when(scope == "untracked", none).otherwise(F.coalesce(read["error"], F.when(read["status"].isNotNull(), TRUNCATED)))
    untracked = F.transform(body, lambda p: F.struct(F.lit("untracked").alias("change"), p.alias("path"), none.alias("previous_path")))
    return F.struct(F.when(error.isNull(), F.when(scope == "untracked", untracked).otherwise(read["out"])).alias("rows"), error.alias("error"))


def changes(raw: DataFrame) -> DataFrame:
    """scope, change, path, previous_path of raw(scope, raw), each once."""
    rows = raw.select("scope", F.explode(name_status(F.col("raw"), F.col("scope"))["rows"]).alias("r"))
    return rows.select("scope", "r.change", "r.path", "r.previous_path").dropDuplicates()


def change_errors(raw: DataFrame) -> DataFrame:
    """scope and error of the texts of raw(scope, raw) that cannot be read, each once."""
    return raw.select("scope", name_status(F.col("raw"), F.col("scope"))["error"].alias("error")).where("error is not null").dropDuplicates()


def index_entries(raw: DataFrame) -> DataFrame:
    """path and its sorted (mode, object, stage) entries of an index listing raw(raw)."""
    lines = raw.select(F.explode(F.filter(F.split("raw", "\u0000"), lambda p: p != "")).alias("line"))
    meta, path = F.split(F.substring_index("line", "\t", 1), " "), F.expr("substring(line, instr(line, '\t') + 1)")
    return lines.select(path.alias("path"), F.struct(meta[0].alias("mode"), meta[1].alias("object"), meta[2].alias("stage")).alias("e")).groupBy("path").agg(F.array_sort(F.collect_list("e")).alias("entries"))
