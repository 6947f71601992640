"""Text functions that have no column expression: case folding, compatibility forms, nested targets and diffs.

They run as Arrow-batched pandas functions.
"""

from __future__ import annotations

import ast
import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _mapped(name: str, make, kind: str):
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else make(v))

    run.__name__ = name
    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(run, kind)(c)


def casefold(text: Column) -> Column:
    return _mapped("casefold", str.casefold, "string")(text)


def nfkc(text: Column) -> Column:
    return _mapped("nfkc", lambda t: unicodedata.normalize("NFKC", t), "string")(text)


def link_targets_of(text: str) -> list[str]:
    """Targets of inline links, with parentheses balanced to any depth and backslash escapes."""
    found, at = [], 0
    while (start := text.find("](", at)) >= 0:
        depth, i, target = 1, start + 2, []
        while i < len(text) and text[i] != "\n":
            c = text[i]
            if c == "\\" and i + 1 < len(text):
                target.append(text[i + 1])
                i += 2
                continue
            depth += (c == "(") - (c == ")")
            if not depth:
                break
            target.append(c)
            i += 1
        if not depth:
            found.append("".join(target).strip())
        at = start + 2
    return found


def link_targets(text: Column) -> Column:
    return _mapped("link_targets", link_targets_of, "array<string>")(text)


#: Fixed value: lines of a diff that are shown.
DIFF_LINES = 500


def unified_diff(before: Column, after: Column, most: int = DIFF_LINES) -> Column:
    """(diff, n_lines): the unified diff of two texts, of which so many lines are shown, and how many it has in all."""

    @F.pandas_udf("diff string, n_lines long")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        all_lines = [list(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), "current", "desired", lineterm="")) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"diff": ["\n".join(x[:most]) for x in all_lines], "n_lines": [len(x) for x in all_lines]})

    return run(before, after)


def version_of(source: str) -> str | None:
    """The one top-level literal VERSION of a Python source, in the form of three numbers; the source is never run."""
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError):
        return None
    named = [n.value for n in body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "VERSION" for t in n.targets)]
    if len(named) != 1 or not isinstance(named[0], ast.Constant) or not isinstance(named[0].value, str):
        return None
    parts = named[0].value.split(".")
    return named[0].value if len(parts) == 3 and all(p.isascii() and p.isdigit() and len(p) <= 5 for p in parts) else None


def declared_version(source: Column) -> Column:
    return _mapped("declared_version", version_of, "string")(source)
