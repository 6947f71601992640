"""Typed reads of a corpus's settings, and options of a run. Settings are one small file, read on the driver; the same read is
a column expression for tables of them."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MODES = ("lite", "standard")
LINK_STYLES = ("markdown", "wiki")
READ_BUDGET = {"startup_chars": 16000, "page_chars": 6000, "todo_items": 20}
DEFAULT_KEYS = ("kind", "importance")
STAGES = ("chapterize", "sections", "attachments", "code_blocks", "tables", "visual_tables", "lens", "moc", "topic_index")
OPTIONS = {
    "inline_image_policy": ("auto", "block"),
    "visual_table_discovery": ("auto", "off"),
    "boxed_callout_policy": ("auto", "off"),
    "figure_caption_style": ("plain", "blockquote"),
}


def is_whole(value: object, least: int = 0) -> bool:
    """A whole number from least on; true and false are none."""
    return type(value) is int and value >= least


def read_settings(raw: str) -> dict:
    """schema_version, mode, link_style, budget and defaults of a settings text. ValueError names what is wrong with it."""
    data = json.loads(raw.removeprefix("﻿"))
    if not isinstance(data, dict) or not is_whole(data.get("schema_version"), 1) or data["schema_version"] > 2 or data.get("mode") not in MODES:
        raise ValueError("unsupported schema_version or mode")
    style = data.get("link_style", "wiki")
    if style not in LINK_STYLES:
        raise ValueError("link_style must be markdown or wiki")
    limits = data.get("read_budget", {})
    if not isinstance(limits, dict) or not set(limits) <= set(READ_BUDGET) or not all(map(is_whole, limits.values())):
        raise ValueError("read_budget takes whole numbers from 0 on, under known names")
    defaults = data.get("moc_defaults", {})
    if not isinstance(defaults, dict) or not set(defaults) <= set(DEFAULT_KEYS) or not all(isinstance(x, str) and x.strip() for x in defaults.values()):
        raise ValueError("moc_defaults takes texts, under known names")
    return {"schema_version": data["schema_version"], "mode": data["mode"], "link_style": style, **READ_BUDGET, **limits, **{k: defaults.get(k) for k in DEFAULT_KEYS}}


_FIELDS = "schema_version int, mode string, link_style string, startup_chars long, page_chars long, todo_items long, kind string, importance string, error string"


def settings(raw: Column) -> Column:
    """read_settings as a struct, with error in place of an exception; all null for null."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    @F.pandas_udf(_FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append({} if text is None else read_settings(text))
            except ValueError as said:
                rows.append({"error": "no JSON" if isinstance(said, json.JSONDecodeError) else str(said)})
        out = pd.DataFrame(rows, columns=names, dtype=object)
        numbers = ["schema_version", "startup_chars", "page_chars", "todo_items"]
        return out.assign(**{c: pd.array([None if pd.isna(x) else int(x) for x in out[c]], dtype="Int64") for c in numbers}).where(out.notna(), None)

    return run(raw)


def option(name: str, value: object) -> str:
    """An option's value in lower case, or its default, the first one. ValueError for any other."""
    said = str(value or OPTIONS[name][0]).strip().lower()
    if said not in OPTIONS[name]:
        raise ValueError(f"{name} must be {' or '.join(OPTIONS[name])}")
    return said


def stages(modules: dict[str, object], requested: str | None = None) -> list[str]:
    """The stages to run, each once: those asked for in their order, or else those that are switched on. Any other stage needs
    the first one."""
    if requested:
        named = list(dict.fromkeys(x.strip() for x in requested.split(",") if x.strip()))
        if unknown := [x for x in named if x not in STAGES]:
            raise ValueError(f"unknown stages: {', '.join(unknown)}")
    else:
        named = [x for x in STAGES if modules.get(x)]
    return named if not named or "chapterize" in named else ["chapterize", *named]


def regions(config: dict) -> list[dict]:
    """The configured regions of drawn tables, where these are enabled."""
    own = config.get("visual_tables") or {}
    return [x for x in own.get("regions") or [] if isinstance(x, dict)] if own.get("enabled") else []


def chosen(selection: str | None) -> Sequence[str] | None:
    """The parts of a comma-separated selection; null for none. ValueError if it is empty."""
    if selection is None:
        return None
    parts = [x.strip() for x in selection.split(",") if x.strip()]
    if not parts:
        raise ValueError("a selection names one thing or more")
    return parts
