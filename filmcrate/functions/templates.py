"""Folder templates and file stems: a template is compiled once into a Column expression."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths
from .dates import SOURCES, strip_renamed

DEFAULT_TEMPLATE = "{yyyy}/{yyyy-mm-dd}"
PLACEHOLDERS = ("yyyy", "mm", "dd", "yyyy-mm", "yyyy-mm-dd", "source", "ext")
LONGEST_PATH, SHORTEST_STEM = 240, 8


def template_problem(text: str) -> str:
    """'' for a usable template, else the key of what is wrong: empty, unknown, braces or absolute."""
    inside = set(re.findall(r"\{([^}]*)\}", text))
    parts = re.split(r"[/\\]", text)
    checks = (
        ("err_pattern_empty", not text.strip()),
        ("err_pattern_unknown", bool(inside - set(PLACEHOLDERS))),
        ("err_pattern_braces", text.count("{") - text.count("}") != 0),
        ("err_pattern_absolute", ".." in parts or text.strip()[:1] in ("/", "\\") or text.strip()[1:2] == ":" and text.strip()[0].isascii() and text.strip()[0].isalpha()),
    )
    return next((key for key, wrong in checks if wrong), "")


def template_problem_column(text: Column) -> Column:
    """The same for a column of templates."""
    inside = F.regexp_extract_all(text, F.lit(r"\{([^}]*)\}"), F.lit(1))
    known = F.array(*map(F.lit, PLACEHOLDERS))
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    counted = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    return (
        F.when(trimmed == "", "err_pattern_empty")
        .when(F.size(F.array_except(inside, known)) > 0, "err_pattern_unknown")
        .when(counted("{") != counted("}"), "err_pattern_braces")
        .when(trimmed.rlike(r"^([A-Za-z]:|[\\/])") | F.array_contains(F.split(text, r"[\\/]"), ".."), "err_pattern_absolute")
        .otherwise("")
    )


def render(template: str, when: Column, source: Column, ext: Column, source_names: Mapping[str, str]) -> Column:
    """Array of folder names for a date, a source and an extension. Unknown placeholders stay as they are, blank folders go."""
    named = F.create_map(*[x for s in SOURCES for x in (F.lit(s), F.lit(source_names[s]))])
    values = {
        "yyyy": F.date_format(when, "yyyy"),
        "mm": F.date_format(when, "MM"),
        "dd": F.date_format(when, "dd"),
        "yyyy-mm": F.date_format(when, "yyyy-MM"),
        "yyyy-mm-dd": F.date_format(when, "yyyy-MM-dd"),
        "source": F.element_at(named, F.coalesce(F.nullif(source, F.lit("")), F.lit("other"))),
        "ext": F.coalesce(F.nullif(F.lower(F.ltrim(ext, F.lit("."))), F.lit("")), F.lit("_")),
    }
    folders = []
    for folder in re.split(r"[/\\]+", template.strip()):
        pieces = [values.get(p[1:-1], F.lit(p)) if p[:1] == "{" else F.lit(p) for p in re.split(r"(\{[^}]*\})", folder) if p]
        if pieces:
            folders.append(F.concat(*pieces))
    kept = F.filter(F.array(*folders), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "") != "")
    return F.transform(kept, paths.safe_name)


def renamed_stem(when: Column, stem: Column) -> Column:
    """Sortable stem: date and time, then the stem without an earlier such prefix."""
    return F.concat(F.date_format(when, "yyyy-MM-dd_HHmmss_"), strip_renamed(stem))


def fit_stem(folder: Column, stem: Column, longest_ext: Column) -> Column:
    """Struct of stem and truncated: the stem cut so that the whole path has LONGEST_PATH characters at most."""
    slash = F.when(folder.endswith("/"), 0).otherwise(1)
    room = F.lit(LONGEST_PATH) - F.length(folder) - slash - longest_ext
    long_ = F.length(stem) > room
    cut = F.regexp_replace(F.substring(stem, F.lit(1), F.greatest(room, F.lit(SHORTEST_STEM)).cast("int")), "[ .]+$", "")
    return F.struct(F.when(long_, cut).otherwise(stem).alias("stem"), long_.alias("truncated"))
