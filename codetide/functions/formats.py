"""Formatting, escaping and look-up functions as column expressions."""

from __future__ import annotations

import fnmatch
import re
from itertools import chain

from pyspark.sql import Column, functions as F

# Badge colours and their bounds, from the best band down.
COLOURS = ("#4c1", "#a4a61d", "#dfb317", "#e05d44")
COMPLEXITY_BANDS = (5, 10, 20)
COVERAGE_BANDS = (90, 75, 50)


def human_number(n: Column) -> Column:
    """1234 as ``1.2K``, 1234567 as ``1.2M``."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / F.lit(1_000_000.0)), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / F.lit(1000.0)), F.lit("K"))).otherwise(n.cast("string"))


def human_bytes(n: Column) -> Column:
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(n >= gb, F.concat(F.format_string("%.1f", n / gb), F.lit(" GB")))
        .when(n >= mb, F.concat(F.format_string("%.1f", n / mb), F.lit(" MB")))
        .when(n >= kb, F.concat(F.format_string("%.1f", n / kb), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def complexity_colour(average: Column) -> Column:
    a, b, c = COMPLEXITY_BANDS
    return F.when(average <= a, COLOURS[0]).when(average <= b, COLOURS[1]).when(average <= c, COLOURS[2]).otherwise(COLOURS[3])


def coverage_colour(percent: Column) -> Column:
    a, b, c = COVERAGE_BANDS
    return F.when(percent >= a, COLOURS[0]).when(percent >= b, COLOURS[1]).when(percent >= c, COLOURS[2]).otherwise(COLOURS[3])


def teamcity_escape(text: Column) -> Column:
    for plain, escaped in (("|", "||"), ("'", "|'"), ("\n", "|n"), ("\r", "|r"), ("[", "|["), ("]", "|]")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def blame_age(days: Column) -> Column:
    return F.when(days < 30, "fresh").when(days < 180, "recent").when(days < 365, "old").otherwise("ancient")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, or null: a literal map, so nothing is joined."""
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key) if table else F.lit(None).cast("string")


def glob_regex(patterns: tuple[str, ...]) -> str:
    """One anchored regular expression for shell patterns, in which ``*`` also crosses slashes."""
    return "^(?:" + "|".join(_java(fnmatch.translate(p)) for p in patterns) + ")$" if patterns else r"(?!)"


def _java(pattern: str) -> str:
    inner = re.fullmatch(r"\(\?s:(.*)\)\\[Zz]", pattern, re.S)
    return f"(?s:{inner[1] if inner else pattern})"


def matches_any(name: Column, patterns: tuple[str, ...]) -> Column:
    return name.rlike(glob_regex(patterns))
