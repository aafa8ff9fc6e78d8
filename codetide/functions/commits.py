"""Commit, branch and tag functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Message patterns and thresholds.
CONVENTIONAL = r"^(\w+)(?:\([^)]*\))?!?:\s"
WIP = r"(?iU)^(?:wip|work.in.progress)\b"
FIXUP = r"^(?:fixup|squash)!\s"
REVERT = r"(?i)^Revert\s+\"?"
SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-(.+))?$"
SIZES = ((50, "small"), (200, "medium"), (500, "large"))
SAFE_SCORE, CAUTION_SCORE = 70.0, 40.0


def subject(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def is_merge(message: Column) -> Column:
    return F.lower(subject(message)).startswith("merge ")


def is_fixup(message: Column) -> Column:
    return subject(message).rlike(FIXUP)


def is_revert(message: Column) -> Column:
    return subject(message).rlike(REVERT)


def is_wip(message: Column) -> Column:
    return subject(message).rlike(WIP)


def conventional_type(message: Column) -> Column:
    """The type of a conventional commit message, or null."""
    return F.nullif(F.regexp_extract(subject(message), "(?U)" + CONVENTIONAL, 1), F.lit(""))


def size_category(churn: Column) -> Column:
    out = F.when(churn <= SIZES[0][0], SIZES[0][1])
    for most, name in SIZES[1:]:
        out = out.when(churn <= most, name)
    return out.otherwise("enormous")


def semver(name: Column) -> dict[str, Column]:
    """Numbers and prerelease of a version tag; null numbers where the name is none."""
    fits = name.rlike(SEMVER)
    parts = {k: F.when(fits, F.regexp_extract(name, SEMVER, i).cast("long")) for i, k in enumerate(("major", "minor", "patch"), 1)}
    return parts | {"prerelease": F.when(fits, F.regexp_extract(name, SEMVER, 4))}


def age_days(last: Column, now: Column) -> Column:
    """Whole days between two times, rounded down."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / F.lit(86_400_000_000.0)).cast("long")


def branch_status(last: Column, now: Column, stale_days: int = 30, abandoned_days: int = 90) -> Column:
    age = age_days(last, now)
    return F.when(age >= abandoned_days, "abandoned").when(age >= stale_days, "stale").otherwise("active")


def deletability(merged: Column, status: Column, age: Column, ahead: Column, protected: Column) -> Column:
    """How safely a branch can go, 0 to 100 with one decimal."""
    points = F.when(merged, 50.0).otherwise(0.0) + F.least(age / F.lit(90.0), F.lit(1.0)) * 30.0
    points = points + F.when(status == "abandoned", 15.0).when(status == "stale", 10.0).otherwise(0.0) + F.when(ahead == 0, 5.0).otherwise(0.0)
    return F.when(protected, 0.0).otherwise(F.bround(F.least(points, F.lit(100.0)), 1))


def deletability_category(score: Column, protected: Column) -> Column:
    return F.when(protected, "keep").when(score >= SAFE_SCORE, "safe").when(score >= CAUTION_SCORE, "caution").otherwise("keep")


def merge_type(merged: Column) -> Column:
    return F.when(merged, "merge_commit").otherwise("not_merged")


NUMSTAT = r"^(\d+|-)\t(\d+|-)\t(.+)$"
_BRACE = r"^(.*)\{(.+) => (.+)\}(.*)$"


def numstat_path(line: Column) -> Column:
    """The path of a numstat line, empty if it is none: the one match that :func:`numstat_fields` needs, to be computed once."""
    return F.regexp_extract(line, NUMSTAT, 3)


def numstat_fields(line: Column, path: Column) -> dict[str, Column]:
    """Counts, path, old path and the kind of change of a numstat line and its :func:`numstat_path`."""
    count = lambda x: F.when((x == "-") | (F.length(x) > 18), F.when(x == "-", 0)).otherwise(x.try_cast("long")).cast("long")
    ins, dels = count(F.substring_index(line, "\t", 1)), count(F.substring_index(F.substring_index(line, "\t", 2), "\t", -1))
    renamed = path.contains(" => ") & path.rlike(_BRACE)
    new = F.when(renamed, F.regexp_replace(path, _BRACE, "$1$3$4")).otherwise(path)
    old = F.when(renamed, F.regexp_replace(path, _BRACE, "$1$2$4"))
    kind = F.when(renamed, "renamed").when((ins > 0) & (dels == 0), "added").when((ins == 0) & (dels > 0), "deleted").otherwise("modified")
    return {"path": new, "change_type": kind, "insertions": ins, "deletions": dels, "old_path": old}


def numstat_changes(lines: Column) -> Column:
    """The changes, as structs, of an array of lines; those that are no numstat are left out."""
    read = F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), numstat_path(x).alias("path"))), lambda x: x["path"] != "")
    return F.transform(read, lambda x: F.struct(*(c.alias(n) for n, c in numstat_fields(x["line"], x["path"]).items())))


def numstat(line: Column) -> Column:
    """A struct of a numstat line: counts, path, old path and the kind of change; null if it is none."""
    return F.get(numstat_changes(F.array(line)), F.lit(0))


def numstat_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """The same columns for each row of ``lines``; null where it is no numstat line.  Each line is matched once."""
    read = lines.select(F.col(line).alias("line"), numstat_path(F.col(line)).alias("path"))
    return read.select(*(F.when(F.col("path") != "", c).alias(n) for n, c in numstat_fields(F.col("line"), F.col("path")).items()))
