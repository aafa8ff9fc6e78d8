"""Branches, tags, blame and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import commits as C, formats as M

PROTECTED = ("main", "master", "develop", "release/*")


def branch_report(branches: DataFrame, now: Column, protected: tuple[str, ...] = PROTECTED, stale_days: int = 30, abandoned_days: int = 90) -> DataFrame:
    """Status, deletability and category of ``branches(name, last_commit, ahead, merged)``."""
    status = C.branch_status(F.col("last_commit"), now, stale_days, abandoned_days)
    out = branches.withColumns({"status": status, "protected": M.matches_any(F.col("name"), protected), "age": C.age_days(F.col("last_commit"), now), "merge_type": C.merge_type(F.col("merged"))})
    out = out.withColumn("score", C.deletability(F.col("merged"), F.col("status"), F.col("age"), F.col("ahead"), F.col("protected")))
    return out.withColumn("category", C.deletability_category(F.col("score"), F.col("protected")))


def branch_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "abandoned").alias("abandoned"), F.count_if(F.col("category") == "safe").alias("safe"))


def show_branches(report: DataFrame, show: str, default: str) -> DataFrame:
    """``merged``, ``stale``, ``abandoned`` or ``all`` branches, without the default one."""
    rows = report.filter(F.col("name") != default)
    if show == "all":
        return rows
    return rows.filter("merged") if show == "merged" else rows.filter(F.col("status") == show)


def version_tags(tags: DataFrame) -> DataFrame:
    """Tags that are versions, with their parts, the newest version first."""
    parsed = tags.select("*", *(c.alias(k) for k, c in C.semver(F.col("name")).items())).filter("major is not null")
    return parsed.orderBy(F.desc("major"), F.desc("minor"), F.desc("patch"), "name")


def blame_shares(blame: DataFrame) -> DataFrame:
    """Lines and percentage of each author of each file."""
    counts = blame.groupBy("path", "author").agg(F.count("*").alias("lines"))
    share = F.col("lines") * F.lit(100.0) / F.sum("lines").over(W.partitionBy("path"))
    return counts.withColumn("percentage", F.bround(share, 2))


def bus_factor(shares: DataFrame) -> DataFrame:
    """The fewest authors of each file who hold over half of its lines together."""
    order = W.partitionBy("path").orderBy(F.desc("lines"), "author")
    before = F.coalesce(F.sum("percentage").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return shares.withColumn("before", before).groupBy("path").agg(F.count_if(F.col("before") <= 50.0).alias("bus_factor"))


def coverage(line_hits: DataFrame) -> DataFrame:
    """Covered and all lines of each file from ``(path, hits)``, and their ratio."""
    sums = line_hits.groupBy("path").agg(F.count_if(F.col("hits") > 0).alias("covered"), F.count("*").alias("total"))
    return sums.withColumn("ratio", F.bround(F.col("covered") / F.col("total"), 4))


def union_coverage(hits: DataFrame) -> DataFrame:
    """``(path, covered)``: the different lines of each file that any of its runs ``(path, run, line)`` has met.

    Lines are kept as bitmaps, one of 32 768 lines for each run, which are put together by OR.
    """
    runs = hits.groupBy("path", "run", F.bitmap_bucket_number("line").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("line")).alias("bits"))
    files = runs.groupBy("path", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("lines"))
    return files.groupBy("path").agg(F.sum("lines").alias("covered"))


def overall_coverage(files: DataFrame) -> DataFrame:
    total = F.sum("total")
    return files.agg(F.coalesce(F.when(total > 0, F.bround(F.sum("covered") / total, 4)), F.lit(0.0)).alias("ratio"))


def worst_coverage(files: DataFrame, n: int = 30) -> DataFrame:
    return files.orderBy("ratio", "path").limit(n)
