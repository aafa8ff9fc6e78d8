"""Commit history: churn, contributors, timelines, streaks and percentiles.

Inputs are ``commits(sha, author_name, author_email, authored_ts, committed_ts,
message, insertions, deletions, ordinal)``, with local wall-clock times, and
``changes(sha, path, insertions, deletions, ...)``.  ``ordinal`` is the order in
which commits were met, and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import commits as C, text as X
from .carry import carry, in_order

RUNNING = (W.unboundedPreceding, 0)


def _long(column):
    return column.cast("long")


def file_churn(changes: DataFrame) -> DataFrame:
    """Changes, insertions, deletions and their sum for each path."""
    sums = changes.groupBy("path").agg(F.count("*").alias("commit_count"), _long(F.sum("insertions")).alias("insertions"), _long(F.sum("deletions")).alias("deletions"))
    return sums.withColumn("churn_score", F.col("insertions") + F.col("deletions"))


def with_totals(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits with the sums of their changes; commits without changes get zeros."""
    sums = changes.groupBy("sha").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.count("*").alias("files"))
    joined = commits.join(sums, "sha", "left")
    return joined.withColumns({c: _long(F.coalesce(F.col(c), F.lit(0))) for c in ("insertions", "deletions", "files")})


def commit_churn(commits: DataFrame) -> DataFrame:
    return commits.withColumns({"net_lines": F.col("insertions") - F.col("deletions"), "churn_score": F.col("insertions") + F.col("deletions")})


def enrich(commits: DataFrame) -> DataFrame:
    """Flags, size category and conventional type of each commit."""
    m = F.col("message")
    return commits.withColumns({
        "is_merge": C.is_merge(m), "is_fixup": C.is_fixup(m), "is_revert": C.is_revert(m),
        "size_category": C.size_category(F.col("insertions") + F.col("deletions")), "conventional_type": C.conventional_type(m),
    })


def alias_map(commits: DataFrame) -> DataFrame:
    """``(email, canonical)`` for names with several addresses: the most used one, then the first met.

    One hop: an address used under two names follows the name that comes last.
    """
    per = commits.groupBy(F.lower("author_name").alias("name"), F.col("author_email").alias("email")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    by_name = W.partitionBy("name")
    ranked = per.withColumns({
        "k": F.count("*").over(by_name), "name_first": F.min("first").over(by_name),
        "canonical": F.first("email").over(by_name.orderBy(F.desc("n"), "first")),
    })
    several = ranked.filter("k > 1").select("email", "canonical", "name_first", "name")
    return several.groupBy("email").agg(F.max_by("canonical", F.struct("name_first", "name")).alias("canonical"))


def contributors(commits: DataFrame, changes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """A profile for each canonical address: counts, dates, lines, files, days, and aliases."""
    if aliases is None:
        named = commits.withColumn("email", F.col("author_email"))
    else:
        named = commits.join(aliases.withColumnRenamed("email", "author_email"), "author_email", "left").withColumn("email", F.coalesce("canonical", "author_email"))
    profile = named.groupBy("email").agg(
        F.max_by("author_name", F.struct("authored_ts", -F.col("ordinal"))).alias("name"), F.count("*").alias("commit_count"),
        F.min("authored_ts").alias("first_commit"), F.max("authored_ts").alias("last_commit"),
        _long(F.sum("insertions")).alias("insertions"), _long(F.sum("deletions")).alias("deletions"),
        F.count_distinct(F.to_date("authored_ts")).alias("active_days"),
        F.array_join(F.array_sort(F.array_remove(F.collect_set(F.when(F.col("author_email") != F.col("email"), F.col("author_email")).otherwise("")), "")), ",").alias("aliases"),
    )
    files = named.select("sha", "email").join(changes.select("sha", "path"), "sha").groupBy("email").agg(F.count_distinct("path").alias("files_touched"))
    return profile.join(files, "email", "left").withColumn("files_touched", F.coalesce("files_touched", F.lit(0)).cast("long"))


def work_hours(activity: DataFrame) -> DataFrame:
    """Per author, the commits in each local hour of the day, as 24 columns' worth in one array."""
    bins = F.array(*(F.count_if(F.hour("authored_ts") == h) for h in range(24)))
    return activity.groupBy("author_email").agg(bins.alias("hours"))


def work_weekdays(activity: DataFrame) -> DataFrame:
    """Per author, the commits on each weekday from Monday on."""
    bins = F.array(*(F.count_if(F.weekday("authored_ts") == d) for d in range(7)))
    return activity.groupBy("author_email").agg(bins.alias("weekdays"))


def _running(frame: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """A running sum by time, then by ordinal, in blocks of about as many rows each: only their totals meet in one task."""
    return carry(in_order(frame, "authored_ts", "ordinal"), keys, total={out: F.col(value)})


def loc_timeline(commits: DataFrame) -> DataFrame:
    """Cumulative net lines after each commit, by time, then by ordinal."""
    rows = commits.select("sha", "authored_ts", "ordinal", (F.col("insertions") - F.col("deletions")).alias("net"))
    return _running(rows, "net", [], "value").select("sha", "authored_ts", "ordinal", "value")


def language_timeline(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Cumulative net lines for each extension, with one point for each commit that touches it."""
    net = changes.groupBy("sha", X.extension(F.col("path")).alias("ext")).agg(F.sum(F.col("insertions") - F.col("deletions")).alias("net"))
    points = net.join(commits.select("sha", "authored_ts", "ordinal"), "sha")
    return _running(points, "net", ["ext"], "value").select("ext", "sha", "authored_ts", "value")


def team_growth(activity: DataFrame) -> DataFrame:
    """How many authors have been seen after each commit."""
    first = activity.groupBy("author_email").agg(F.min(F.struct("authored_ts", "ordinal")).alias("first")).select("first.*", F.lit(1).alias("is_first"))
    joined = activity.select("sha", "authored_ts", "ordinal").join(first.groupBy("authored_ts", "ordinal").agg(F.sum("is_first").alias("new")), ["authored_ts", "ordinal"], "left")
    flagged = joined.select("sha", "authored_ts", "ordinal", F.coalesce("new", F.lit(0)).alias("new"))
    return _running(flagged, "new", [], "value").select("sha", "authored_ts", "value")


def commit_streaks(activity: DataFrame) -> DataFrame:
    """The longest run of consecutive days with a commit, for each author."""
    days = activity.select("author_email", F.to_date("authored_ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(W.partitionBy("author_email").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("author_email", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("author_email").agg(F.max("n").alias("streak"))


#: Ordinals whose ties one task ranks.
RANK_BLOCK = 100_000


def churn_percentiles(commits: DataFrame) -> DataFrame:
    """Each commit's share of commits with less churn; ties go by ordinal."""
    churned = commits.select("sha", "ordinal", _long(F.col("insertions") + F.col("deletions")).alias("churn"))
    # Small churns are very common, so that ties are ranked in blocks of ordinals.
    churned = churned.withColumn("block", F.floor(F.col("ordinal") / RANK_BLOCK))
    totals = churned.groupBy("churn", "block").agg(F.count("*").alias("n"))
    blocks = totals.select("churn", "block", (F.sum("n").over(W.partitionBy("churn").orderBy("block").rowsBetween(*RUNNING)) - F.col("n")).alias("earlier"))
    sums = totals.groupBy("churn").agg(F.sum("n").alias("n"))
    before = sums.select("churn", (F.sum("n").over(W.orderBy("churn").rowsBetween(*RUNNING)) - F.col("n")).alias("less"), F.sum("n").over(W.partitionBy()).alias("all"))
    rank = F.row_number().over(W.partitionBy("churn", "block").orderBy("ordinal")) - 1
    ranked = churned.withColumn("tie", rank).join(blocks, ["churn", "block"]).join(before, "churn")
    return ranked.select("sha", "churn", ((F.col("less") + F.col("earlier") + F.col("tie")) / F.col("all")).alias("percentile"))


def timeline_range(timeline: DataFrame, months: int) -> DataFrame:
    """The points of the last ``months`` months before the latest one; all where none remain, or for 0."""
    if months <= 0:
        return timeline
    last = timeline.agg(F.max("authored_ts").alias("__last"))  # one row
    kept = timeline.crossJoin(F.broadcast(last)).filter(F.col("authored_ts") >= F.add_months("__last", -months).cast("timestamp_ntz"))
    return kept.drop("__last")


def timeline_buckets(timeline: DataFrame, unit: str) -> DataFrame:
    """The last value of each week, from Sunday on, or of each month."""
    day = F.to_date("authored_ts")
    start = F.trunc(day, "month") if unit == "month" else F.date_sub(F.trunc(F.date_add(day, 1), "week"), 1)
    return timeline.groupBy(start.alias("bucket")).agg(F.max_by("value", F.struct("authored_ts", "ordinal")).alias("value"))


def activity_days(activity: DataFrame, last_day, days: int = 364) -> DataFrame:
    """Every day of a period up to ``last_day`` with its commits and their intensity from 0 to 4."""
    spark = activity.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    counts = activity.groupBy(F.to_date("authored_ts").alias("day")).agg(F.count("*").alias("n"))
    joined = calendar.join(counts, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    most = F.max("n").over(W.partitionBy())
    level = F.when(F.col("n") == 0, 0).otherwise(F.least(F.lit(4), F.ceil(4 * F.col("n") / most)))
    return joined.select("day", "n", _long(level).alias("level"))


def commit_breakdown(enriched: DataFrame) -> DataFrame:
    """How many commits there are, and how many merges, reverts and fixups."""
    return enriched.agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"), F.count_if("is_revert").alias("reverts"), F.count_if("is_fixup").alias("fixups"))


def newest_commits(commits: DataFrame, n: int = 20) -> DataFrame:
    return commits.orderBy(F.desc("authored_ts"), "ordinal").limit(n)
