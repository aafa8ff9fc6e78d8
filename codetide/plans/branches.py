"""Queries on branches, tags, blame and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commits as C, formats as M
from ..operators import branches as O
from ..sources.logs import blame_lines, parse_diff, parse_lcov
from . import bridge as B
from .registry import query


def report(spark, sf_dir):
    return O.branch_report(B.branches(spark, sf_dir), F.lit(B.NOW).cast("timestamp_ntz"))


@query("branch_status", "SELECT name, age, status FROM v_report")
def branch_status(spark, sf_dir):
    return report(spark, sf_dir).select("name", "age", "status")


@query("branch_score", "SELECT name, score, category FROM v_report")
def branch_score(spark, sf_dir):
    return report(spark, sf_dir).select("name", "score", "category")


@query("branch_totals", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'abandoned') AS abandoned, count(*) FILTER (WHERE category = 'safe') AS safe FROM v_report")
def branch_totals(spark, sf_dir):
    return O.branch_totals(report(spark, sf_dir))


@query("branch_filter", "SELECT name, merge_type, category FROM v_report WHERE merged AND name <> 'Customer#000000001'")
def branch_filter(spark, sf_dir):
    return O.show_branches(report(spark, sf_dir), "merged", "Customer#000000001").select("name", "merge_type", "category")


@query("protected_glob", "SELECT name, name IN ('main', 'master', 'develop') OR name LIKE 'release/%' AS protected FROM v_branches")
def protected_glob(spark, sf_dir):
    return B.branches(spark, sf_dir).select("name", M.matches_any(F.col("name"), O.PROTECTED).alias("protected"))


_SEMVER = r"^v?(\d+)\.(\d+)\.(\d+)(?:-(.+))?$"
_PARSED = f"SELECT ordinal, name, CAST(regexp_extract(name, '{_SEMVER}', 1) AS BIGINT) AS major, CAST(regexp_extract(name, '{_SEMVER}', 2) AS BIGINT) AS minor, CAST(regexp_extract(name, '{_SEMVER}', 3) AS BIGINT) AS patch, regexp_extract(name, '{_SEMVER}', 4) AS prerelease FROM v_tags WHERE regexp_matches(name, '{_SEMVER}')"


@query("semver_parse", f"SELECT * FROM ({_PARSED})")
def semver_parse(spark, sf_dir):
    return B.tags(spark, sf_dir).select("ordinal", "name", *(c.alias(k) for k, c in C.semver(F.col("name")).items())).filter("major is not null")


@query("semver_sort", f"SELECT name, ordinal FROM ({_PARSED}) ORDER BY major DESC, minor DESC, patch DESC, name, ordinal")
def semver_sort(spark, sf_dir):
    tags = O.version_tags(B.tags(spark, sf_dir))
    return tags.orderBy(F.desc("major"), F.desc("minor"), F.desc("patch"), "name", "ordinal").select("name", "ordinal")


@query("blame_share", "SELECT * FROM v_shares")
def blame_share(spark, sf_dir):
    return O.blame_shares(B.blame(spark, sf_dir))


@query("bus_factor", "SELECT path, count(*) FILTER (WHERE before <= 50.0) AS bus_factor FROM (SELECT path, coalesce(sum(percentage) OVER (PARTITION BY path ORDER BY lines DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v_shares) GROUP BY path")
def bus_factor(spark, sf_dir):
    return O.bus_factor(O.blame_shares(B.blame(spark, sf_dir)))


@query("blame_age", "SELECT path, CASE WHEN days < 30 THEN 'fresh' WHEN days < 180 THEN 'recent' WHEN days < 365 THEN 'old' ELSE 'ancient' END AS age, count(*) AS lines FROM (SELECT path, date_diff('day', CAST(ts AS DATE), DATE '2001-08-15') AS days FROM v_blame) GROUP BY ALL")
def blame_age(spark, sf_dir):
    days = F.datediff(F.to_date(F.lit(B.NOW[:10])), F.to_date("ts"))
    return B.blame(spark, sf_dir).select("path", M.blame_age(days).alias("age")).groupBy("path", "age").agg(F.count("*").alias("lines"))


@query("coverage_ratio", "SELECT * FROM v_coverage")
def coverage_ratio(spark, sf_dir):
    return O.coverage(B.line_hits(spark, sf_dir))


@query("coverage_overall", "SELECT round_even(sum(covered) / sum(total)::DOUBLE, 4) AS ratio FROM v_coverage")
def coverage_overall(spark, sf_dir):
    return O.overall_coverage(O.coverage(B.line_hits(spark, sf_dir)))


@query("worst_coverage", "SELECT path, ratio FROM v_coverage ORDER BY ratio, path LIMIT 30")
def worst_coverage(spark, sf_dir):
    return O.worst_coverage(O.coverage(B.line_hits(spark, sf_dir))).select("path", "ratio")


@query(
    "diff_lines",
    "SELECT o_orderkey AS diff_id, unnest(['context', 'delete', 'add', 'add', 'context']) AS line_type, unnest(['a', 'b', 'c', 'd', 'e']) AS content, unnest([o_custkey, o_custkey + 1, NULL, NULL, o_custkey + 2]) AS old_line, unnest([o_orderkey, NULL, o_orderkey + 1, o_orderkey + 2, o_orderkey + 3]) AS new_line FROM orders",
)
def diff_lines(spark, sf_dir):
    head = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -"), F.col("o_custkey").cast("string"), F.lit(",3 +"), F.col("o_orderkey").cast("string"), F.lit(",4 @@\n a\n-b\n+c\n+d\n e\n"))
    diffs = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("diff_id"), head.alias("value"))
    return parse_diff(diffs).select("diff_id", "line_type", "content", "old_line", "new_line")


@query(
    "lcov_parse",
    r"""WITH marked AS (SELECT position, line, line LIKE 'SF:_%' AS named, trim(line) = 'end_of_record' AS ended FROM v_trace),
    state AS (SELECT *, sum(named::INT) OVER w AS record, last_value(CASE WHEN named THEN true WHEN ended THEN false END IGNORE NULLS) OVER w AS open, last_value(CASE WHEN named THEN substr(line, 4) END IGNORE NULLS) OVER w AS file FROM marked WINDOW w AS (ORDER BY position ROWS UNBOUNDED PRECEDING)),
    counts AS (SELECT record, min(file) AS file, count(*) FILTER (open AND line LIKE 'DA:%' AND TRY_CAST(split_part(line, ',', 2) AS BIGINT) > 0) AS covered, count(*) FILTER (open AND line LIKE 'DA:%') AS total, count(*) FILTER (ended) AS ends FROM state WHERE record > 0 GROUP BY record)
    SELECT 'trace' AS path, CAST(record AS BIGINT) AS record, file, covered, total, CASE WHEN total > 0 THEN round_even(covered / total::DOUBLE, 4) ELSE 0.0::DOUBLE END AS ratio FROM counts WHERE ends > 0 OR record < (SELECT max(record) FROM counts)""",
)
def lcov_parse(spark, sf_dir):
    return parse_lcov(B.trace_lines(spark, sf_dir))


_SINCE = "last_value(CASE WHEN starts_with(line, '{0}') THEN substr(line, {1}) END IGNORE NULLS) OVER w"


@query(
    "blame_parse",
    f"""WITH state AS (
      SELECT path, line, last_value(CASE WHEN regexp_matches(line, '^[0-9a-f]{{40}} ') THEN left(line, 40) END IGNORE NULLS) OVER w AS commit_sha, last_value(CASE WHEN regexp_matches(line, '^[0-9a-f]{{40}} ') THEN CAST(split_part(line, ' ', 3) AS BIGINT) END IGNORE NULLS) OVER w AS line_number,
      {_SINCE.format("author ", 8)} AS author_name, {_SINCE.format("author-mail ", 13)} AS author_email, {_SINCE.format("author-time ", 13)} AS seconds FROM v_porcelain WINDOW w AS (PARTITION BY path ORDER BY position ROWS UNBOUNDED PRECEDING))
    SELECT path, commit_sha, line_number, coalesce(author_name, '') AS author_name, coalesce(replace(replace(author_email, '<', ''), '>', ''), '') AS author_email, CAST(coalesce(seconds, '0') AS BIGINT) AS seconds FROM state WHERE starts_with(line, chr(9))""",
)
def blame_parse(spark, sf_dir):
    return blame_lines(B.porcelain_lines(spark, sf_dir)).withColumn("seconds", F.unix_seconds("ts")).drop("ts")


@query("bitmap_coverage", "SELECT l_partkey % 100 AS path, count(DISTINCT l_orderkey) AS covered FROM lineitem GROUP BY l_partkey % 100")
def bitmap_coverage(spark, sf_dir):
    return O.union_coverage(B.run_hits(spark, sf_dir))
