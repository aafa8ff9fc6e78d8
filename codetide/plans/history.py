"""Queries on commit history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import commits as C, text as X
from ..operators import history as H, rules as R
from . import bridge as B
from .registry import query


def _totals(spark, sf_dir):
    return H.with_totals(B.commits(spark, sf_dir), B.changes(spark, sf_dir))


@query("file_churn", "SELECT * FROM v_churn")
def file_churn(spark, sf_dir):
    return H.file_churn(B.changes(spark, sf_dir))


@query("commit_churn", "SELECT sha, insertions, deletions, insertions - deletions AS net_lines, insertions + deletions AS churn_score FROM v_totals")
def commit_churn(spark, sf_dir):
    return H.commit_churn(_totals(spark, sf_dir)).select("sha", "insertions", "deletions", "net_lines", "churn_score")


@query(
    "commit_flags",
    r"""SELECT sha, starts_with(lower(subject), 'merge ') AS is_merge, regexp_matches(subject, '^(?:fixup|squash)!\s') AS is_fixup, regexp_matches(subject, '(?i)^Revert\s') AS is_revert
    FROM (SELECT sha, split_part(message, chr(10), 1) AS subject FROM v_commits)""",
)
def commit_flags(spark, sf_dir):
    m = F.col("message")
    return B.commits(spark, sf_dir).select("sha", C.is_merge(m).alias("is_merge"), C.is_fixup(m).alias("is_fixup"), C.is_revert(m).alias("is_revert"))


@query("commit_size", "SELECT sha, CASE WHEN churn <= 50 THEN 'small' WHEN churn <= 200 THEN 'medium' WHEN churn <= 500 THEN 'large' ELSE 'enormous' END AS size_category FROM (SELECT sha, insertions + deletions AS churn FROM v_totals)")
def commit_size(spark, sf_dir):
    return H.enrich(_totals(spark, sf_dir)).select("sha", "size_category")


@query("conventional_type", r"SELECT sha, nullif(regexp_extract(split_part(message, chr(10), 1), '^(\w+)(?:\([^)]*\))?!?:\s', 1), '') AS conventional_type FROM v_commits")
def conventional_type(spark, sf_dir):
    return B.commits(spark, sf_dir).select("sha", C.conventional_type(F.col("message")).alias("conventional_type"))


_ALIASES = """names AS (SELECT lower(author_name) AS name, author_email AS email, count(*) AS n, min(ordinal) AS first FROM v_commits GROUP BY 1, 2),
    ranked AS (SELECT name, email, min(first) OVER (PARTITION BY name) AS name_first, count(*) OVER (PARTITION BY name) AS k, first_value(email) OVER (PARTITION BY name ORDER BY n DESC, first) AS canonical FROM names),
    aliases AS (SELECT email, arg_max(canonical, (name_first, name)) AS canonical FROM ranked WHERE k > 1 GROUP BY email)"""
_PROFILE = """SELECT p.*, CAST(coalesce(f.files_touched, 0) AS BIGINT) AS files_touched FROM (
      SELECT email, arg_max(author_name, (authored_ts, -ordinal)) AS name, count(*) AS commit_count, min(authored_ts) AS first_commit, max(authored_ts) AS last_commit, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions,
             count(DISTINCT CAST(authored_ts AS DATE)) AS active_days, coalesce(string_agg(DISTINCT author_email, ',' ORDER BY author_email) FILTER (WHERE author_email <> email), '') AS aliases FROM named GROUP BY email) p
    LEFT JOIN (SELECT n.email, count(DISTINCT c.path) AS files_touched FROM named n JOIN v_changes c ON n.sha = c.sha GROUP BY n.email) f ON p.email = f.email"""


@query("contributors", f"WITH named AS (SELECT *, author_email AS email FROM v_totals) {_PROFILE}")
def contributors(spark, sf_dir):
    return H.contributors(_totals(spark, sf_dir), B.changes(spark, sf_dir))


@query("contributors_alias", f"WITH {_ALIASES}, named AS (SELECT t.*, coalesce(a.canonical, t.author_email) AS email FROM v_totals t LEFT JOIN aliases a ON t.author_email = a.email) {_PROFILE}")
def contributors_alias(spark, sf_dir):
    commits = _totals(spark, sf_dir)
    return H.contributors(commits, B.changes(spark, sf_dir), H.alias_map(commits))


@query("work_pattern_hours", "SELECT author_email, " + ", ".join(f"count(*) FILTER (WHERE hour(authored_ts) = {h}) AS h{h:02d}" for h in range(24)) + " FROM v_activity GROUP BY author_email")
def work_pattern_hours(spark, sf_dir):
    return H.work_hours(B.activity(spark, sf_dir)).select("author_email", *(F.col("hours")[h].alias(f"h{h:02d}") for h in range(24)))


@query("work_pattern_weekdays", "SELECT author_email, " + ", ".join(f"count(*) FILTER (WHERE isodow(authored_ts) = {d + 1}) AS d{d}" for d in range(7)) + " FROM v_activity GROUP BY author_email")
def work_pattern_weekdays(spark, sf_dir):
    return H.work_weekdays(B.activity(spark, sf_dir)).select("author_email", *(F.col("weekdays")[d].alias(f"d{d}") for d in range(7)))


@query("loc_timeline", "SELECT * FROM v_timeline")
def loc_timeline(spark, sf_dir):
    return H.loc_timeline(_totals(spark, sf_dir))


@query(
    "language_timeline",
    """WITH net AS (SELECT sha, lower(list_extract(string_split(path, '.'), -1)) AS ext, sum(insertions - deletions) AS net FROM v_changes GROUP BY 1, 2)
    SELECT n.ext, n.sha, c.authored_ts, CAST(sum(n.net) OVER (PARTITION BY n.ext ORDER BY c.authored_ts, c.ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM net n JOIN v_commits c ON n.sha = c.sha""",
)
def language_timeline(spark, sf_dir):
    return H.language_timeline(B.commits(spark, sf_dir), B.changes(spark, sf_dir))


@query(
    "team_growth",
    """SELECT sha, authored_ts, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (ORDER BY authored_ts, ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value
    FROM (SELECT *, row_number() OVER (PARTITION BY author_email ORDER BY authored_ts, ordinal) AS k FROM v_activity)""",
)
def team_growth(spark, sf_dir):
    return H.team_growth(B.activity(spark, sf_dir))


@query(
    "commit_streaks",
    """WITH days AS (SELECT DISTINCT author_email, CAST(authored_ts AS DATE) AS day FROM v_activity),
    islands AS (SELECT author_email, day - CAST(row_number() OVER (PARTITION BY author_email ORDER BY day) AS INTEGER) AS island FROM days)
    SELECT author_email, max(n) AS streak FROM (SELECT author_email, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY author_email""",
)
def commit_streaks(spark, sf_dir):
    return H.commit_streaks(B.activity(spark, sf_dir))


@query("churn_percentiles", "SELECT sha, insertions + deletions AS churn, (row_number() OVER (ORDER BY insertions + deletions, ordinal) - 1) / (count(*) OVER ())::DOUBLE AS percentile FROM v_totals")
def churn_percentiles(spark, sf_dir):
    return H.churn_percentiles(_totals(spark, sf_dir))


@query("timeline_range", "SELECT * FROM v_timeline WHERE authored_ts >= CAST((SELECT CAST(max(authored_ts) AS DATE) FROM v_timeline) - INTERVAL 12 MONTH AS TIMESTAMP)")
def timeline_range(spark, sf_dir):
    return H.timeline_range(H.loc_timeline(_totals(spark, sf_dir)), 12)


@query("timeline_monthly", "SELECT CAST(date_trunc('month', authored_ts) AS DATE) AS bucket, arg_max(value, (authored_ts, ordinal)) AS value FROM v_timeline GROUP BY 1")
def timeline_monthly(spark, sf_dir):
    return H.timeline_buckets(H.loc_timeline(_totals(spark, sf_dir)), "month")


@query("timeline_weekly", "SELECT CAST(date_trunc('week', authored_ts + INTERVAL 1 DAY) AS DATE) - 1 AS bucket, arg_max(value, (authored_ts, ordinal)) AS value FROM v_timeline GROUP BY 1")
def timeline_weekly(spark, sf_dir):
    return H.timeline_buckets(H.loc_timeline(_totals(spark, sf_dir)), "week")


@query(
    "activity_heatmap",
    """WITH days AS (SELECT CAST(unnest(generate_series(DATE '2001-08-01' - 363, DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day),
    counted AS (SELECT d.day, count(c.sha) AS n FROM days d LEFT JOIN v_commits c ON CAST(c.authored_ts AS DATE) = d.day GROUP BY d.day)
    SELECT day, n, CAST(CASE WHEN n = 0 THEN 0 ELSE least(4, ceil(4 * n / (max(n) OVER ())::DOUBLE)) END AS BIGINT) AS level FROM counted""",
)
def activity_heatmap(spark, sf_dir):
    return H.activity_days(B.commits(spark, sf_dir), F.to_date(F.lit("2001-08-01")))


@query(
    "commit_breakdown",
    r"""SELECT count(*) AS commits, count(*) FILTER (WHERE starts_with(lower(subject), 'merge ')) AS merges, count(*) FILTER (WHERE regexp_matches(subject, '(?i)^Revert\s')) AS reverts, count(*) FILTER (WHERE regexp_matches(subject, '^(?:fixup|squash)!\s')) AS fixups
    FROM (SELECT split_part(message, chr(10), 1) AS subject FROM v_commits)""",
)
def commit_breakdown(spark, sf_dir):
    return H.commit_breakdown(H.enrich(_totals(spark, sf_dir)))


@query("newest_commits", "SELECT sha, authored_ts, author_name FROM v_commits ORDER BY authored_ts DESC, ordinal LIMIT 20")
def newest_commits(spark, sf_dir):
    return H.newest_commits(B.commits(spark, sf_dir)).select("sha", "authored_ts", "author_name")


# --- rules --------------------------------------------------------------------

_COUNTS = r"""counts AS (SELECT count(*) AS commits, count(*) FILTER (WHERE regexp_matches(subject, '(?i)^(?:wip|work.in.progress)\b')) AS wip, count(*) FILTER (WHERE insertions + deletions > 500) AS large,
      count(*) FILTER (WHERE abs(epoch(authored_ts) - epoch(committed_ts)) > 86400) AS rebased, count(*) FILTER (WHERE files = 0) AS empty, count(*) FILTER (WHERE regexp_matches(subject, '^(?:fixup|squash)!\s')) AS fixups,
      count(*) FILTER (WHERE regexp_matches(subject, '(?i)^Revert\s')) AS reverts, count(*) FILTER (WHERE starts_with(lower(subject), 'revert "revert')) AS nested_reverts, count(*) FILTER (WHERE isodow(authored_ts) >= 6) AS weekend,
      count(*) FILTER (WHERE hour(authored_ts) < 5) AS night, count(*) FILTER (WHERE files = 1) AS single_file, count(*) FILTER (WHERE starts_with(lower(subject), 'merge ')) AS merges, count(*) FILTER (WHERE length(trim(subject)) < 10) AS short,
      count(*) FILTER (WHERE regexp_matches(subject, '^(\w+)(?:\([^)]*\))?!?:\s')) AS conventional FROM (SELECT *, split_part(message, chr(10), 1) AS subject FROM v_totals)),
    paths AS (SELECT path, count(*) AS n FROM v_changes GROUP BY path), binaries AS (SELECT count(*) FILTER (WHERE lower(list_extract(string_split(path, '.'), -1)) IN ('png')) AS n FROM paths),
    binary_names AS (SELECT string_agg(path, ',' ORDER BY path) AS names FROM paths WHERE lower(list_extract(string_split(path, '.'), -1)) IN ('png')),
    hottest AS (SELECT path, n FROM paths WHERE n > 0.3::DOUBLE * (SELECT count(*) FROM v_commits) ORDER BY n DESC, path LIMIT 5),
    hot_names AS (SELECT string_agg(path, ',' ORDER BY n DESC, path) AS names, string_agg(path || ' (' || CAST(n AS VARCHAR) || 'x)', '; ' ORDER BY n DESC, path) AS said FROM hottest),
    extremes AS (SELECT max(insertions + deletions) AS largest, arg_min(CAST(sha AS VARCHAR), ordinal) FILTER (regexp_matches(split_part(message, chr(10), 1), '(?i)^(?:wip|work.in.progress)\b')) AS first_wip FROM v_totals),
    hot AS (SELECT count(*) FILTER (WHERE n > 0.3::DOUBLE * (SELECT count(*) FROM v_commits)) AS n FROM paths)"""
_CONDITIONS = {
    "wip_in_main": ("medium", "wip", "wip > 0"), "large_commits": ("low", "large", "large > 0"), "possible_rebase": ("low", "rebased", "rebased > 0"), "empty_commits": ("low", "empty", "empty > 0"),
    "unsquashed_fixups": ("medium", "fixups", "fixups > 0"), "revert_chains": ("high", "reverts", "reverts >= 2 AND nested_reverts > 0"), "weekend_warrior": ("low", "weekend", "commits >= 10 AND weekend / commits::DOUBLE >= 0.3"),
    "night_owl": ("low", "night", "commits >= 10 AND night / commits::DOUBLE >= 0.2"), "single_file_commits": ("low", "single_file", "commits >= 10 AND single_file / commits::DOUBLE >= 0.7"), "binary_files": ("medium", "(SELECT n FROM binaries)", "(SELECT n FROM binaries) > 0"),
    "merge_heavy": ("low", "merges", "commits >= 10 AND merges / commits::DOUBLE >= 0.3"), "short_messages": ("medium", "short", "commits >= 5 AND short / commits::DOUBLE >= 0.2"),
    "inconsistent_conventional": ("low", "conventional", "commits >= 10 AND conventional / commits::DOUBLE BETWEEN 0.2 AND 0.8"), "hotspot_files": ("low", "(SELECT n FROM hot)", "commits >= 10 AND (SELECT n FROM hot) > 0"),
}


def _evidence_sql(name: str, hits: str) -> str:
    """What a rule says of its hits."""
    share = lambda what: f"CAST({hits} AS VARCHAR) || '/' || CAST(commits AS VARCHAR) || ' commits (' || CAST(CAST(round_even({hits} / commits::DOUBLE * 100, 0) AS BIGINT) AS VARCHAR) || '%) {what}'"
    count = lambda what: f"CAST({hits} AS VARCHAR) || ' {what}'"
    return {
        "wip_in_main": count("WIP commit(s): ") + " || (SELECT left(first_wip, 8) FROM extremes) || '...'", "large_commits": count("large commit(s), largest: ") + " || CAST((SELECT largest FROM extremes) AS VARCHAR) || ' lines'",
        "possible_rebase": count("commit(s) with >1 day author/committer date gap"), "empty_commits": count("empty commit(s)"), "unsquashed_fixups": count("unsquashed fixup commit(s)"), "revert_chains": "CAST(nested_reverts AS VARCHAR) || ' revert-of-revert commit(s)'",
        "weekend_warrior": share("on weekends"), "night_owl": share("late at night"), "single_file_commits": share("touch one file"), "binary_files": count("binary file(s) committed"), "merge_heavy": share("are merges"),
        "short_messages": share("have short subjects"), "inconsistent_conventional": share("use conventional format"), "hotspot_files": "(SELECT said FROM hot_names)",
    }[name]


def _rule_sql(k: int, name: str) -> str:
    severity, hits, when = _CONDITIONS[name]
    files = {"binary_files": "(SELECT names FROM binary_names)", "hotspot_files": "(SELECT names FROM hot_names)"}.get(name, "''")
    described = next(r.description for r in R.RULES if r.name == name)
    return f"SELECT CAST({k} AS BIGINT) AS ordinal, '{name}' AS name, '{severity}' AS severity, {hits} AS hits, commits, CASE WHEN commits > 0 THEN {hits} / commits::DOUBLE ELSE 0 END AS ratio, '{described}' AS description, {_evidence_sql(name, hits)} AS evidence, {files} AS affected_files FROM counts WHERE {when}"


def _shown(found):
    """Lists of files as text, which all engines compare alike."""
    return found.withColumn("affected_files", F.array_join("affected_files", ","))


@query("patterns_all", f"WITH {_COUNTS} " + " UNION ALL ".join(_rule_sql(k, r.name) for k, r in enumerate(R.RULES)))
def patterns_all(spark, sf_dir):
    return _shown(R.detect(_totals(spark, sf_dir), B.changes(spark, sf_dir)))


def _one_rule(k: int, rule: R.Rule) -> None:
    short = {"wip_in_main": "wip", "large_commits": "large", "possible_rebase": "rebase", "empty_commits": "empty", "unsquashed_fixups": "fixup", "revert_chains": "revert", "weekend_warrior": "weekend", "night_owl": "night", "single_file_commits": "single_file", "binary_files": "binary", "merge_heavy": "merge", "short_messages": "short", "inconsistent_conventional": "conventional", "hotspot_files": "hotspot"}

    # Some rules fire on orders as commits, the others on events.
    events = rule.name in ("weekend_warrior", "single_file_commits", "merge_heavy", "short_messages", "hotspot_files")
    counts = _COUNTS.replace("v_totals", "v_event_totals").replace("v_changes", "v_event_changes").replace("v_commits", "v_event_commits") if events else _COUNTS

    @query("pattern_" + short[rule.name], f"WITH {counts} {_rule_sql(0, rule.name)}")
    def run(spark, sf_dir):
        commits, changes = (B.event_commits, B.event_changes) if events else (B.commits, B.changes)
        return _shown(R.detect(H.with_totals(commits(spark, sf_dir), changes(spark, sf_dir)), changes(spark, sf_dir), [rule]))


for _k, _rule in enumerate(R.RULES):
    _one_rule(_k, _rule)


@query("hotspot_files", "SELECT path, count(*) AS changes FROM v_changes GROUP BY path HAVING count(*) > 0.0001::DOUBLE * (SELECT count(*) FROM v_commits) ORDER BY changes DESC, path LIMIT 5")
def hotspot_files(spark, sf_dir):
    return R.hotspot_files(B.commits(spark, sf_dir), B.changes(spark, sf_dir), share=0.0001)


@query("binary_paths", "SELECT DISTINCT path FROM v_changes WHERE path LIKE '%.png'")
def binary_paths(spark, sf_dir):
    return R.binary_paths(B.changes(spark, sf_dir))


# --- text of logs -------------------------------------------------------------

_LOG = "CAST(l_quantity AS BIGINT)"


@query(
    "numstat_classify",
    """SELECT CASE WHEN k % 5 = 0 THEN 'src/new' || CAST(k AS VARCHAR) || '.py' ELSE 'src/f' || CAST(k AS VARCHAR) || '.py' END AS path, CASE WHEN k % 5 = 0 THEN 'renamed' WHEN ins > 0 AND dels = 0 THEN 'added' WHEN ins = 0 AND dels > 0 THEN 'deleted' ELSE 'modified' END AS change_type, ins AS insertions, dels AS deletions, CASE WHEN k % 5 = 0 THEN 'src/old' || CAST(k AS VARCHAR) || '.py' END AS old_path
    FROM (SELECT l_partkey AS k, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS ins, CAST(round(l_discount * 100) AS BIGINT) AS dels FROM lineitem)""",
)
def numstat_classify(spark, sf_dir):
    k = F.col("l_partkey").cast("string")
    ins = F.when(F.col("l_partkey") % 7 == 0, "-").otherwise(F.col("l_quantity").cast("long").cast("string"))
    name = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("src/{old"), k, F.lit(".py => new"), k, F.lit(".py}"))).otherwise(F.concat(F.lit("src/f"), k, F.lit(".py")))
    line = F.concat_ws("\t", ins, F.round(F.col("l_discount") * 100).cast("long").cast("string"), name)
    return C.numstat_rows(B.table(spark, sf_dir, "lineitem").select(line.alias("line")))


@query(
    "log_parse",
    "SELECT CAST(o_orderkey AS VARCHAR) AS sha, 'Author ' || CAST(o_custkey AS VARCHAR) AS author_name, CAST(o_orderdate AS TIMESTAMP) AS authored_ts, o_orderpriority AS message, count(l.l_orderkey) AS files, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS insertions FROM orders LEFT JOIN lineitem l ON o_orderkey = l_orderkey GROUP BY ALL",
)
def log_parse(spark, sf_dir):
    from ..sources.logs import parse_log

    lines = B.table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.lit("0"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"))).alias("line"))
    stats = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat_ws("\n", F.collect_list("line")).alias("stats"))
    orders = B.table(spark, sf_dir, "orders").join(stats, "o_orderkey", "left")
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    name = F.concat(F.lit("Author "), F.col("o_custkey").cast("string"))
    fields = [F.col("o_orderkey").cast("string"), name, F.lit("a@example.org"), date, name, F.lit("a@example.org"), date, F.col("o_orderpriority"), F.lit(""), F.concat(F.lit("\n"), F.coalesce("stats", F.lit("")))]
    parsed = parse_log(orders.select(F.concat_ws("\0", *fields).alias("value")))
    return parsed.select("sha", "author_name", F.col("authored_ts").cast("timestamp_ntz").alias("authored_ts"), "message", F.size("changes").cast("long").alias("files"), F.aggregate("changes", F.lit(0).cast("long"), lambda s, c: s + c["insertions"]).alias("insertions"))
