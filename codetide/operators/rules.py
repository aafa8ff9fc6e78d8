"""Anomaly rules over commit history, and quality gates.

Rules share two aggregates, one over commits and one over the changes of each path,
and each rule is a condition on their single row.  A rule is a function from the
counts to a row, so further rules can be registered beside the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import commits as C, text as X

# Suffixes of files that are no source text.
BINARY_SUFFIXES = (
    "exe", "dll", "so", "dylib", "bin", "zip", "tar", "gz", "jar", "war", "png", "jpg",
    "jpeg", "gif", "bmp", "ico", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
)

RULE_COLUMNS = ("ordinal", "name", "severity", "hits", "commits", "ratio", "description", "evidence", "affected_files")


Test = Callable[[Column, Column, Column], Column]  # of hits, commits and their ratio


def _words(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _count_of(what: str) -> Test:
    return lambda hits, n, ratio: _words(hits, " ", what)


def _share_of(what: str) -> Test:
    return lambda hits, n, ratio: _words(hits, "/", n, " commits (", F.bround(ratio * 100).cast("long"), "%) ", what)


@dataclass(frozen=True)
class Rule:
    """Fires where ``when`` holds for the counts; ``hits`` names the count that it reports, ``files`` the list of paths."""

    name: str
    severity: str
    hits: str
    when: Test
    description: str = ""
    evidence: Test = lambda hits, n, ratio: F.lit("")
    files: str | None = None


def _share(least_commits: int, low: float, high: float = 1.0) -> Test:
    return lambda hits, n, ratio: (n >= least_commits) & (ratio >= low) & (ratio <= high)


_any = lambda hits, n, ratio: hits > 0
_wip = lambda hits, n, ratio: _words(hits, " WIP commit(s): ", F.left(F.col("first_wip"), F.lit(8)), "...")
_large = lambda hits, n, ratio: _words(hits, " large commit(s), largest: ", F.col("largest"), " lines")
_hot = lambda hits, n, ratio: F.array_join(F.transform("hot", lambda f: _words(f["path"], " (", f["changes"], "x)")), "; ")

# Names, severities, bounds, descriptions and evidence of the rules, in their order.
RULES = [
    Rule("wip_in_main", "medium", "wip", _any, "WIP commits found on protected branch", _wip),
    Rule("large_commits", "low", "large", _any, "Commits with >500 lines changed detected", _large),
    Rule("possible_rebase", "low", "rebased", _any, "Commits with large author/committer date gaps (possible rebase)", _count_of("commit(s) with >1 day author/committer date gap")),
    Rule("empty_commits", "low", "empty", _any, "Commits with no file changes", _count_of("empty commit(s)")),
    Rule("unsquashed_fixups", "medium", "fixups", _any, "Fixup/squash commits that were not rebased", _count_of("unsquashed fixup commit(s)")),
    Rule("revert_chains", "high", "reverts", lambda hits, n, ratio: (hits >= 2) & (F.col("nested_reverts") > 0), "Revert-of-revert commits detected", lambda hits, n, ratio: _words(F.col("nested_reverts"), " revert-of-revert commit(s)")),
    Rule("weekend_warrior", "low", "weekend", _share(10, 0.3), "High proportion of weekend commits", _share_of("on weekends")),
    Rule("night_owl", "low", "night", _share(10, 0.2), "Significant late-night commit activity (midnight-5am)", _share_of("late at night")),
    Rule("single_file_commits", "low", "single_file", _share(10, 0.7), "Most commits touch only one file", _share_of("touch one file")),
    Rule("binary_files", "medium", "binary", _any, "Binary files tracked in repository", _count_of("binary file(s) committed"), "binary_files"),
    Rule("merge_heavy", "low", "merges", _share(10, 0.3), "High proportion of merge commits", _share_of("are merges")),
    Rule("short_messages", "medium", "short", _share(5, 0.2), "Many commits have very short messages (<10 chars)", _share_of("have short subjects")),
    Rule("inconsistent_conventional", "low", "conventional", _share(10, 0.2, 0.8), "Conventional commit format used inconsistently", _share_of("use conventional format")),
    Rule("hotspot_files", "low", "hotspots", lambda hits, n, ratio: (n >= 10) & (hits > 0), "Files changed in >30% of commits", _hot, "hot_files"),
]


def rule_counts(commits: DataFrame, changes: DataFrame, share: float = 0.3, named: int = 5) -> DataFrame:
    """One row with every count that the rules use, and the paths that they name.

    ``commits`` carries ``insertions, deletions, files`` as ``with_totals`` adds them, and
    ``sha`` and ``ordinal``.  Of paths in more than ``share`` of the commits the ``named`` busiest are listed.
    """
    m, subject = F.col("message"), C.subject(F.col("message"))
    seconds = F.abs(F.unix_seconds(F.col("authored_ts").cast("timestamp")) - F.unix_seconds(F.col("committed_ts").cast("timestamp")))
    counts = commits.agg(
        F.count("*").alias("commits"), F.count_if(C.is_wip(m)).alias("wip"), F.min_by(F.col("sha").cast("string"), F.when(C.is_wip(m), F.col("ordinal"))).alias("first_wip"), F.count_if(F.col("insertions") + F.col("deletions") > 500).alias("large"),
        F.coalesce(F.max(F.col("insertions") + F.col("deletions")), F.lit(0)).alias("largest"), F.count_if(seconds > 86_400).alias("rebased"),
        F.count_if(F.col("files") == 0).alias("empty"), F.count_if(C.is_fixup(m)).alias("fixups"), F.count_if(C.is_revert(m)).alias("reverts"),
        F.count_if(F.lower(subject).startswith('revert "revert')).alias("nested_reverts"), F.count_if(F.weekday("authored_ts") >= 5).alias("weekend"),
        F.count_if(F.hour("authored_ts") < 5).alias("night"), F.count_if(F.col("files") == 1).alias("single_file"), F.count_if(C.is_merge(m)).alias("merges"),
        F.count_if(F.length(X.strip(subject)) < 10).alias("short"), F.count_if(subject.rlike("(?U)" + C.CONVENTIONAL)).alias("conventional"),
    )
    is_binary, is_hot = X.extension(F.col("path")).isin(*BINARY_SUFFIXES), F.col("changes") > share * F.col("commits")
    per_path = changes.groupBy("path").agg(F.count("*").alias("changes"))
    judged = per_path.crossJoin(F.broadcast(commits.agg(F.count("*").alias("commits"))))  # one row
    found = judged.select("path", "changes", is_binary.alias("is_binary"), is_hot.alias("is_hot")).filter("is_binary or is_hot")
    entry = F.struct((-F.col("changes")).alias("order"), F.col("path"), F.col("changes"))  # there are fewer hot paths than 1 / share for a file of the mean commit
    paths = found.agg(
        F.count_if("is_binary").alias("binary"), F.array_sort(F.collect_list(F.when(F.col("is_binary"), F.col("path")))).alias("binary_files"),
        F.count_if("is_hot").alias("hotspots"), F.slice(F.array_sort(F.collect_list(F.when(F.col("is_hot"), entry))), 1, named).alias("hot"),
    )
    return counts.crossJoin(paths).withColumn("hot_files", F.col("hot.path"))  # two single rows


def detect(commits: DataFrame, changes: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """A row of every rule that fires, in the rules' order: see ``RULE_COLUMNS``.

    ``affected_files`` names all binary paths, and the busiest hotspots.
    """
    rows = []
    for k, rule in enumerate(rules):
        hits, n = F.col(rule.hits), F.col("commits")
        ratio = F.when(n > 0, hits / n).otherwise(F.lit(0.0))
        files = F.array().cast("array<string>") if rule.files is None else F.col(rule.files)
        rows.append(F.struct(
            F.lit(k).cast("long").alias("ordinal"), F.lit(rule.name).alias("name"), F.lit(rule.severity).alias("severity"), hits.cast("long").alias("hits"), n.alias("commits"), ratio.alias("ratio"),
            F.lit(rule.description).alias("description"), F.coalesce(rule.evidence(hits, n, ratio), F.lit("")).alias("evidence"), files.alias("affected_files"), rule.when(hits, n, ratio).alias("fires"),
        ))
    return rule_counts(commits, changes).select(F.inline(F.array(*rows))).filter("fires").select(*RULE_COLUMNS)


def binary_paths(changes: DataFrame) -> DataFrame:
    return changes.filter(X.extension(F.col("path")).isin(*BINARY_SUFFIXES)).select("path").distinct()


def hotspot_files(commits: DataFrame, changes: DataFrame, share: float = 0.3, n: int | None = 5) -> DataFrame:
    """Paths with more changes than ``share`` of the commits, most first; all of them with ``n=None``."""
    total = commits.agg(F.count("*").alias("commits"))  # one row
    hot = changes.groupBy("path").agg(F.count("*").alias("changes")).crossJoin(F.broadcast(total)).filter(F.col("changes") > share * F.col("commits")).select("path", "changes")
    return hot if n is None else hot.orderBy(F.desc("changes"), "path").limit(n)


# --- quality gates ------------------------------------------------------------


# Default limits and severities of the gates.
@dataclass(frozen=True)
class Thresholds:
    """Limits of the gates.  The last four can be set but no gate reads them."""

    max_file_lines: int = 500
    max_imports: int = 15
    max_class_lines: int = 300
    max_class_methods: int = 20
    max_duplication_pct: float = 5.0
    min_test_coverage: float = 80.0
    max_function_lines: int = 50
    max_cyclomatic_complexity: int = 10
    max_cognitive_complexity: int = 15
    max_parameters: int = 5
    max_nesting_depth: int = 4
    min_maintainability_index: float = 20.0
    max_coupling: int = 10
    max_churn_rate: float = 0.5
    max_commit_size: int = 500


#: Gates on methods: the metric's column, the threshold and the severity.
METHOD_GATES = (
    ("max_function_lines", "lines", "warning"),
    ("max_cyclomatic_complexity", "cyclomatic", "error"),
    ("max_cognitive_complexity", "cognitive", "warning"),
    ("max_parameters", "parameters", "warning"),
    ("max_nesting_depth", "nesting", "warning"),
)
VIOLATION = "rule string, severity string, path string, line long, name string, value double, threshold double"


def _violations(frame: DataFrame, gates: list[tuple[str, Column, str]], t: Thresholds, path: Column, line: Column, name: Column) -> DataFrame:
    rows = []
    for rule, value, severity in gates:
        limit = float(getattr(t, rule))
        bad = value < limit if rule.startswith("min_") else value > limit
        rows.append(F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), path.alias("path"), line.cast("long").alias("line"), name.alias("name"), value.cast("double").alias("value"), F.lit(limit).alias("threshold"), bad.alias("bad")))
    return frame.select(F.inline(F.array(*rows))).filter("bad").drop("bad")


def gate_violations(methods: DataFrame, files: DataFrame | None = None, classes: DataFrame | None = None, ratios: DataFrame | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Every limit that a file, class, method or repository exceeds.

    ``methods(path, line, name, lines, cyclomatic, cognitive, parameters,
    nesting)``, ``files(path, total_lines, imports)``, ``classes(path, line, name,
    lines, methods)`` and a single row ``ratios(duplication, coverage)``, of which
    null values are not judged.
    """
    none = F.lit("")
    parts = []
    if files is not None:
        parts.append(_violations(files, [("max_file_lines", F.col("total_lines"), "warning"), ("max_imports", F.col("imports"), "warning")], thresholds, F.col("path"), F.lit(0), none))
    parts.append(_violations(methods, [(r, F.col(c), s) for r, c, s in METHOD_GATES], thresholds, F.col("path"), F.col("line"), F.col("name")))
    if classes is not None:
        parts.append(_violations(classes, [("max_class_lines", F.col("lines"), "warning"), ("max_class_methods", F.col("methods"), "warning")], thresholds, F.col("path"), F.col("line"), F.col("name")))
    if ratios is not None:
        parts.append(_violations(ratios, [("max_duplication_pct", F.col("duplication") * 100.0, "error"), ("min_test_coverage", F.col("coverage") * 100.0, "error")], thresholds, none, F.lit(0), none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def delta_violations(violations: DataFrame, changed: DataFrame) -> DataFrame:
    """Violations of the whole repository, and those in the changed files."""
    everywhere = violations.filter("path = ''")
    return everywhere.unionByName(violations.filter("path <> ''").join(changed.select("path"), "path", "left_semi").select(*violations.columns))
