"""The whole analysis of a repository: a registry of tables, made lazily."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Settings
from .functions import text as X
from .operators import branches as O, duplication as D, history as H, rules as R, structure as S
from .parsers import tables as P
from .sources import coverage, git, scan


@dataclass
class Report:
    """Tables by name; what could not be made is missing, and ``problems`` says why."""

    root: Path
    tables: dict[str, DataFrame] = field(default_factory=dict)
    problems: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def register_views(self, prefix: str = "") -> None:
        for name, table in self.tables.items():
            table.createOrReplaceTempView(prefix + name)


def analyse_files(spark: SparkSession, root: Path, settings: Settings, observers=(), languages: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    listed = scan.scan(spark, root, settings.exclude, observers)
    parsed = P.parse_files(scan.read_contents(listed, root))
    if languages:
        parsed = parsed.filter(F.col("language").isin(*languages))
    parsed = parsed.cache()
    files = P.file_rows(parsed).join(listed, "path")
    classes, methods, imports = P.class_rows(parsed), P.method_rows(parsed), P.import_rows(parsed)
    languages = S.language_summary(files)
    abstract = S.abstractness(classes.select(X.parent_module(F.col("path")).alias("module"), "name", "bases"))
    edges = S.import_edges(imports, S.import_map(files))
    sources = parsed.select("path", "text")
    return {
        "files": files, "classes": classes, "methods": methods, "imports": imports, "languages": languages, "modules": S.module_rollup(files),
        "coupling": S.coupling(files.select(X.parent_module(F.col("path")).alias("module")), edges, abstract), "totals": S.repo_totals(files),
        "duplicates": D.duplicate_blocks(sources, settings.duplicate_lines), "duplication": D.duplication_ratio(sources, settings.duplicate_lines),
        "failed_files": parsed.filter("error is not null").select("path", "error"),
    }


def analyse_history(spark: SparkSession, root: Path, settings: Settings, now=None) -> dict[str, DataFrame]:
    commits, changes = git.commits(spark, str(root), settings.since or None, settings.max_commits)
    commits, changes = commits.cache(), changes.cache()
    default = git.default_branch(str(root))
    branches = git.branches(spark, str(root), default, settings.branches.target or None)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return {
        "commits": H.enrich(H.commit_churn(commits)), "changes": changes, "churn": H.file_churn(changes), "contributors": H.contributors(commits, changes, H.alias_map(commits)),
        "patterns": R.detect(commits, changes), "loc_timeline": H.loc_timeline(commits), "team_growth": H.team_growth(commits), "language_timeline": H.language_timeline(commits, changes),
        "branches": O.branch_report(branches, at, settings.branches.protected, settings.branches.stale_days, settings.branches.abandoned_days),
        "tags": O.version_tags(git.read(spark, str(root), "tags")), "work_hours": H.work_hours(commits), "work_weekdays": H.work_weekdays(commits), "streaks": H.commit_streaks(commits),
        "churn_percentiles": H.churn_percentiles(commits), **{kind: git.read(spark, str(root), kind) for kind in ("stashes", "worktrees", "notes")},
    }


def analyse(spark: SparkSession, root: str | Path, settings: Settings = Settings(), observers=(), languages: tuple[str, ...] = ()) -> Report:
    """All tables of a repository, of files in the given languages if there are any.  Without usable Git history only the files' tables are made."""
    report = Report(Path(root))
    report.tables |= analyse_files(spark, report.root, settings, observers, languages)
    report.tables["coverage"] = coverage.read(spark, root)
    try:
        report.tables |= analyse_history(spark, report.root, settings)
    except git.GitError as e:
        report.problems.append(str(e))
    return report


def violations(report: Report, settings: Settings) -> DataFrame:
    """Violations of all quality gates; coverage is judged only where there is some."""
    methods = report["methods"].select("path", "line", "name", "lines", "cyclomatic", "cognitive", F.size("parameters").alias("parameters"), "nesting")
    files = report["files"].select("path", "total_lines", F.col("num_imports").alias("imports"))
    classes = report["classes"].select("path", "line", "name", "lines", F.col("num_methods").alias("methods"))
    covered = report["coverage"].agg(F.when(F.count("*") > 0, F.sum("covered") / F.sum("total")).alias("coverage"))
    ratios = report["duplication"].select(F.col("ratio").alias("duplication")).crossJoin(covered)  # two single rows
    return R.gate_violations(methods, files, classes, ratios, settings.thresholds)
