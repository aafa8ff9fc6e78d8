"""Violations in the formats that build servers read."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.formats import teamcity_escape


def _number(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def message() -> Column:
    subject = F.coalesce(F.nullif("name", F.lit("")), F.nullif("path", F.lit("")), F.lit("repository"))
    return F.concat(subject, F.lit(" is "), _number(F.col("value")), F.lit(", limit "), _number(F.col("threshold")))


def gitlab_issues(violations: DataFrame) -> DataFrame:
    """Code-quality issues: severity as GitLab names it, a stable fingerprint, lines from 1."""
    severity = F.when(F.col("severity") == "error", "major").when(F.col("severity") == "warning", "minor").otherwise("info")
    return violations.select("rule", message().alias("description"), "path", F.greatest(F.col("line"), F.lit(1)).cast("long").alias("line"), F.md5(F.concat_ws(":", "rule", "path", F.col("line").cast("string"))).alias("fingerprint"), severity.alias("severity"))


def github_annotations(violations: DataFrame) -> DataFrame:
    """Workflow commands; parts that are empty are left out."""
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    place = F.concat_ws(",", F.when(F.col("path") != "", F.concat(F.lit("file="), F.col("path"))), F.when(F.col("line") > 0, F.concat(F.lit("line="), F.col("line").cast("string"))), F.concat(F.lit("title="), F.col("rule")))
    return violations.select(F.concat(F.lit("::"), level, F.lit(" "), place, F.lit("::"), message()).alias("annotation"))


def teamcity_messages(violations: DataFrame) -> DataFrame:
    """Service messages: an inspection for each violation, a build problem for each error."""
    escaped = {c: teamcity_escape(x) for c, x in (("rule", F.col("rule")), ("path", F.col("path")), ("text", message()))}
    level = F.when(F.col("severity") == "error", "ERROR").otherwise("WARNING")
    inspection = F.concat(F.lit("##teamcity[inspection typeId='"), escaped["rule"], F.lit("' message='"), escaped["text"], F.lit("' file='"), escaped["path"], F.lit("' line='"), F.col("line").cast("string"), F.lit("' SEVERITY='"), level, F.lit("']"))
    problem = F.concat(F.lit("##teamcity[buildProblem description='"), escaped["text"], F.lit("' identity='"), escaped["rule"], F.lit("']"))
    return violations.select(F.explode(F.array_compact(F.array(inspection, F.when(F.col("severity") == "error", problem)))).alias("message"))


def rules_seen(violations: DataFrame, ordinal: str) -> DataFrame:
    """The rules in the order in which they first occur."""
    return violations.groupBy("rule").agg(F.min(ordinal).alias("first")).orderBy("first").select("rule")


def step_summary(counts: list[tuple[str, str, int]]) -> str:
    rows = "".join(f"| {rule} | {severity} | {n} |\n" for rule, severity, n in counts)
    return "### Quality gates\n\n" + ("| Rule | Severity | Violations |\n| --- | --- | --- |\n" + rows if counts else "No violations.\n")


def _github(violations: DataFrame) -> str:
    return "".join(r[0] + "\n" for r in github_annotations(violations).toLocalIterator())


def _gitlab(violations: DataFrame) -> str:
    rows = [{"description": r["description"], "check_name": r["rule"], "fingerprint": r["fingerprint"], "severity": r["severity"], "location": {"path": r["path"], "lines": {"begin": r["line"]}}} for r in gitlab_issues(violations).toLocalIterator()]
    return json.dumps(rows, indent=2) + "\n"


def _teamcity(violations: DataFrame) -> str:
    return "".join(r[0] + "\n" for r in teamcity_messages(violations).toLocalIterator())


def _jenkins(violations: DataFrame) -> str:
    rows = violations.select("rule", "path", "severity", message().alias("message")).collect()
    cases = "".join(f"  <testcase classname={quoteattr(r['path'] or 'repository')} name={quoteattr(r['rule'])}><failure type={quoteattr(r['severity'])} message={quoteattr(r['message'])}/></testcase>\n" for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="quality-gates" tests="{len(rows)}" failures="{len(rows)}">\n{cases}</testsuite>\n'


#: Emitters by name, and the file that each writes; further ones can be registered.
ADAPTERS: dict[str, tuple[Callable[[DataFrame], str], str]] = {
    "github": (_github, "annotations.txt"),
    "gitlab": (_gitlab, "gl-code-quality-report.json"),
    "teamcity": (_teamcity, "teamcity.txt"),
    "jenkins": (_jenkins, "quality-gates.xml"),
}


def register(name: str, emit: Callable[[DataFrame], str], file: str) -> None:
    ADAPTERS[name] = (emit, file)


def emit(name: str, violations: DataFrame) -> str:
    if name not in ADAPTERS:
        raise ValueError(f"unknown build server {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name][0](violations)


def write_report(name: str, violations: DataFrame, folder: str | Path) -> Path:
    text = emit(name, violations)
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    (target / ADAPTERS[name][1]).write_text(text, encoding="utf-8")
    return target / ADAPTERS[name][1]
