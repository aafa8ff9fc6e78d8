"""The catalogue of columns that reports can be ordered by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

# Entity, column, type, and whether the largest come first.
COLUMNS = (
    ("file", "path", "string", False),
    ("file", "language", "string", False),
    ("file", "total_lines", "integer", True),
    ("file", "code_lines", "integer", True),
    ("file", "blank_lines", "integer", True),
    ("file", "comment_lines", "integer", True),
    ("file", "comment_ratio", "float", True),
    ("file", "num_classes", "integer", True),
    ("file", "num_functions", "integer", True),
    ("class", "name", "string", False),
    ("class", "line", "integer", False),
    ("class", "lines", "integer", True),
    ("class", "num_methods", "integer", True),
    ("class", "num_attributes", "integer", True),
    ("class", "num_constructors", "integer", True),
    ("method", "name", "string", False),
    ("method", "line", "integer", False),
    ("method", "lines", "integer", True),
    ("method", "cyclomatic_complexity", "integer", True),
    ("method", "cognitive_complexity", "integer", True),
    ("method", "nesting_depth", "integer", True),
    ("method", "num_parameters", "integer", True),
    ("method", "is_constructor", "boolean", False),
    ("language", "language", "string", False),
    ("language", "file_count", "integer", True),
    ("language", "total_lines", "integer", True),
    ("language", "code_lines", "integer", True),
    ("language", "blank_lines", "integer", True),
    ("language", "comment_lines", "integer", True),
    ("module", "name", "string", False),
    ("module", "path", "string", False),
    ("module", "file_count", "integer", True),
    ("coupling", "name", "string", False),
    ("coupling", "afferent", "integer", True),
    ("coupling", "efferent", "integer", True),
    ("coupling", "instability", "float", True),
    ("coupling", "abstractness", "float", True),
    ("coupling", "distance", "float", True),
    ("churn", "path", "string", False),
    ("churn", "commit_count", "integer", True),
    ("churn", "insertions", "integer", True),
    ("churn", "deletions", "integer", True),
    ("churn", "churn_score", "integer", True),
    ("coverage", "path", "string", False),
    ("coverage", "covered_lines", "integer", True),
    ("coverage", "total_lines", "integer", True),
    ("coverage", "coverage_ratio", "float", True),
    ("commit", "sha", "string", False),
    ("commit", "author_name", "string", False),
    ("commit", "authored_date", "date", True),
    ("commit", "insertions", "integer", True),
    ("commit", "deletions", "integer", True),
    ("commit", "churn_score", "integer", True),
    ("commit", "message", "string", False),
    ("branch", "name", "string", False),
    ("branch", "status", "string", False),
    ("branch", "commits_ahead", "integer", True),
    ("branch", "commits_behind", "integer", True),
    ("branch", "deletability_score", "float", True),
    ("branch", "author_name", "string", False),
    ("contributor", "name", "string", False),
    ("contributor", "email", "string", False),
    ("contributor", "commit_count", "integer", True),
    ("contributor", "insertions", "integer", True),
    ("contributor", "deletions", "integer", True),
    ("contributor", "files_touched", "integer", True),
    ("contributor", "active_days", "integer", True),
    ("pattern", "name", "string", False),
    ("pattern", "severity", "string", False),
    ("pattern", "description", "string", False),
)

# What the columns hold, in words of our own.
DESCRIPTIONS = {
    "path": "Where the file lies",
    "language": "Language by suffix or name",
    "total_lines": "All lines",
    "code_lines": "Lines that are neither blank nor comments",
    "blank_lines": "Lines of white space",
    "comment_lines": "Lines that begin as comments",
    "comment_ratio": "Comment lines as a share of all",
    "num_classes": "Classes in the file",
    "num_functions": "Functions outside classes",
    "name": "Name",
    "line": "First line",
    "lines": "Length in lines",
    "num_methods": "Methods",
    "num_attributes": "Attributes set in methods",
    "num_constructors": "Constructors",
    "cyclomatic_complexity": "Branches plus one",
    "cognitive_complexity": "Branches weighed by nesting",
    "nesting_depth": "Deepest nesting",
    "num_parameters": "Parameters",
    "is_constructor": "Whether it constructs",
    "file_count": "Files",
    "afferent": "Modules that import it",
    "efferent": "Modules that it imports",
    "instability": "Efferent as a share of both",
    "abstractness": "Abstract classes as a share of all",
    "distance": "How far abstractness and instability are from one in sum",
    "commit_count": "Commits",
    "insertions": "Lines added",
    "deletions": "Lines removed",
    "churn_score": "Lines added and removed",
    "covered_lines": "Lines that tests reach",
    "coverage_ratio": "Covered lines as a share of all",
    "sha": "Commit",
    "author_name": "Author",
    "authored_date": "When it was written",
    "message": "Message",
    "status": "Active, stale or abandoned",
    "commits_ahead": "Commits that the target lacks",
    "commits_behind": "Commits that only the target has",
    "deletability_score": "How safe it is to delete, to 100",
    "email": "Address",
    "files_touched": "Different files changed",
    "active_days": "Days with commits",
    "severity": "Severity",
    "description": "What was found",
}



@dataclass(frozen=True)
class SortAttribute:
    key: str
    sort_type: str
    entity: str
    default_descending: bool

    @property
    def column(self) -> str:
        return self.key.partition(".")[2]

    @property
    def label(self) -> str:
        return self.column.replace("_", " ").title()

    @property
    def description(self) -> str:
        return DESCRIPTIONS[self.column]

    def of(self, frame: DataFrame) -> Column:
        """The column of a frame that this attribute orders."""
        return frame[self.column]


def attributes() -> tuple[SortAttribute, ...]:
    return tuple(SortAttribute(f"{entity}.{column}", kind, entity, falling) for entity, column, kind, falling in COLUMNS)


def entity_names() -> tuple[str, ...]:
    return tuple(dict.fromkeys(entity for entity, *_ in COLUMNS))


def for_entity(entity: str) -> tuple[SortAttribute, ...]:
    return tuple(a for a in attributes() if a.entity == entity)


def by_key(key: str) -> SortAttribute:
    for a in attributes():
        if a.key == key:
            return a
    raise KeyError(key)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.key, a.label, a.sort_type, a.entity, a.default_descending) for a in attributes()], "key string, label string, sort_type string, entity string, default_descending boolean")


def order_by(frame: DataFrame, key: str, descending: bool | None = None) -> DataFrame:
    """``frame`` ordered by a catalogued column; ties go by all other columns."""
    a = by_key(key)
    down = a.default_descending if descending is None else descending
    ties = [c for c in frame.columns if c != a.column]
    return frame.orderBy(a.of(frame).desc() if down else a.of(frame).asc(), *ties)
