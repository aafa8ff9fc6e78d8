"""Parsing of file tables: one pass of Arrow batches, then flat tables for each entity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import languages as L, text as X
from ..shipping import ship
from .base import Registry, default_registry

_PARAMETER = "struct<name: string, annotation: string, has_default: boolean>"
_METHOD = f"struct<name: string, line: long, end_line: long, lines: long, parameters: array<{_PARAMETER}>, cyclomatic: long, cognitive: long, nesting: long, is_constructor: boolean, docstring: string, decorators: array<string>>"
_CLASS = f"struct<name: string, line: long, end_line: long, lines: long, methods: array<{_METHOD}>, attributes: array<string>, bases: array<string>, docstring: string, decorators: array<string>>"
SCHEMA = f"path string, language string, size_bytes long, text string, error string, classes array<{_CLASS}>, functions array<{_METHOD}>, imports array<string>"

_P = pa.struct([("name", pa.string()), ("annotation", pa.string()), ("has_default", pa.bool_())])
_M = pa.struct([("name", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("lines", pa.int64()), ("parameters", pa.list_(_P)), ("cyclomatic", pa.int64()), ("cognitive", pa.int64()), ("nesting", pa.int64()), ("is_constructor", pa.bool_()), ("docstring", pa.string()), ("decorators", pa.list_(pa.string()))])
_C = pa.struct([("name", pa.string()), ("line", pa.int64()), ("end_line", pa.int64()), ("lines", pa.int64()), ("methods", pa.list_(_M)), ("attributes", pa.list_(pa.string())), ("bases", pa.list_(pa.string())), ("docstring", pa.string()), ("decorators", pa.list_(pa.string()))])


def decode(content: bytes) -> str:
    """UTF-8, or Latin-1 where that fails."""
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def parse_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """``files(path, content binary)`` -> the structure of each file.

    A file that a parser fails on keeps its row, without structure and with the
    error's text; unreadable (null) content counts as empty.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = registry or default_registry()
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py() or b""
                text = decode(content)
                language, parser = own.for_path(path or "")
                try:
                    found, error = parser(text).as_dict(), None
                except Exception as e:  # one bad file must not fail the scan
                    found, error = {"classes": [], "functions": [], "imports": []}, f"{type(e).__name__}: {e}"
                rows.append((path, language, len(content), text, error, found["classes"], found["functions"], found["imports"]))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(_C), pa.list_(_M), pa.list_(pa.string()))
            names = ("path", "language", "size_bytes", "text", "error", "classes", "functions", "imports")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    parsed = files.select("path", "content").mapInArrow(run, SCHEMA)
    language = F.when(F.col("language") == "generic", L.language_of(F.col("path"))).otherwise(F.col("language"))
    return parsed.withColumn("language", language)


def _prefix_groups() -> dict[tuple[str, ...], list[str]]:
    out: dict[tuple[str, ...], list[str]] = {}
    for suffix, language in L.suffix_languages().items():
        out.setdefault(L.comment_prefixes(language, suffix), []).append(suffix)
    return out


def file_rows(parsed: DataFrame) -> DataFrame:
    """A row of counts for each parsed file."""
    suffix = X.suffix(F.col("path"))
    counts = F.when(F.lit(False), X.loc_counts(F.col("text"), ("#",)))
    for prefixes, suffixes in _prefix_groups().items():
        if prefixes != ("#",):
            counts = counts.when(suffix.isin(*suffixes), X.loc_counts(F.col("text"), prefixes))
    counted = parsed.withColumn("n", counts.otherwise(X.loc_counts(F.col("text"), ("#",))))
    found = {"classes": F.size("classes"), "functions": F.size("functions"), "imports": F.size("imports")}
    return counted.select("path", "language", "size_bytes", "n.*", *(c.cast("long").alias(f"num_{n}") for n, c in found.items()), "error")


def class_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("path", F.posexplode("classes").alias("class_ordinal", "c"))
    return rows.select("path", F.col("class_ordinal").cast("long").alias("class_ordinal"), "c.name", "c.line", "c.end_line", "c.lines", F.size("c.methods").cast("long").alias("num_methods"), "c.attributes", "c.bases", "c.docstring", "c.decorators")


def method_rows(parsed: DataFrame) -> DataFrame:
    """Methods of all classes and free functions, the latter without a class."""
    inside = parsed.select("path", F.explode("classes").alias("c")).select("path", F.col("c.name").alias("class_name"), F.posexplode("c.methods").alias("method_ordinal", "m"))
    free = parsed.select("path", F.lit(None).cast("string").alias("class_name"), F.posexplode("functions").alias("method_ordinal", "m"))
    return inside.unionByName(free).select("path", "class_name", F.col("method_ordinal").cast("long").alias("method_ordinal"), "m.*")


def import_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("imports").alias("imported"))
