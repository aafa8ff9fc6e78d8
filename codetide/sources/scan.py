"""File trees as tables: a listing without excluded paths, and their contents."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import languages as L
from ..shipping import ship

Observer = Callable[[int, str], None]


def ignore_patterns(root: str | Path) -> tuple[str, ...]:
    """The lines of the root's ignore file as plain shell patterns, without comments and blanks."""
    file = Path(root) / ".gitignore"
    if not file.is_file():
        return ()
    lines = (x.strip() for x in file.read_text(encoding="utf-8", errors="replace").splitlines())
    return tuple(x for x in lines if x and not x.startswith("#"))


def scan(spark: SparkSession, root: str | Path, patterns: Iterable[str] = L.DEFAULT_EXCLUDED, observers: Iterable[Observer] = (), partitions: int | None = None) -> DataFrame:
    """``(path, ordinal)`` of every file below ``root`` that no pattern leaves out.

    The walk runs on the driver, as hidden files are invisible to Spark's own
    file source; only names travel.  Observers are told of the count so far.
    """
    base = Path(root)
    if not base.is_dir():
        raise FileNotFoundError(f"no such folder: {base}")
    paths = []
    for folder, dirs, names in os.walk(base):
        dirs.sort()
        if ".git" in dirs:
            dirs.remove(".git")
        for name in sorted(names):
            paths.append((Path(folder, name).relative_to(base).as_posix(), len(paths)))
            for tell in observers:
                tell(len(paths), paths[-1][0])
    listed = spark.createDataFrame(paths, "path string, ordinal long")
    kept = listed.filter(~L.excluded(F.col("path"), tuple(dict.fromkeys((*patterns, *ignore_patterns(base))))))
    return kept.repartition(partitions) if partitions else kept


def read_contents(paths: DataFrame, root: str | Path) -> DataFrame:
    """``(path, content)``; content is null where a file can't be read.  ``root`` must be visible to executors."""
    ship(paths.sparkSession)
    base = str(root)

    def run(batches):
        for batch in batches:
            contents = []
            for path in batch.column(0).to_pylist():
                try:
                    contents.append(Path(base, path).read_bytes())
                except OSError:
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], names=["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")
