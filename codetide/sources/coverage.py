"""Coverage files: bitmaps in SQLite, else LCOV, else nothing."""

from __future__ import annotations

import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.carry import read_lines
from .logs import parse_lcov

LCOV_NAMES = ("lcov.info", "coverage.lcov")
SCHEMA = "path string, covered long, total long, ratio double"


def from_bitmaps(bitmaps: DataFrame) -> DataFrame:
    """``(path, numbits)`` -> coverage; the files say nothing of uncovered lines, so a covered file is whole."""
    counted = bitmaps.select("path", F.bitmap_count(F.coalesce("numbits", F.lit(b""))).alias("covered"))
    total = F.greatest(F.col("covered"), F.lit(1)).cast("long")
    return counted.select("path", "covered", total.alias("total"), F.bround(F.col("covered") / total, 4).alias("ratio"))


def read_bitmaps(spark: SparkSession, file: Path) -> DataFrame:
    """The first bitmap of each file of a coverage database."""
    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as db:
        rows = db.execute("select f.path, b.numbits from file f join line_bits b on b.file_id = f.id where b.rowid = (select min(rowid) from line_bits where file_id = f.id)").fetchall()
    return from_bitmaps(spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, numbits binary"))


def read_lcov(spark: SparkSession, file: Path) -> DataFrame:
    """Coverage of each record of a trace, which tasks read in splits."""
    return parse_lcov(read_lines(spark, str(file))).select(F.col("file").alias("path"), "covered", "total", "ratio")


def read(spark: SparkSession, root: str | Path) -> DataFrame:
    base = Path(root)
    if (base / ".coverage").is_file():
        try:
            return read_bitmaps(spark, base / ".coverage")
        except sqlite3.Error:
            pass
    for name in LCOV_NAMES:
        if (base / name).is_file():
            return read_lcov(spark, base / name)
    return spark.createDataFrame([], SCHEMA)
