"""Duplicate blocks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as X


def windows(sources: DataFrame, n: int = 6) -> DataFrame:
    """``(path, line, block)`` for every window of ``n`` normalised lines; lines count from 1."""
    lines = sources.select("path", X.normalised_lines(F.col("text")).alias("lines"))
    return lines.select("path", F.posexplode(X.shingles(F.col("lines"), n)).alias("at", "block")).select("path", (F.col("at") + 1).cast("long").alias("line"), "block")


def duplicate_blocks(sources: DataFrame, n: int = 6) -> DataFrame:
    """Pairs of equal windows, each once; within a file they must lie ``n`` lines apart.

    Windows that occur once are dropped by their hash before any pair is made.
    """
    hashed = windows(sources, n).withColumn("hash", F.xxhash64("block"))
    common = hashed.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    repeated = hashed.join(common, "hash", "left_semi")
    a, b = (repeated.select("hash", "block", F.col("path").alias(f"file_{x}"), F.col("line").alias(f"line_{x}")) for x in "ab")
    pairs = a.join(b, ["hash", "block"])
    ordered = (F.col("file_a") < F.col("file_b")) | ((F.col("file_a") == F.col("file_b")) & (F.col("line_a") + n <= F.col("line_b")))
    return pairs.filter(ordered).select("file_a", "line_a", "file_b", "line_b", F.lit(n).cast("long").alias("length"))


def duplication_ratio(sources: DataFrame, n: int = 6) -> DataFrame:
    """Lines in all duplicate pairs, and their ratio to non-blank lines.

    The pairs are counted from window counts and never listed, so a block with
    many copies costs no more than its windows.
    """
    found = windows(sources, n)
    near = F.count("*").over(W.partitionBy("block", "path").orderBy("line").rangeBetween(1, n - 1))
    blocks = found.withColumn("near", near).groupBy("block").agg(F.count("*").alias("k"), F.sum("near").alias("near"))
    pairs = blocks.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1) / 2 - F.col("near")), F.lit(0)).cast("long").alias("pairs"))
    lines = sources.agg(F.coalesce(F.sum(F.size(X.normalised_lines(F.col("text")))), F.lit(0)).cast("long").alias("lines"))
    total = F.col("pairs") * n
    return pairs.crossJoin(lines).select(total.alias("duplicated_lines"), F.when(F.col("lines") > 0, total / F.col("lines")).otherwise(F.lit(0.0)).alias("ratio"))
