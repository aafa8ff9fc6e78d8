"""Line-by-line state machines by parallel prefix.

A parser that reads lines and keeps state, such as the last path it has seen or how many
lines it has counted, is a scan.  Lines are dealt to blocks; each block is folded to
what it does to the state (the last values it sets, the amounts it adds), these are
put together in the blocks' order, one row for each block, and each block is then
replayed from the state before it.  So one file is read by as many tasks as it
has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import checkpointing

#: Lines of a block where positions are numbers of lines.
BLOCK = 1 << 17
#: Rows of a task of :func:`carry`, about.
PER_TASK = 1 << 18


def numbered(texts: DataFrame, key: str, value: str = "value") -> DataFrame:
    """``(key, block, position, line)``: the lines of each text; a line feed at the end begins none."""
    parts = F.split(F.col(value), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    lines = texts.select(key, F.posexplode(parts).alias("position", "line"))
    return lines.select(key, F.floor(F.col("position") / BLOCK).alias("block"), F.col("position").cast("long").alias("position"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, block, position, line)`` of text files, each split of a file a block; positions grow within a block."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return rows.select("path", "block", F.monotonically_increasing_id().alias("position"), "line")


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``block`` and ``position`` to rows that have no lines to number, by the columns of their order.

    Blocks are ranges of the order with about as many rows each, whatever the values: Spark
    samples them for its range partitioning.  What it finds is kept, so that all uses agree.
    """
    checkpointing(rows.sparkSession)
    return rows.repartitionByRange(*order).withColumn("block", F.spark_partition_id().cast("long")).withColumn("position", F.struct(*order)).checkpoint()


def carry(
    rows: DataFrame, keys: list[str], last: dict[str, Column] | None = None, total: dict[str, Column] | None = None, most: dict[str, Column] | None = None, since: dict[str, tuple[Column, Column]] | None = None, block: str = "block", position: str = "position"
) -> DataFrame:
    """Add running values to every row, its own included: the last value that is not null, the sum, or the greatest value.

    ``since`` has pairs of an amount and a mark: the sum of the amounts after the last
    row with the mark, or of all where there is none yet.  Rows of a key go by ``block`` and
    ``position``.  The arguments name the new columns; sums begin at 0, the others at null.

    Rows are dealt out by key and block once, to tasks of about ``PER_TASK`` rows however
    many there are; a block's last row is what it is folded to.
    """
    last, total, most, since = last or {}, total or {}, most or {}, since or {}
    zero = F.lit(0).cast("long")
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PER_TASK))
    sums = {n: c for n, c in total.items()} | {n: c for n, (c, _) in since.items()}
    added = (*last, *sums, *most)
    given = {f"own_{n}": c for n, c in (*last.items(), *most.items())} | {f"own_{n}": c.cast("long") for n, c in sums.items()} | {f"mark_{n}": m for n, (_, m) in since.items()}
    others = [c for c in rows.columns if c not in (*keys, block)]
    group = F.struct(*keys, block)  # null keys are equal in it
    dealt = rows.select(group.alias("carry_group"), *others, *(c.alias(n) for n, c in given.items())).repartition(tasks, "carry_group")
    order = W.partitionBy("carry_group").orderBy(position)
    here = order.rowsBetween(W.unboundedPreceding, 0)
    running = {f"own_{n}": F.last(f"own_{n}", ignorenulls=True).over(here) for n in last} | {f"own_{n}": F.sum(f"own_{n}").over(here) for n in sums} | {f"own_{n}": F.max(f"own_{n}").over(here) for n in most}
    own = dealt.withColumns(running | {"carry_end": F.lead(F.lit(1)).over(order).isNull()})
    own = own.withColumns({f"mark_{n}": F.last(F.when(F.col(f"mark_{n}"), F.coalesce(f"own_{n}", zero)), ignorenulls=True).over(here) for n in since})
    ends = own.filter("carry_end").select("carry_group", *(f"own_{n}" for n in added), *(f"mark_{n}" for n in since))
    by_block = W.partitionBy(*(F.col("carry_group")[k] for k in keys)).orderBy(F.col("carry_group")[block])
    before = by_block.rowsBetween(W.unboundedPreceding, -1)
    states = {f"before_{n}": F.last(f"own_{n}", ignorenulls=True).over(before) for n in last} | {f"before_{n}": F.coalesce(F.sum(f"own_{n}").over(before), zero) for n in sums} | {f"before_{n}": F.max(f"own_{n}").over(before) for n in most}
    folded = ends.withColumns(states | {"carry_later": F.lag(F.lit(1)).over(by_block).isNotNull()})
    folded = folded.withColumns({f"before_mark_{n}": F.last(F.col(f"before_{n}") + F.col(f"mark_{n}"), ignorenulls=True).over(before) for n in since})
    folded = folded.filter("carry_later").select("carry_group", *states, *(f"before_mark_{n}" for n in since))
    joined = own.join(folded, "carry_group", "left")
    summed = {n: F.coalesce(f"own_{n}", zero) + F.coalesce(f"before_{n}", zero) for n in sums}
    marked = {n: F.coalesce(F.col(f"mark_{n}") + F.coalesce(f"before_{n}", zero), f"before_mark_{n}", zero) for n in since}
    found = {n: F.coalesce(f"own_{n}", f"before_{n}") for n in last} | {n: summed[n] for n in total} | {n: F.greatest(f"own_{n}", f"before_{n}") for n in most} | {n: summed[n] - marked[n] for n in since}
    kept = (F.col("carry_group")[c].alias(c) if c in (*keys, block) else F.col(c) for c in rows.columns if c not in added)
    return joined.select(*kept, *(c.alias(n) for n, c in found.items()))


def uncovered(points: DataFrame, intervals: DataFrame, key: str, at: str, first: str, last: str) -> DataFrame:
    """The rows of ``points`` that lie in no closed interval ``(key, first, last)`` of their key.

    Starts of intervals and points are put in one order.  A point is covered if the
    greatest end of the intervals that begin up to it reaches it, so one scan decides
    all, and neither the intervals of a key nor its points meet in one task.
    Points without key or place are in none.
    """
    ends = intervals.filter(F.col(key).isNotNull() & F.col(first).isNotNull()).select(F.col(key).alias("sweep_key"), F.col(first).alias("sweep_at"), F.lit(0).alias("sweep_kind"), F.col(last).alias("sweep_end"))
    asked = points.select(F.col(key).alias("sweep_key"), F.col(at).alias("sweep_at"), F.lit(1).alias("sweep_kind"), F.struct(*points.columns).alias("sweep_row"))
    both = in_order(asked.unionByName(ends, allowMissingColumns=True), "sweep_key", "sweep_at", "sweep_kind")
    swept = carry(both, ["sweep_key"], most={"sweep_reach": F.col("sweep_end")})
    return swept.filter("sweep_kind = 1 and not coalesce(sweep_reach >= sweep_at, false)").select("sweep_row.*")
