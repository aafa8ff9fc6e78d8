"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key scaled by its quality weight.  A source
takes whole epochs of its documents first; what is left of its target goes to
its documents in the order of their keys, up to the budget by prefix sums.

The prefix sums have two levels: keys fall into buckets by their logarithm, bucket
totals are summed up within a source, and only a bucket is ever sorted in one
task, however large the source.  Whatever the weights, no key's octave holds over
26 % of the rows with its weight, so steps of an octave bound every bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD_PATTERN, fresh, row_key, stage

#: Rows that a bucket holds at most, about, and the least steps of an octave.
PER_BUCKET, LEAST_STEPS = 200_000, 64

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words as runs of anything but 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes(source, source_size)``, a row for each source -> with ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes.  No target exceeds ``most`` times its source's
    size; the excess is shared among the others by weight until none does.  That
    is a water level: sources are filled up in the order of cap to weight.
    """
    total = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size")).withColumn("budget", share * F.sum("source_size").over(total))
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("below", F.coalesce(F.sum("cap").over(filling), F.lit(0)))
    rows = rows.withColumn("left", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(filling), F.lit(0)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("below")) / F.col("left"))
    # The level at the first source that it does not drown holds for all; from there on levels fall.
    holds = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(total)
    target = F.least(F.col("cap").cast("double"), F.coalesce(holds, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def uniform(seed: int, *columns: Column) -> Column:
    """A reproducible number in (0, 1) from the digest of the columns (52 bits)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weight: Column | None = None, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows: int | None = None) -> DataFrame:
    """Add ``mix_size, mix_source_size, mix_target, mix_copies`` to every row.

    ``mix_copies`` is how often the mix takes the document: the whole epochs that
    fit the target, and once more for the first documents by key.  The document
    on the budget's edge is taken if the middle of it lies within the budget, so
    a source misses its target by at most half that document.  ``weight`` is the
    quality weight, 1 by default; null and weights below 1e-6 count as 1e-6.
    ``size`` is the size of a document, its words by default.
    Documents without words are never taken.  Equal rows get equal keys, and one
    of them may be taken once more than the other.  Null sources are one source, and
    null ids share a key.  An empty table gives no rows.  Reruns agree.  Columns of
    ``docs`` with the names of added ones are replaced.  ``rows`` (the
    count of ``docs``, else counted) only sets the number of buckets.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(1e-6)), F.lit(1e-6))
    added = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
    key, bucket, source, upto, *known = fresh(docs, "mix_key", "mix_bucket", "mix_source", "mix_upto", "mix_before", "mix_all", "mix_aim")
    # ES keys are -ln(x) / w, smallest first.
    frame = docs.withColumn("mix_size", word_count(F.col(text_col)) if size is None else size).withColumn(key, -F.ln(uniform(seed, F.col(id_col))) / w)
    frame = frame.withColumn(bucket, key_bucket(F.col(key), docs.count() if rows is None else rows)).withColumn(source, F.struct(F.col(source_col).alias("name")))
    sums = frame.groupBy(F.col(f"{source}.name").alias("source"), F.col(bucket).alias("bucket")).agg(F.sum("mix_size").alias("bucket_size"))
    sized = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sized, weights, share, most)
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    plan = sums.withColumn("before", F.sum("bucket_size").over(running) - F.col("bucket_size"))
    plan = plan.join(targets.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    plan = plan.select(F.struct(F.col("source").alias("name")).alias(source), F.col("bucket").alias(bucket), *(F.col(c).alias(n) for c, n in zip(("before", "source_size", "target"), known, strict=True)))
    within = W.partitionBy(source, bucket).orderBy(key, F.col(id_col), "mix_size").rowsBetween(W.unboundedPreceding, 0)
    placed = frame.withColumn(upto, F.sum("mix_size").over(within)).join(plan, [source, bucket])
    before, source_size, target, own = *map(F.col, known), F.col("mix_size")
    epochs = F.when(source_size > 0, F.floor(target / source_size)).otherwise(F.lit(0)).cast("long")
    middle = before + F.col(upto) - own / 2
    copies = F.when(own > 0, epochs + F.when(middle <= target - epochs * source_size, 1).otherwise(0)).otherwise(0).cast("long")
    return placed.select(*(c for c in docs.columns if c not in added), *(c.alias(n) for n, c in zip(added, (own, source_size, target, copies), strict=True)))


def key_bucket(key: Column, rows: int) -> Column:
    """Steps of the key's octaves, as many as ``rows`` need; buckets are in the order of keys."""
    steps = max(LEAST_STEPS, -(-rows * 26 // (100 * PER_BUCKET)))
    return F.floor(F.log2(key) * steps).cast("long")


def quality_weights(docs: DataFrame, labels: DataFrame, good: float = 2.0, poor: float = 0.5) -> DataFrame:
    """Add ``mix_weight`` to ``docs``: ``good`` or ``poor`` by the mean of a document's quality labels, else 1."""
    key, quality = fresh(docs, "mix_id", "mix_quality")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias(key)).agg(F.avg("quality").alias(quality))
    rated = docs.join(marks, F.col("doc_id") == F.col(key), "left")
    value = F.when(F.col(quality) >= 0.5, good).when(F.col(quality) < 0.5, poor).otherwise(1.0)
    return rated.select(*(c for c in docs.columns if c != "mix_weight"), value.alias("mix_weight"))


def mix_rows(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each taken document as many times as it is taken, with its own columns alone.

    Decisions are made on ids, sizes and sources; texts move once, to meet them.
    Rows equal in id, source and text are taken in turn: together as often as the
    mix takes them, dealt to them as evenly as can be.  ``labels`` give the
    quality weights, all 1 without them.  ``docs`` is read twice and must have the
    same rows in each partition both times, as a stored table has.
    """
    row_id = row_key(F.col(id_col), F.col(source_col), F.coalesce(F.col(text_col), F.lit("")))
    row, place, number, copies, rows, first, turn, dealt = fresh(docs, *(f"mix_{n}" for n in ("row", "place", "number", "copies", "rows", "first", "turn", "dealt")))
    small = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), row_id.alias("row"), word_count(F.col(text_col)).alias("size"), F.spark_partition_id().alias("place"))
    small = stage(small, "mix-sizes")
    rated = small.withColumn("mix_weight", F.lit(1.0)) if labels is None else quality_weights(small, labels)
    mixed = mix(rated, F.col("mix_weight"), F.col("size"), rows=small.count(), **options)
    # Equal rows are told apart by the partition that they are read in, so that very many don't meet in one task.
    there = mixed.groupBy("row", "place").agg(F.sum("mix_copies").alias("copies"), F.count("*").alias("rows"))
    of_row = W.partitionBy("row")
    taken = there.select("row", "place", F.sum("copies").over(of_row).alias("copies"), F.sum("rows").over(of_row).alias("rows"), (F.sum("rows").over(of_row.orderBy("place").rowsBetween(W.unboundedPreceding, 0)) - F.col("rows")).alias("first"))
    taken = stage(taken.filter("copies > 0"), "mix-taken")
    taken = taken.select(F.col("row").alias(row), F.col("place").alias(place), F.col("copies").alias(copies), F.col("rows").alias(rows), F.col("first").alias(first))
    keyed = docs.withColumn(row, row_id).withColumn(place, F.spark_partition_id()).join(taken.hint("merge"), [row, place])
    # The remainder goes to the first rows in an arbitrary order: equal rows are alike.
    keyed = keyed.withColumn(turn, F.col(first) + F.row_number().over(W.partitionBy(row, place).orderBy(row)))
    keyed = keyed.withColumn(dealt, F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(turn) <= F.col(copies) % F.col(rows), 1).otherwise(0))
    return keyed.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(dealt).cast("int"))).alias(number)).select(*docs.columns)
