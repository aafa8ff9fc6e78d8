"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded key and ranked.  Sorting all rows by
their fractional rank, the rank as a share of the source, interleaves the sources in
proportion, so that any stretch of the order has the mixture of the whole.  The
order is cut into shards whose row counts differ by at most one.

Both ranks have two levels: rows fall into buckets of (0, 1), bucket counts are
summed up, and only a bucket is sorted in one task, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import buckets_for, fresh
from .mixing import uniform

UP_TO = (W.unboundedPreceding, 0)


def interleave(docs: DataFrame, shards: int, ties: list[str], seed: int = 29, source_col: str = "source", rows: int | None = None) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (from 0 in each shard) to every row.

    ``ties`` are the columns that make up the shuffle key and break ties; rows
    equal in them get their slots in any order.  Null sources are one source.  An
    empty table gives no rows.  With fewer rows than shards some shards stay empty.  Columns of ``docs`` that
    are named like the added ones are replaced.  Reruns agree.
    """
    total = docs.count() if rows is None else rows
    buckets = buckets_for(total)
    names = ("source", "key", "bucket", "n", "before", "all", "rank", "share", "spot", "first", "order", "at", "shard")
    source_, key_, bucket_, n_, before_, all_, rank_, share_, spot_, first_, order_, at_, shard_ = fresh(docs, *(f"shard_{n}" for n in names))
    named = docs.withColumn(source_, F.struct(F.col(source_col).alias("name")))
    keyed = named.withColumn(key_, uniform(seed, *map(F.col, ties)))
    keyed = keyed.withColumn(bucket_, F.floor(F.col(key_) * buckets))
    sums = keyed.groupBy(source_, bucket_).agg(F.count("*").alias(n_))
    source = W.partitionBy(source_)
    plan = sums.select(source_, bucket_, (F.sum(n_).over(source.orderBy(bucket_).rowsBetween(*UP_TO)) - F.col(n_)).alias(before_), F.sum(n_).over(source).alias(all_))
    rank = F.row_number().over(W.partitionBy(source_, bucket_).orderBy(key_, *ties))
    ranked = keyed.withColumn(rank_, rank).join(plan, [source_, bucket_])
    # The rank's middle as a share of the source: (rank - 1/2) / rows.
    share = (2 * (F.col(before_) + F.col(rank_)) - 1) / (2 * F.col(all_))
    ranked = ranked.withColumn(share_, share.cast("double")).withColumn(spot_, F.floor(F.col(share_) * buckets))
    spots = ranked.groupBy(spot_).agg(F.count("*").alias(n_))
    spots = spots.select(spot_, (F.sum(n_).over(W.orderBy(spot_).rowsBetween(*UP_TO)) - F.col(n_)).alias(first_))
    order = F.row_number().over(W.partitionBy(spot_).orderBy(share_, source_, key_, *ties))
    placed = ranked.withColumn(order_, order).join(spots, spot_)
    at = (F.col(first_) + F.col(order_) - 1).cast("long")
    placed = placed.withColumn(at_, at).withColumn(shard_, F.expr(f"`{at_}` * {shards} div {max(1, total)}"))
    start = F.expr(f"(`{shard_}` * {total} + {shards - 1}) div {shards}")
    return placed.select(*(c for c in docs.columns if c not in ("shard", "slot")), F.col(shard_).cast("int").alias("shard"), (F.col(at_) - start).cast("long").alias("slot"))
