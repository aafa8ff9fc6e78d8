from collections import Counter

from codetide.llm import sharding
from pyspark.sql import functions as F


def check(rows, total, shards):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == total
    assert not rows or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    return counts


def test_shards_match_the_mixture(spark):
    source = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, "small").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")))
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit(1).alias("shard_hint"))
    rows = sharding.interleave(docs, 24, ["doc_id"]).collect()
    check(rows, 5000, 24)
    whole = Counter(r["source"] for r in rows)
    for s in range(24):
        own = Counter(r["source"] for r in rows if r["shard"] == s)
        assert all(abs(own[name] - n / 24) <= len(whole) for name, n in whole.items())
    again = sharding.interleave(docs.repartition(7), 24, ["doc_id"]).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] != sorted(r["doc_id"] for r in rows)


def test_odd_rows(spark):
    rows = [(1, None), (None, "a"), (2, "a"), (2, "a"), (2, "a"), (None, None), (3, "")]
    docs = spark.createDataFrame([(a, b, 5, 6) for a, b in rows], "doc_id long, source string, __n int, size int")
    for shards in (1, 2, 3, 24):
        out = sharding.interleave(docs.drop("__n"), shards, ["doc_id"])
        assert out.columns == ["doc_id", "source", "size", "shard", "slot"]
        check(out.collect(), 7, shards)
    assert sharding.interleave(docs.drop("__n").limit(0), 4, ["doc_id"]).count() == 0


def test_bucket_count_does_not_change_the_order(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("string").alias("source"))
    a = sharding.interleave(docs, 7, ["doc_id"]).collect()
    import codetide.llm.sharding as module

    old = module.buckets_for
    module.buckets_for = lambda n: 3
    try:
        b = sharding.interleave(docs, 7, ["doc_id"]).collect()
    finally:
        module.buckets_for = old
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
