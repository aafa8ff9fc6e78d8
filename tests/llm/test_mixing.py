import math
import random

import pytest

from codetide.llm import mixing
from pyspark.sql import functions as F


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, free, fixed = share * sum(sizes.values()), set(names), {}
    while free:
        left = budget - sum(fixed.values())
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            return fixed | {s: level * w[s] for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
        free -= over
    return fixed


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 5, 100, rng.randint(1, 10_000)]) for i in range(rng.randint(1, 9))} | ({None: 50} if seed % 2 else {})
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    expected = brute_targets(sizes)
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[s], expected[s], abs_tol=1e-6) for s in got)


def documents(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "Z", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 200]))), source, 99))
    rows += [(5000, None, "a", 1), (None, "x y", None, 1), (7, "w w", "a", 1), (7, "w w", "a", 1), (6000, "w " * 9000, "only", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target long")


def test_sources_come_near_their_targets(spark):
    docs = documents(spark)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert sorted(map(str, out.collect())) == sorted(map(str, rows))
    by = {}
    for r in rows:
        assert r["mix_size"] == len((r["text"] or "").split()) and r["mix_copies"] * r["mix_size"] <= 2 * r["mix_size"]
        s = by.setdefault(r["source"], [0, 0, r["mix_target"], 0])
        s[0] += r["mix_size"] * r["mix_copies"]
        s[1] += r["mix_size"]
        s[3] = max(s[3], r["mix_size"])
        assert r["mix_source_size"] is not None
    expected = brute_targets({s: v[1] for s, v in by.items()})
    for s, (taken, _, target, largest) in by.items():
        assert math.isclose(target, expected[s], rel_tol=1e-9)
        assert abs(taken - target) <= largest / 2 + 1


def test_complete_epochs_come_first(spark):
    for r in mixing.mix(documents(spark)).collect():
        if r["mix_size"]:
            epochs = int(r["mix_target"] // r["mix_source_size"])
            assert r["mix_copies"] in (epochs, epochs + 1)


def test_weights_raise_the_odds(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(docs, weight=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share=0.5)
    good, poor = (out.filter(f"doc_id % 2 = {k}").agg(F.sum("mix_copies")).first()[0] for k in (0, 1))
    assert good + poor == 1000 * 2 and good > 2.5 * poor


def test_buckets_do_not_change_the_choice(spark):
    docs = documents(spark)
    few, many = (sorted((str(r["doc_id"]), r["mix_copies"]) for r in mixing.mix(docs, rows=n).collect()) for n in (1, 10**9))
    assert few == many


@pytest.mark.parametrize("weight", [None, 0.0, 1e-6, 0.01, 0.5, 1.0, 2.0, 1e6])
def test_no_bucket_is_large_whatever_the_weights(spark, weight):
    keys = spark.range(20_000).select((-F.ln(mixing.uniform(17, F.col("id"))) / F.greatest(F.coalesce(F.lit(weight).cast("double"), F.lit(1e-6)), F.lit(1e-6))).alias("k"))
    most = keys.groupBy(mixing.key_bucket(F.col("k"), 20_000)).count().agg(F.max("count")).first()[0]
    assert most <= 2 * 20_000 / 256
    assert keys.select(F.corr("k", mixing.key_bucket(F.col("k"), 1).cast("double"))).first()[0] > 0


def test_a_row_repeated_many_times_is_dealt_from_several_places(spark):
    rows = spark.range(0, 3000, 1, 6).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two").alias("text"), F.lit("s").alias("source"), F.col("id").cast("string").alias("mix_row"))
    others = spark.range(3000).select((F.col("id") + 10).alias("doc_id"), F.lit("w w w w").alias("text"), F.lit("t").alias("source"), F.lit("x").alias("mix_row"))
    docs = rows.unionByName(others)
    taken = {r["doc_id"]: r["n"] for r in mixing.mix_rows(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    expected = {r["doc_id"]: r["n"] for r in mixing.mix(docs).groupBy("doc_id").agg(F.sum("mix_copies").alias("n")).collect()}
    assert taken[1] == expected[1] and sum(taken.values()) == sum(expected.values())
    each = [r["n"] for r in mixing.mix_rows(docs).filter("doc_id = 1").groupBy("mix_row").agg(F.count("*").alias("n")).collect()]
    assert max(each) - min(each + [max(each)] if len(each) == 3000 else [1]) <= 1


def test_null_ids_and_the_text_null_differ(spark):
    docs = spark.createDataFrame([(None, "w w", "s"), ("null", "w w", "s"), ("null", "w w", None), ("x", "w w w w", "null")], "doc_id string, text string, source string")
    out = [tuple(r) for r in mixing.mix_rows(docs).collect()]
    copies = {tuple(r)[:3]: r["mix_copies"] for r in mixing.mix(docs).collect()}
    assert all(out.count(k) == n for k, n in copies.items())


def test_rows_of_the_mix(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    out = mixing.mix_rows(docs, labels)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r["doc_id"], r["text"], r["source"]] = taken.get((r["doc_id"], r["text"], r["source"]), 0) + 1
    rated = mixing.quality_weights(docs, labels)
    expected = {}
    for r in mixing.mix(rated, F.col("mix_weight")).collect():
        if r["mix_copies"]:
            key = (r["doc_id"], r["text"], r["source"])
            expected[key] = expected.get(key, 0) + r["mix_copies"]
    assert taken == expected


def test_empty(spark):
    docs = documents(spark).limit(0)
    assert mixing.mix(docs).count() == 0 and mixing.mix_rows(docs).count() == 0
    wordless = spark.createDataFrame([(1, " ", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [r["mix_copies"] for r in mixing.mix(wordless).collect()] == [0, 0]
