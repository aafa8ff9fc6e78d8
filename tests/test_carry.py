"""Scans in blocks against plain loops: adaptive blocks, hot keys, intervals."""

import datetime as dt
import random

from pyspark.sql import functions as F

from codetide.operators import carry as K, history as H


def test_running_values_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i // 7, i, rng.choice([None, i]), rng.randint(0, 3), rng.choice([None, rng.randint(-9, 9)])) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, block long, position long, v long, n long, m long").repartition(5)
    got = {r["position"]: (r["v_last"], r["n_sum"], r["m_most"]) for r in K.carry(frame, ["k"], {"v_last": F.col("v")}, {"n_sum": F.col("n")}, {"m_most": F.col("m")}).collect()}
    state = {}
    for k, _, i, v, n, m in rows:
        last, total, most = state.get(k, (None, 0, None))
        state[k] = (last if v is None else v, total + n, most if m is None else m if most is None else max(most, m))
        assert got[i] == state[k]
    assert K.carry(frame.limit(0), ["k"], total={"n_sum": F.col("n")}).count() == 0


def test_a_history_of_one_day_runs_in_many_tasks(spark):
    """All commits at one instant: blocks come from ordinals, and none holds much more than its share."""
    at = dt.datetime(2024, 1, 1, 12)
    commits = spark.range(4000).select(F.col("id").alias("sha"), F.lit(at).alias("authored_ts"), F.col("id").alias("ordinal"), (F.col("id") % 5).alias("insertions"), F.lit(1).cast("long").alias("deletions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these are far too few rows to fill blocks
    try:
        run_one_day(spark, commits)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def run_one_day(spark, commits):
    sizes = [r["count"] for r in K.in_order(commits.select("authored_ts", "ordinal"), "authored_ts", "ordinal").groupBy("block").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * 4000 / len(sizes)
    total, expected = 0, {}
    for i in range(4000):
        total += i % 5 - 1
        expected[i] = total
    assert {r["sha"]: r["value"] for r in H.loc_timeline(commits).collect()} == expected


def test_points_in_no_interval(spark):
    rng = random.Random(2)
    for n in (1, 300):
        spans = [(rng.choice(["a", "b", "hot"]), s, s + rng.randint(-1, 9)) for s in (rng.randint(0, 400) for _ in range(n))] + [(None, 0, 500), ("a", None, 5), ("b", 3, None)]
        points = [(rng.choice(["a", "b", "hot", "c", None]), rng.choice([None, rng.randint(0, 420)]), i) for i in range(400)] + [("a", 7, 1000)] * 2
        got = K.uncovered(spark.createDataFrame(points, "path string, line long, id long"), spark.createDataFrame(spans, "path string, first long, last long"), "path", "line", "first", "last")
        covered = lambda k, x: k is not None and x is not None and any(p == k and f is not None and e is not None and f <= x <= e for p, f, e in spans)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(p) for p in points if not covered(*p[:2]))


def test_one_path_with_very_many_intervals(spark):
    """Linear where one path has them all: no join of intervals with points, and the order is cut in blocks."""
    spans = spark.range(20_000).select(F.lit("hot").alias("path"), (F.col("id") * 10).alias("first"), (F.col("id") * 10 + 4).alias("last"))
    points = spark.range(200_000).select(F.lit("hot").alias("path"), F.col("id").alias("line"))
    found = K.uncovered(points, spans, "path", "line", "first", "last")
    assert found.count() == 100_000 and found.filter("line % 10 < 5").count() == 0


def test_sums_since_a_mark_over_blocks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", None]), i // 5, i, rng.randint(0, 3), rng.random() < 0.1) for i in range(150)]
    frame = spark.createDataFrame(rows, "k string, block long, position long, n long, mark boolean").repartition(4)
    got = {r["position"]: r["s"] for r in K.carry(frame, ["k"], since={"s": (F.col("n"), F.col("mark"))}).collect()}
    state = {}
    for k, _, i, n, mark in rows:
        state[k] = 0 if mark else state.get(k, 0) + n
        assert got[i] == state[k]


def test_rows_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(K, "PER_TASK", 100)
    frame = spark.range(2000).selectExpr("1L as k", "id div 10 as block", "id as position")
    out = K.carry(frame, ["k"], total={"n": F.lit(1)})
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 400 and out.agg(F.max("n")).first()[0] == 2000


def test_diffs_deal_their_lines_out_once(spark):
    from codetide.sources.logs import parse_diff

    diffs = spark.createDataFrame([(1, "diff --git a/x b/x\n+++ b/x\n@@ -5,2 +7,2 @@\n a\n-b\n+c\n")], "diff_id long, value string")
    plan = parse_diff(diffs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") <= 2
