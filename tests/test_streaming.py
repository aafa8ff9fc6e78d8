import datetime as dt

from codetide.streaming import watch as W


def test_watch_runs_for_each_batch_of_changes(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.py").write_text("x")
    runs = []
    query = W.watch(spark, root, lambda: runs.append(1), pause="100 milliseconds")
    try:
        query.processAllAvailable()
        assert len(runs) == 1
        (root / "notes.txt").write_text("ignored")
        query.processAllAvailable()
        assert len(runs) == 1
        (root / "b.py").write_text("y")
        query.processAllAvailable()
        assert len(runs) == 2
    finally:
        query.stop()


def test_windows_and_sessions(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(at, 1, "x", 1.0), (at + dt.timedelta(minutes=10), 1, "x", 2.0), (at + dt.timedelta(hours=3), 2, "x", 4.0), (at + dt.timedelta(days=2), 9, "y", 0.0)]
    spark.createDataFrame(rows, "ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    expected = {(r["n"], r["value"]) for r in W.activity_windows(table).collect()}
    assert expected == {(2, 3.0), (1, 4.0), (1, 0.0)}
    assert sorted(r["n"] for r in W.activity_sessions(table).collect()) == [1, 1, 2]
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    query = W.activity_windows(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["n"], r["value"]) for r in spark.table("windows").collect()} <= expected
