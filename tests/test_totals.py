"""Watch mode with state: batches, restarts and replays give the totals of the last change of each path."""

import random

from codetide.streaming import totals as T

SCHEMA = "path string, language string, lines long, at timestamp, seq long"


def expected(rows):
    last, changes = {}, {}
    for path, language, lines, at, seq in rows:
        if path is None or at is None:
            continue
        language, lines, seq = language or "", lines or 0, seq or 0
        changes[language] = changes.get(language, 0) + 1
        if path not in last or (at, seq) > last[path][0]:
            last[path] = (at, seq), language, lines
    return sorted((x, sum(1 for _, y, _ in last.values() if y == x), sum(n for _, y, n in last.values() if y == x), c) for x, c in changes.items())


def test_batches_and_restarts(spark, tmp_path):
    import datetime as dt

    rng = random.Random(6)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    rows = [(rng.choice(["a", "b", "c", "d/e", None]), rng.choice(["py", "js", None]), rng.choice([None, 0, 5, 900]), at(rng.randint(0, 40)), i) for i in range(90)] + [("a", "py", 3, None, 1)]
    source, folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/totals", f"{tmp_path}/checkpoint"
    for n, part in enumerate((rows[:30], rows[30:60], rows[60:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        T.keep_totals(stream, folder, checkpoint).awaitTermination()
        so_far = rows[: 30 * (n + 1)] if n < 2 else rows
        assert sorted(map(tuple, T.totals(spark, folder).collect())) == expected(so_far)
    # A batch that is written again replaces itself.
    again = spark.read.parquet(f"{folder}/batch=0").collect()
    spark.createDataFrame(again, T.DELTAS).write.mode("overwrite").parquet(f"{folder}/batch=0")
    assert sorted(map(tuple, T.totals(spark, folder).collect())) == expected(rows)
