"""Queries on event streams, run here over the whole table; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..shipping import ship
from ..streaming import totals as T, watch as S
from . import bridge as B
from .registry import query


def _events(spark, sf_dir):
    return B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _local(frame):
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("activity_windows", "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def activity_windows(spark, sf_dir):
    return _local(S.activity_windows(_events(spark, sf_dir))).select("start", "end", "event_type", "n", F.round("value", 6).alias("value"))


@query(
    "activity_sessions",
    """WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM marked)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM numbered GROUP BY user_id, k""",
)
def activity_sessions(spark, sf_dir):
    return _local(S.activity_sessions(_events(spark, sf_dir)))


@query(
    "watch_totals",
    """WITH own AS (SELECT user_id, event_type, CAST(floor(abs(coalesce(value, 0))) AS BIGINT) AS lines, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    changed AS (SELECT event_type AS language, count(*) AS changes FROM own GROUP BY event_type), last AS (SELECT event_type AS language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM own WHERE k = 1 GROUP BY event_type)
    SELECT language, coalesce(files, 0) AS files, coalesce(lines, 0) AS lines, changes FROM changed LEFT JOIN last USING (language)""",
)
def watch_totals(spark, sf_dir):
    """Events as changes of each user's file, as a stream that ends when all are read."""
    ship(spark)
    events = spark.readStream.schema(B.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    changes = events.select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("language"), F.floor(F.abs(F.coalesce("value", F.lit(0.0)))).cast("long").alias("lines"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    folder = shared_folder(spark, "watch")
    T.keep_totals(changes, f"{folder}/totals", f"{folder}/checkpoint").awaitTermination()
    return T.totals(spark, f"{folder}/totals")
