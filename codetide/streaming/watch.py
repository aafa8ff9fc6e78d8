"""Watch mode: a full analysis at the start, then one for each batch of changed files."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

# Suffixes whose changes count, and the pause between batches.
SUFFIXES = ("py", "java", "js", "jsx", "ts", "tsx", "cpp", "cc", "c", "h", "hpp", "cs", "go", "m", "mm", "cxx")
PAUSE = "500 milliseconds"
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def changed_files(spark: SparkSession, root: str | Path, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """A stream of files that are new or were written anew, without their contents."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(str(root))
    return stream.select("path", "modificationTime", "length")


def watch(spark: SparkSession, root: str | Path, run: Callable[[], None], suffixes: tuple[str, ...] = SUFFIXES, checkpoint: str | None = None, pause: str = PAUSE) -> StreamingQuery:
    """Start to watch; ``run`` is called once for each batch that has changes, the first of which is the whole tree.

    Stop the returned query to end.  With a checkpoint folder a restart goes on
    where it stopped.
    """

    def on_batch(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            run()

    writer = changed_files(spark, root, suffixes).writeStream.foreachBatch(on_batch).trigger(processingTime=pause)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def activity_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", slide: str | None = None) -> DataFrame:
    """Events and authors for each window of event time; works on streams and on tables."""
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("authors"), F.sum("value").alias("value")).select("w.start", "w.end", "event_type", "n", "authors", "value")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Each author's sessions, which end after a pause of ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "w.end", "user_id", "n")
