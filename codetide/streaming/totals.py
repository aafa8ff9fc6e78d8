"""Watch mode that keeps state: what each path was last, so that a batch of changes updates totals without a rerun.

A value is kept for each path: language, lines and the time of its last change.  A
change gives the difference that it makes to the totals of its old and its new
language.  Differences are summed up for each batch and written to a folder of its own,
so a batch that is done again after a failure replaces what it wrote, and totals
are the sum of all folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE = "language string, lines long, at timestamp, seq long"
DELTAS = "language string, files long, lines long, changes long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastOfPath(StatefulProcessor):
    """The newest change of a path by ``at`` and ``seq``; one that comes late counts as a change only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getValueState("own", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.own.get() if self.own.exists() else None
        new, changes = old, {}
        for frame in rows:
            for language, lines, at, seq in zip(frame["language"], frame["lines"], frame["at"], frame["seq"], strict=True):
                changes[language] = changes.get(language, 0) + 1
                if new is None or (at, seq) > (pd.Timestamp(new[2]), new[3]):
                    new = (language, int(lines), at, int(seq))
        deltas = {language: [0, 0, n] for language, n in changes.items()}
        for state, sign in ((old, -1), (new, 1)):
            if state is not None and new is not old:
                own = deltas.setdefault(state[0], [0, 0, 0])
                own[0] += sign
                own[1] += sign * state[1]
        if new is not old:
            self.own.update((new[0], new[1], pd.Timestamp(new[2]).to_pydatetime(), new[3]))
        yield pd.DataFrame([(language, *d) for language, d in deltas.items()], columns=["language", "files", "lines", "changes"])

    def close(self) -> None:
        pass


def deltas(changes: DataFrame) -> DataFrame:
    """``DELTAS`` of a stream ``(path, language, lines, at, seq)``; ``seq`` decides between changes at one time.

    Changes without a path or a time are left out; null languages are ``''``, null lines 0.
    """
    rows = changes.filter("path is not null and at is not null").select("path", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines"), F.col("at").cast("timestamp").alias("at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"))
    return rows.groupBy("path").transformWithStateInPandas(LastOfPath(), DELTAS, "Update", "None")


def keep_totals(changes: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start to write each batch's differences below ``folder``; both folders must be on shared storage.

    A restart with the same checkpoint goes on where it stopped.  ``trigger`` is as for ``writeStream``.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # the store that such state needs

    def write(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("language").agg(*(F.sum(c).alias(c) for c in ("files", "lines", "changes")))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    return deltas(changes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """``(language, files, lines, changes)`` after all batches so far."""
    rows = spark.read.schema(DELTAS).parquet(folder)
    return rows.groupBy("language").agg(*(F.sum(c).cast("long").alias(c) for c in ("files", "lines", "changes"))).filter("changes <> 0 or files <> 0")
