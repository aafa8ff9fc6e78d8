"""Session defaults: UTC, adaptive execution, and as many shuffle partitions as the cluster can use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, app: str = "codetide", **settings: str) -> SparkSession:
    """A session with the engine's defaults; ``settings`` use ``__`` for dots and win over them."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.appName(app).config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()


def checkpointing(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: by spark.checkpoint.dir, or in a local session by a temporary folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codetide-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which the driver and all executors see."""
    checkpointing(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table below the checkpoint folder and read back: computed once, and its lineage is cut."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
