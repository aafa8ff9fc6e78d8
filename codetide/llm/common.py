"""What the corpus operators share: a shared working folder and staged tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shipping import ship

#: Bytes that separate words in the operators that count or shingle words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A space that stands alone between two characters that are no white space.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the setting is missing, a local session gets a temporary folder; a
    cluster session raises, since a machine-local folder would lose rows there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="codetide-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the session's process ends."""
    path = f"{shared_dir(spark)}/codetide-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone: nothing is left to ask
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a table that outlives executors, unlike a local
    checkpoint, and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(*frames: DataFrame) -> None:
    """Remove tables that :func:`stage` wrote and nothing reads any more."""
    for frame in frames:
        for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if "/codetide-" in path:
                drop_path(frame.sparkSession, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``frame`` is called so (whatever the case)."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(text: str, size: int, drop: bool) -> Iterator[str]:
    """Cut a text before lone spaces, into parts of about ``size`` characters; ``drop`` leaves those spaces out.

    Together the parts are the whole text.  A stretch without lone spaces stays in one part.
    """
    at = 0
    while len(text) - at > size:
        cut = _LONE_SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end() if drop else cut.start()
    yield text[at:]


def row_key(*columns: Column) -> Column:
    """A digest of the columns' values as strings, in which null differs from any text."""
    return F.md5(F.concat_ws(":", *(F.coalesce(F.md5(c.cast("string")), F.lit("null")) for c in columns)))


def buckets_for(rows: int, per_bucket: int = 200_000, least: int = 256, most: int = 1 << 20) -> int:
    """How many buckets two-level ranking needs so that a bucket of the hottest key stays small."""
    return max(least, min(most, -(-rows // per_bucket)))
