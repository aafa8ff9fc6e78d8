"""Token counts through a digest cache.

The cache holds ``(content, tokenizer, n_tokens)``: the digest of a text, the
digest of the tokenizer's file, and the count.  A run joins the digests of its
texts to the cache, encodes each missing text once, appends the new counts, and
reads all counts from the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship
from .common import parts, scratch, stage

#: Characters of a text that sentencepiece gets at once, where the model lets texts be cut at spaces.
PART = 1 << 18

#: Missing digests that are sent to all executors at most, 32 bytes each; with more of them the texts are shuffled before the look-up.
SENT_DIGESTS = 100_000

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens long"

_libraries: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file: another file never reads these counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TokenizersCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)


class SentencePieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        # Where no piece has a space mark after another character and the mark of a text's first
        # word stands for its space, words apart by one space are encoded apart.
        apart = all("\u2581" not in self.library.id_to_piece(i).lstrip("\u2581") for i in range(self.library.get_piece_size()))
        probe = self.library.encode("a b")
        self.by_parts = apart and probe == self.library.encode("a") + self.library.encode("b")

    def count(self, text: str) -> int:
        if not self.by_parts or len(text) <= PART:
            return len(self.library.encode(text))
        return sum(len(self.library.encode(p)) for p in parts(text, PART, drop=True))


def counter(path: str) -> TokenizersCounter | SentencePieceCounter:
    """By the file's kind: ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    if path not in _libraries:
        kinds = {".json": TokenizersCounter, ".model": SentencePieceCounter}
        kind = next((k for ending, k in kinds.items() if path.endswith(ending)), None)
        if kind is None:
            raise ValueError(f"no library is known for {path}")
        _libraries[path] = kind(path)
    return _libraries[path]


def content_digest(text_col: str):
    """SHA-256 of the normalised content: the text as UTF-8, null as the empty text.

    The normalisation changes no character, since each could change the count.
    """
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far; a cache that has no file yet is empty.  Repeated entries agree."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def missing_texts(docs: DataFrame, missing: DataFrame, text_col: str = "text") -> DataFrame:
    """``(content, text)``: each text whose digest is in ``missing(content)``, once.

    Equal texts are put together before the shuffle, so that many copies of one are a row for each task.
    Where few digests are missing, only their texts are shuffled.
    """
    texts = docs.select(content_digest(text_col).alias("content"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    few = missing.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS
    if few:
        texts = texts.join(F.broadcast(missing), "content", "left_semi")
    once = texts.groupBy("content").agg(F.first("text").alias("text"))
    return once if few else once.join(missing, "content", "left_semi")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for every row, by whole texts.

    ``cache`` is the folder of the cache, on shared storage, by default a new one.
    Null and empty texts have no bytes and the tokens of the empty text.  Repeated
    rows stay, equal texts are encoded once, and the cache gets one row for each.
    An empty table gives no rows and adds nothing.  Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    cache = cache or scratch(spark, "token-cache")
    version = tokenizer_version(tokenizer)
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).select("content").distinct()
    keys = docs.select(F.col(id_col).alias("id"), content_digest(text_col).alias("content"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"))
    keys = stage(keys, "digests")
    missing = stage(keys.select("content").distinct().join(known, "content", "left_anti"), "missing")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = counter(tokenizer)
        for batch in batches:
            counts = [library.count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    missing_texts(docs, missing, text_col).mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stage(counts, "counts")  # as a stored table it leaves adaptive execution free to split the digest of many copies
    return keys.join(counts, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
