"""A training corpus from raw documents: toxicity, near-dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which
:func:`run` writes as Parquet and reads again as the next stage's ``docs``.
All but the last return the columns of ``docs``, whatever others there are and
however they are named, and an empty table goes through all stages as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codetide.llm import mixing, packing, simhash, toxicity
from codetide.llm.common import drop_stage, fresh, read_table, stage
from codetide.llm.queries import CAPACITY, byte_bpe, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score lies below the cut.

    The model learns from labels outside the held-out third.  Null and empty texts
    have score 0 and stay, as does everything where labels don't suffice for a model.
    Repeated rows get one score and stay or go together; a score that ties with the cut goes.
    """
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    settings = toxicity.ToxicitySettings()
    model = toxicity.train_toxicity(docs.filter(~held_out()), labels.filter(~held_out()), settings)
    [score] = fresh(docs, "toxicity")
    return toxicity.score_texts(docs, model, out=score).filter(F.col(score) < settings.cut).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles.

    The row with the smallest id stays, null ids last.  Null, empty and wordless
    texts are one group; rows equal in id and text count as one.
    """
    return simhash.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words, null texts among them, are never taken.  Null sources
    are one source.  Repeated rows, and ties of the sampling key, are taken in turn.
    """
    return mixing.mix_rows(docs, read_table(spark, sf_dir, "labels"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are a piece of one end id; repeated rows are packed each.
    """
    return packing.pack_documents(docs, CAPACITY, byte_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Dictionaries, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    done = None
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name)
        if done is not None:
            drop_stage(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
