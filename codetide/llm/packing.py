"""Best-fit packing of tokenized documents into fixed-length sequences.

Large-item matching: pieces above a third of the capacity share a sequence with
at most one other such piece, matched greedily from the longest down; shorter
pieces then best-fit the remaining gaps, longest first.

A packing depends on piece lengths alone, and there are at most ``capacity``
different ones.  So the plan is made on the histogram of lengths, in runs of
equal sequences, and has a size that does not grow with the corpus.  Pieces get
a rank among those of their length by a two-level count, and the plan turns
(length, rank) into (sequence, offset) without moving any other row.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..shipping import ship
from .common import buckets_for, fresh, parts, stage

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"
#: Runs of letters or of white space from this length on go to the library whose cost stays n log n.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
#: Characters of a text that are encoded at once.  Byte-level BPE files that split words before a
#: single space, as their pre-tokenizer does, give the same ids part by part.
PART = 1 << 20


# --- the plan -----------------------------------------------------------------


@dataclass(frozen=True)
class Run:
    """``bins`` sequences in a row, each holding ``pattern``: (length, copies) in order."""

    pattern: tuple[tuple[int, int], ...]
    bins: int


def match_large(counts: dict[int, int], capacity: int) -> list[Run]:
    """Greedy matching of the lengths above a third of the capacity; ``counts`` is used up."""
    runs, order = [], sorted(x for x in counts if 3 * x > capacity)
    while order:
        big = order[-1]
        n = counts[big]
        k = bisect_left(order, capacity - big + 1) - 1
        if k < 0:
            mate, pairs = 0, 0
        elif order[k] == big and n < 2:
            mate = order[k - 1] if k else 0
            pairs = min(n, counts[mate]) if mate else 0
        else:
            mate = order[k]
            pairs = n // 2 if mate == big else min(n, counts[mate])
        if not pairs:
            runs.append(Run(((big, 1),), n))
            counts[big] = 0
        elif mate == big:
            runs.append(Run(((big, 2),), pairs))
            counts[big] -= 2 * pairs
        else:
            runs.append(Run(((big, 1), (mate, 1)), pairs))
            counts[big] -= pairs
            counts[mate] -= pairs
        order = [x for x in order if counts[x]]
    return runs


def plan_bins(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs of equal sequences that hold every piece; lengths are 1 to ``capacity``."""
    counts = {x: n for x, n in counts.items() if n}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    open_runs: dict[int, list[Run]] = {}
    gaps: list[int] = []

    def put(run: Run, gap: int) -> None:
        if gap not in open_runs:
            open_runs[gap] = []
            insort(gaps, gap)
        open_runs[gap].append(run)

    for run in match_large(counts, capacity):
        put(run, capacity - sum(x * c for x, c in run.pattern))
    for x in sorted((x for x in counts if counts[x]), reverse=True):
        n = counts[x]
        while n:
            k = bisect_left(gaps, x)
            if k == len(gaps):
                put(Run((), -(-n // (capacity // x))), capacity)
                continue
            gap = gaps[k]
            run = open_runs[gap].pop()
            if not open_runs[gap]:
                del open_runs[gap]
                gaps.pop(k)
            each = min(gap // x, n)
            bins = min(run.bins, n // each)
            if bins < run.bins:
                put(Run(run.pattern, run.bins - bins), gap)
            put(Run((*run.pattern, (x, each)), bins), gap - each * x)
            n -= each * bins
    return [r for g in sorted(open_runs) for r in open_runs[g] if r.pattern]


def lookup_table(runs: list[Run]) -> dict[str, np.ndarray]:
    """Sorted arrays that give the place of the r-th piece of a length (see :func:`place`)."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for x, copies in run.pattern:
            rank = next_rank.get(x, 0)
            rows.append((x, rank, sequence, copies, offset))
            next_rank[x] = rank + copies * run.bins
            offset += x * copies
        sequence += run.bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "copies": table[:, 3], "offset": table[:, 4]}


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table["key"], (length << 44) + rank, side="right") - 1
    within = rank - table["rank"][at]
    copies = table["copies"][at]
    return table["sequence"][at] + within // copies, table["offset"][at] + (within % copies) * length


# --- tokens -------------------------------------------------------------------

_encoders: dict[str, object] = {}


class ByteBpe:
    """Ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    ``fast_path`` names the same vocabulary as ranks; where it is given, texts
    without very long runs are encoded by ``tiktoken``, which yields the same ids
    (tests compare every code point) in a third of the time.
    """

    def __init__(self, path: str, fast_path: str | None, special: dict[str, int], pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if fast_path:
            import tiktoken

            with open(fast_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def _part(self, text: str) -> list[int]:
        if self.fast is None or LONG_RUN.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")

    def ids(self, text: str) -> np.ndarray:
        """Token ids of the whole text, part by part where it is long, so that lists of ids stay short."""
        if self.fast is None or len(text) <= PART:
            return np.array(self._part(text), "<u4")
        return np.concatenate([np.array(self._part(p), "<u4") for p in parts(text, PART, drop=False)])


def encoder(path: str, fast_path: str | None, special: dict[str, int], pattern: str | None) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path, fast_path, special, pattern)
    return _encoders[path]


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = n_tokens - capacity * (-(-n_tokens // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n_tokens, capacity))]


def tokenize_pieces(docs: DataFrame, capacity: int, tokenizer: dict, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document: its id, place, length and the CRC-32 of its ids."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(**tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                raw = np.append(enc.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    for column, value in zip(out, (i, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
            keys = batch.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, f"id {kind}, {PIECE_SCHEMA}").withColumnRenamed("id", id_col)


# --- packing ------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, capacity: int, keys: list[str], length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    ``keys`` must tell the pieces apart up to rows that are equal in them; such
    rows get places in any order.  ``pieces`` is read twice, so it should be a
    stored table.  No pieces give no rows.  A null or out-of-range length raises.
    Columns of ``pieces`` that are named like the added ones are replaced.
    """
    spark = pieces.sparkSession
    ship(spark)
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most `capacity` rows
    if None in histogram:
        raise ValueError("piece lengths must lie between 1 and the capacity")
    table = spark.sparkContext.broadcast(lookup_table(plan_bins(histogram, capacity)))
    buckets = buckets_for(sum(histogram.values()))
    bucket, n, before_, rank_col = fresh(pieces, "pack_bucket", "pack_n", "pack_before", "pack_rank")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    keyed = pieces.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sums = keyed.groupBy(length_col, bucket).agg(F.count("*").alias(n))
    earlier = sums.withColumn(before_, F.sum(n).over(W.partitionBy(length_col).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)).drop(n)
    ranked = keyed.withColumn(rank_col, F.row_number().over(W.partitionBy(length_col, bucket).orderBy(*keys)) - 1)
    ranked = ranked.join(earlier, [length_col, bucket]).withColumn(rank_col, F.col(rank_col) + F.col(before_))
    ranked = ranked.select(*kept, rank_col)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length_col, rank_col))
            sequence, offset = place(table.value, length, rank)
            names = [c for c in batch.schema.names if c != rank_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*(pieces.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(placed, schema)


def pack_documents(docs: DataFrame, capacity: int, tokenizer: dict, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents.

    Null and empty texts are documents of the end id alone.  Repeated rows are
    separate documents.  An empty table gives no rows.  Other columns are ignored.
    """
    pieces = stage(tokenize_pieces(docs, capacity, tokenizer, end_id, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity, [id_col, "piece", "start", "ids_crc32"])
