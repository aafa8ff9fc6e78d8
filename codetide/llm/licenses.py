"""License scans: phrase places, and an exact containment join with license notices.

A text block is a window of twice a template's length.  It matches if it contains
at least ``threshold`` of the template's different words.  Windows begin at every
word of the template, so wherever a window of that size matches, one is found.

The join is a set-similarity join.  Words are ordered by their frequency in the
corpus, rarest first.  A matching block must hold one of a template's first
``m - need + 1`` words (prefix filter), so only windows around those are looked
at; with at least ``need`` words of the template (length filter); and a window
slides on by as many words of the template as it lacks (positional filter).
Only words of templates can match, so the frequency table has a fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shipping import ship
from .license_texts import NOTICES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The share of a template's different words that a matching block holds.
THRESHOLD = 0.85

#: Phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Characters of templates at most: what is sent to the executors has a proven bound.
MOST_TEMPLATE_CHARS = 1 << 24

SCAN_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, start: long, stop: long, containment: double>>"


def license_words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z in lower case; null has none."""
    return WORD.findall((text or "").encode().lower())


@dataclass(frozen=True)
class Template:
    label: str
    #: Words as they stand, which set the block length.
    length: int
    #: Different words, rarest first.
    order: tuple[bytes, ...]
    need: int


class Scanner:
    """Everything a worker needs to scan one text; its size depends on the templates alone."""

    def __init__(self, notices, phrases: dict[str, str], threshold: float, frequency: dict[bytes, int]):
        rank = sorted({w for _, t in notices for w in license_words(t)}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(rank)}
        self.templates = []
        for label, text in notices:
            found = license_words(text)
            order = tuple(sorted(set(found), key=self.rank.__getitem__))
            self.templates.append(Template(label, len(found), order, ceil(threshold * len(order) - 1e-9)))
        self.prefix: dict[bytes, list[int]] = {}
        for k, t in enumerate(self.templates):
            for w in t.order[: len(t.order) - t.need + 1]:
                self.prefix.setdefault(w, []).append(k)
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for phrase, label in phrases.items():
            found = license_words(phrase)
            self.phrases.setdefault(found[-1], []).append((found, label))

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        """Starts and labels of the phrases, overlapping ones included."""
        ends = [i for i, w in enumerate(words) if w in self.phrases]
        return [(i + 1 - len(p), label) for i in ends for p, label in self.phrases[words[i]] if i + 1 >= len(p) and words[i + 1 - len(p) : i + 1] == p]

    def blocks(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, start, stop, containment) of the best block of each stretch of overlapping blocks that meet the threshold."""
        prefix, rank = self.prefix, self.rank
        anchors: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in prefix:
                for k in prefix[w]:
                    anchors.setdefault(k, []).append(i)
        if not anchors:
            return []
        known = [(i, w) for i, w in enumerate(words) if w in rank]
        out = []
        for k, found in sorted(anchors.items()):
            t = self.templates[k]
            own = set(t.order)
            hits = [(i, w) for i, w in known if w in own]
            if len({w for _, w in hits}) >= t.need:
                out += self._slide(t, hits, found)
        return out

    def _slide(self, t: Template, hits: list[tuple[int, bytes]], anchors: list[int]) -> Iterator[tuple[str, int, int, float]]:
        """Blocks that begin at a word of the template, one by one, with a count of the words that they hold."""
        held: dict[bytes, int] = {}
        size, end, anchor, skip = 2 * t.length, 0, 0, 0
        best: tuple[int, int] | None = None  # words in common, start
        reach = -1
        for begin, (start, first) in enumerate(hits):
            while end < len(hits) and hits[end][0] < start + size:
                held[hits[end][1]] = held.get(hits[end][1], 0) + 1
                end += 1
            if skip > 0:
                skip -= 1
            else:
                while anchor < len(anchors) and anchors[anchor] < start:
                    anchor += 1
                if anchor < len(anchors) and anchors[anchor] < start + size:
                    common = len(held)
                    if common >= t.need:
                        if best is not None and start >= reach:
                            yield t.label, best[1], best[1] + size, best[0] / len(t.order)
                            best = None
                        if best is None or common > best[0]:
                            best = common, start
                        reach = start + size
                    else:
                        # A step adds at most the words that enter, and what is missing must enter first.
                        after = end
                        while after < len(hits) and after - end < t.need - common:
                            after += 1
                        if after - end < t.need - common:
                            break
                        next_start = hits[after - 1][0] - size + 1
                        while begin + 1 + skip < len(hits) and hits[begin + 1 + skip][0] < next_start:
                            skip += 1
            if held[first] == 1:
                del held[first]
            else:
                held[first] -= 1
        if best is not None:
            yield t.label, best[1], best[1] + size, best[0] / len(t.order)

    def scan(self, text: str | None) -> tuple:
        words = license_words(text)
        base, blocks = self.places(words), self.blocks(words)
        starts = [s for s, _ in base]
        named = {label for _, label in base}
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)), ",".join(sorted(named | {b[0] for b in blocks})),
            max((b[3] for b in blocks), default=0.0), [dict(zip(("label", "start", "stop", "containment"), (b[0], b[1], min(b[2], len(words)), b[3]), strict=True)) for b in blocks],
        )


def corpus_frequency(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the vocabulary stands in all texts: a row for each word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(w for w in license_words(text.as_py()) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def default_templates(spark: SparkSession) -> DataFrame:
    """``(label, text)`` of the built-in texts."""
    return spark.createDataFrame(list(NOTICES), "label string, text string")


def template_list(templates: DataFrame) -> list[tuple[str, str]]:
    """The templates, in a fixed order; raises if they hold more than ``MOST_TEMPLATE_CHARS`` characters.

    Null labels, and texts without words, are left out, and repeated rows count once.
    """
    usable = templates.select("label", "text").filter(F.col("label").isNotNull() & F.col("text").isNotNull()).distinct()
    if (usable.agg(F.sum(F.length("label") + F.length("text"))).first()[0] or 0) > MOST_TEMPLATE_CHARS:
        raise ValueError(f"templates hold over {MOST_TEMPLATE_CHARS} characters")
    return sorted((r["label"], r["text"]) for r in usable.collect() if license_words(r["text"]))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, phrases: dict[str, str] = BASE_PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: phrase places, labels, best containment and the matching blocks.

    ``templates(label, text)`` are the built-in ones by default; see :func:`template_list`.
    Of blocks of a template that overlap, the first with the highest containment is
    listed.  ``first_word`` and ``last_word`` are null where no phrase stands, and
    ``score`` is 0 where no block matches.  Null and empty texts have no words.
    Repeated rows stay; an empty table gives no rows.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    notices = NOTICES if templates is None else template_list(templates)
    vocabulary = {w for _, t in notices for w in license_words(t)}
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(notices, phrases, threshold, corpus_frequency(docs, vocabulary, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.value.scan(t.as_py()) for t in batch.column(1)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())])))
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {SCAN_SCHEMA}").withColumnRenamed("id", id_col)
