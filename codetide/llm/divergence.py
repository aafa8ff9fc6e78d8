"""Source divergence audit by an inverted index of corrections to a baseline.

Each language keeps the terms that stand in enough of its documents, V of them.  A
(language, source) group with N occurrences of kept terms gives a term with
``count`` occurrences the share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, and
two shares differ by ``f(p, q) = floor((p - q)^2 / q)``.

Most sources lack most terms, so no pair of sources goes through the vocabulary.  A
pair starts at V times ``f`` of its two shares of zero counts, and the postings of a
term, the sources that have it, correct that:

* a source's term corrects all pairs of the source in the same way as its other
  terms of equal count, so these corrections are made from the counts' histogram;
* a term that two sources share adds what is left, ``f(p, q) - f(p, q0) - f(p0, q) +
  f(p0, q0)``, where that is not zero.

All of it is integer arithmetic.  A task holds one term's postings at a time, a row
for each source that has the term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..shipping import ship
from .common import stage

SCALE = 1_000_000_000
#: Letters in lower case; every other ASCII character becomes a space.  Bytes of other characters stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a text that are cut into terms at once.
PART = 1 << 22
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: Adds one document to a count.
DOCUMENT = 1 << 44
#: Groups at most that are sent to all executors; more are joined by a shuffle.
SENT_GROUPS = 100_000

COUNT_SCHEMA = "lang string, source string, term binary, n long, docs long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, part by part."""
    at = 0
    while at < len(text):
        part = text[at : at + PART].translate(LETTERS)
        at += len(part)
        if at < len(text):
            # The last term may go on; where one fills the part, it is read whole.
            cut = part.rfind(b" ") + 1
            if cut:
                at -= len(part) - cut
                part = part[:cut]
            else:
                while at < len(text) and LETTERS[text[at]] != 32:
                    more = text[at : at + PART].translate(LETTERS)
                    end = more.find(b" ")
                    part += more if end < 0 else more[:end]
                    at += len(more) if end < 0 else end
        yield part.split()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of terms, in parts that are yet to be summed up.

    Null texts, languages and sources count as empty ones.  Terms are bytes of UTF-8.
    """
    ship(docs.sparkSession)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source"), said(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own: Counter[bytes] = Counter()
                for found in terms(text.as_py()):
                    own.update(found)
                counts = held.setdefault((lang, source), {})
                size -= len(counts)
                for term, n in own.items():
                    counts[term] = counts.get(term, 0) + n + DOCUMENT
                size += len(counts)
                if size > HELD:
                    yield from _batches(held)
                    held, size = {}, 0
        yield from _batches(held)

    return rows.mapInArrow(run, COUNT_SCHEMA)


def _batches(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), counts in held.items():
        found = list(counts.items())
        for i in range(0, len(found), 50_000):
            some = found[i : i + 50_000]
            columns = [
                pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array([t for t, _ in some], pa.binary()),
                pa.array([c % DOCUMENT for _, c in some], pa.int64()), pa.array([c // DOCUMENT for _, c in some], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kept))``, exactly; null where nothing is kept."""
    all_ = F.nullif(total + kept, F.lit(0))
    whole = lambda c: c.cast("decimal(19,0)")
    large = F.call_function("div", whole(F.lit(SCALE)) * whole(count + 1), whole(all_))
    return F.when(count < (1 << 62) // SCALE, F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), all_)).otherwise(large) + 1


def apart(p: Column | str, q: Column | str) -> Column:
    """``floor((p - q)^2 / q)`` of longs."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.call_function("div", (p - q) * (p - q), q)


def postings(counts: DataFrame, least_docs: int) -> DataFrame:
    """``(lang, term, source, n, total, first)`` of the terms in at least ``least_docs`` documents of the language, stored.

    ``total`` is the language's count of the term, and one row of each term is the ``first``.
    """
    term = W.partitionBy("lang", "term")
    # One shuffle, by language and term, serves both the sums for a source and those for the language.
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    over = summed.select("lang", "term", "source", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return stage(over.filter(F.col("docs") >= least_docs).drop("docs"), "postings")


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (language, source) group.

    Part ``pair`` has the group's divergence from each other source of the language,
    0 where the language keeps no term.  Part ``term`` has the group's terms whose
    share is above the language's, up to ``most_terms``.  Ranks count from 1 for each
    group and part, by value from the largest, then by the item's UTF-8 bytes.

    Null texts, languages and sources count as empty ones; a group without terms has
    its pairs.  Repeated rows are documents of their own, other columns are ignored,
    and an empty table gives no rows.
    """
    index = postings(term_counts(docs, lang_col, source_col, text_col), least_docs)
    said = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    there = docs.select(said(lang_col, "lang"), said(source_col, "source")).distinct()
    own = index.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = index.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("n").alias("lang_n"))
    groups = there.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n", "kept", "lang_n"))).withColumn("p0", share(zero, F.col("n"), F.col("kept")))
    groups = stage(groups, "groups")
    sent = F.broadcast(groups) if groups.count() <= SENT_GROUPS else groups
    sizes = sent.select("lang", "source", F.col("n").alias("group_n"), "kept", "lang_n", "p0")
    placed = index.join(sizes, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("group_n"), F.col("kept")))
    return _terms(placed, most_terms).unionByName(_pairs(placed, sent))


def _terms(placed: DataFrame, most: int) -> DataFrame:
    found = placed.withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("kept"))).filter("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), apart("p", "q").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def _pairs(placed: DataFrame, groups: DataFrame) -> DataFrame:
    """Baseline, corrections for what one source has, corrections for what two share."""
    one = groups.select("lang", "source", "p0", "kept")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = one.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.coalesce(F.col("kept") * apart("p0", "q0"), F.lit(0)).alias("value"))
    counts = placed.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m"))
    met = counts.join(other, "lang").filter("source <> item")
    having = met.select("lang", "source", "item", (F.col("m") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    had = met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (apart("q0", "p") - apart("q0", "p0"))).alias("value"))
    a = placed.select("lang", "term", "source", "p", "p0")
    b = placed.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    rest = lambda p, p0, q, q0: apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)
    shared = a.join(b, ["lang", "term"]).filter("source < item").select("lang", "source", "item", rest("p", "p0", "q", "q0").alias("there"), rest("q", "q0", "p", "p0").alias("back"))
    shared = shared.filter("there <> 0 or back <> 0").groupBy("lang", "source", "item").agg(F.sum("there").alias("there"), F.sum("back").alias("back"))
    ways = shared.select("lang", F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("way"))
    value = base.unionByName(having).unionByName(had).unionByName(ways.select("lang", "way.*"))
    found = value.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
