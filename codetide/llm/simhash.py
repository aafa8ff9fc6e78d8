"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints are cut into segments.  For each segment the small Hamming balls
around its values are enumerated, table matches on them are fetched, and the
complete distance of each match is verified.

Two searches are here:

* :func:`near_links` is exact for small distances.  64 bits in two segments and
  distance 2 mean that one segment differs in at most one bit, so balls of radius
  1 find every pair.  Where more fingerprints share a segment value than
  ``hot`` says, their pairs are not listed: each such fingerprint publishes the
  one-bit ball of its whole fingerprint, and all that publish the same word are
  within two bits of each other, so a link to the smallest of them loses nothing.
* :func:`keep_one_per_group` serves similarity thresholds.  It begins with the
  fingerprints' matches of the first search and verifies the similarity of each.  At
  0.8 distances go far beyond what balls can reach, so a search by prefixes of the
  shingle sets finds the pairs that are left, which makes it exact: see :func:`prefixes`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..shipping import ship
from .common import drop_stage, fresh, row_key, stage
from .components import components

SEED = 42
#: Shingles that are turned to bits at once; bounds a worker's memory.
CHUNK = 1 << 16


# --- fingerprints -------------------------------------------------------------


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_bounds(text: str, n: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text, one space between them, and where each word n-gram starts and ends in that.

    A-Z are in lower case; words are split at the ASCII white space bytes 0x20 and
    0x09-0x0D.  Fewer words than ``n`` give the whole sequence, none give no
    shingle.  Memory is a small multiple of the text, whatever its words.
    """
    flat = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = _SPACE[flat]
    # Of each gap its last space stays, unless it begins or ends the text.
    keep = ~space
    keep[:-1] |= space[:-1] & ~space[1:]
    if len(flat) and (lead := int(np.argmin(space))) and not space[lead]:
        keep[:lead] = False
    flat, space = flat[keep], space[keep]
    if not len(flat):
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(space)
    if len(gaps):
        flat = flat.copy()
        flat[gaps] = 0x20
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(flat))
    if len(starts) <= n:
        return flat.tobytes(), starts[:1], ends[-1:]
    return flat.tobytes(), starts[: len(starts) - n + 1], ends[n - 1 :]


def shingles(text: str, n: int) -> list[bytes]:
    """Word n-grams, repeats included; see :func:`shingle_bounds`."""
    flat, starts, ends = shingle_bounds(text, n)
    return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, in pieces of at most ``CHUNK``."""
    flat, starts, ends = shingle_bounds(text, words)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        spans = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        yield np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64)


def bit_margins(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """For each bit, highest first: twice the hashes that set it, less all; no shingles give zeros."""
    sums, n = np.zeros(64, np.int64), 0
    for part in hashes:
        sums += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
        n += len(part)
    return 2 * sums - n


def fingerprint(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of :func:`shingle_hashes`, as a long."""
    return int(np.packbits(bit_margins(hashes) > 0).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` for every row: a bit is set if over half the shingles' hashes set it.

    A text without words (null, empty, white space) has the fingerprint zero.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                out[i] = fingerprint(shingle_hashes(text.as_py() or "", words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


# --- small distances ----------------------------------------------------------


def _segments(fp: Column) -> list[Column]:
    """The two halves, each tagged with its place in bit 32."""
    low = F.lit(0xFFFFFFFF)
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(low).bitwiseOR(F.lit(1 << 32))]


def _raised(segment: Column) -> Column:
    """The segment with each of its 0 bits set in turn.

    Of two segments that differ in one bit, the one with a 0 there raises it to
    the other, so balls of radius 1 need only go upwards to meet each pair once.
    """
    bits = F.array(*(F.lit(1 << i) for i in range(32)))
    return F.transform(F.filter(bits, lambda b: segment.bitwiseAND(b) == 0), lambda b: segment.bitwiseOR(b))


def near_links(prints: DataFrame, distance: int = 2, hot: int = 64, name: str = "simhash") -> DataFrame:
    """``(u, v)`` such that the components of the links are those of all pairs within ``distance``.

    ``prints`` has one row for each different ``fp`` and should be a stored
    table.  ``distance`` is at most 3, which is what balls of radius 1 in two
    segments reach.  At the usual distance, 2, values with over ``hot`` members
    have the linear path; at others all pairs of a value are compared.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments and balls of radius 1 reach distances up to 3")
    fp = F.col("fp")
    table = prints.select("fp", F.explode(F.array(*_segments(fp))).alias("key"))
    probes = prints.select("fp", F.explode(F.concat(F.array(*_segments(fp)), *map(_raised, _segments(fp)))).alias("key"))
    members = None
    if distance == 2:
        crowded = stage(table.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("key"), f"{name}-hot")
        if not crowded.isEmpty():
            members = probes.join(crowded, "key", "left_semi").select("fp").distinct()
            table, probes = (side.join(crowded, "key", "left_anti") for side in (table, probes))
    found = probes.join(table.select("key", F.col("fp").alias("other")), "key")
    found = found.filter((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    links = found.select(F.col("fp").alias("u"), F.col("other").alias("v"))
    return links if members is None else links.unionByName(_clique_links(members))


def _clique_links(members: DataFrame) -> DataFrame:
    """Links among ``members`` at distance 2: all whose one-bit balls share a word are that close to each other."""
    fp = F.col("fp")
    bits = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)))
    published = members.select("fp", F.explode(F.concat(F.array(fp), F.transform(bits, lambda b: fp.bitwiseXOR(b)))).alias("word"))
    least = published.groupBy("word").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least <> most").select("word", "least")
    return published.join(least, "word").filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def group_near(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` for every row; see :func:`fingerprints` and :func:`near_links`.

    ``component_id`` is the smallest id that links reach from the row, itself
    included.  Rows with equal fingerprints are one node, so copies are never
    paired up.  Null ids keep their row; a component of null ids alone has a null
    id.  Repeated rows stay.  An empty table gives no rows.
    """
    prints = stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), distance), "simhash").withColumnRenamed("node", "fp")
    labelled = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stage(labelled.join(named, "root").select("fp", "component_id"), "labels")
    return prints.join(by_print, "fp").select(id_col, "fp", "component_id")


# --- similarity thresholds ----------------------------------------------------

#: Texts whose shingles are counted, about, and how many of the most common ones are kept.
COUNTED_TEXTS = 20_000
COMMON = 1 << 16
#: Shingles in fewer counted texts than this are not common.
LEAST_COMMON = 3
#: Rows whose hashes are sent to all executors at most.
FEW_ROWS = 1 << 20


def hash_set(text: str, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, smallest first."""
    return _different(shingle_hashes(text, words))


def _different(hashes: Iterable[np.ndarray]) -> np.ndarray:
    parts = [np.unique(p) for p in hashes]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most common shingles of ``docs(text)``, smallest first, and in how many of the counted texts each is.

    They only settle the order of shingles in :func:`prefixes`.  Any order gives the
    same result; with common shingles last, fewer pairs have to be compared.
    """
    share = min(1.0, COUNTED_TEXTS / max(1, docs.count()))
    counted = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1_000_000 * share).select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64), *(hash_set(text.as_py() or "", words) for text in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["shingle"])

    counts = counted.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= LEAST_COMMON)
    rows = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).collect()  # at most COMMON
    found = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], np.array([r["count"] for r in rows], np.int64)[order]


#: Rounds of bridges between components before all pairs that are left are compared.
BRIDGES = 1
#: Nodes that make a word crowded, and rounds of :func:`crowd_pairs` over such words at most.
CROWD = 64
CROWD_ROUNDS = 3
#: Words before a word that tell whether a pair has shown before.
EARLIER = 6
#: Longs of a set's signature: the parity of how many of its hashes fall on each of 64 times as many bits.
SIGNATURE = 16


def signature(hashes: np.ndarray) -> np.ndarray:
    """The parities of a hash set.  Two sets differ in at least as many hashes as their signatures do in bits."""
    bits = np.bincount((hashes & np.uint64(64 * SIGNATURE - 1)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _ceil(x: float) -> int:
    """Round up, with room for what floats lose."""
    return ceil(x - 1e-9)


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``docs(id, row, text)`` -> ``(id, row, node, fp, size, prefix, bits)``: the first shingles of every row's set in one fixed order.

    ``node`` is a hash of the words in lower case: rows that differ only in case
    or white space share it.  (Two of n texts share it by chance with odds of
    n * n / 2 ** 65.)  ``fp`` is the fingerprint.  Shingles stand for their hashes.  ``size`` is how many
    different ones there are.  Sets with at least the ``similarity`` have
    ``similarity * size`` in common, so both have one of those among their first
    ``size - similarity * size + 1``, which is the ``prefix``.  ``bits`` is the :func:`signature`.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = common.value
        for batch in batches:
            nodes, prints, sizes, firsts, bits = [], [], [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(text.encode().lower().split())) - (1 << 63))
                hashes = list(shingle_hashes(text, words))
                prints.append(fingerprint(hashes))
                found = _different(hashes)
                sizes.append(len(found))
                bits.append(signature(found))
                if len(known) and len(found):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    found = found[np.lexsort((found, np.where(known[at] == found, often[at], 0)))]
                firsts.append(found[: len(found) - _ceil(similarity * len(found)) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (nodes, prints, sizes)), *(pa.array(x, pa.list_(pa.int64())) for x in (firsts, bits))], names=["id", "row", "node", "fp", "size", "prefix", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, row string, node long, fp long, size long, prefix array<long>, bits array<long>")


def shared_words(prints: DataFrame) -> DataFrame:
    """``(word, node, size, at, least)`` of the prefix shingles that several nodes of ``prints(node, size, prefix)`` have.

    ``at`` is the shingle's place in the node's prefix, and ``least(node, size, at)``
    the node with the smallest id that has it.
    """
    words = prints.select("node", "size", F.posexplode("prefix").alias("at", "word"))
    # Sums before the shuffle and a join that Spark may split: no task gets all rows of a word that very many nodes have.
    ends = words.groupBy("word").agg(F.min(F.struct("node", "size", "at")).alias("least"), F.max("node").alias("most"))
    return words.join(ends.filter("least.node <> most").select("word", "least"), "word").select("node", "size", "at", "word", "least")


def _may_reach(similarity: float, size: Column, at: Column, other_size: Column, other_at: Column) -> Column:
    """Whether two sets can have the similarity, if no shingle before these places is in both.

    Then what they have in common is at most what follows in either; and the sizes
    alone set a bound.  Of a pair's shared shingles the first one meets the premise.
    """
    least = F.lit(similarity / (1 + similarity)) * (size + other_size) - 1e-6
    left = F.least(size - at, other_size - other_at)
    return (left >= least) & (F.least(size, other_size) >= F.lit(similarity) * F.greatest(size, other_size) - 1e-6)


def signed_pairs(found: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(node, other)`` of ``found`` that their sizes and signatures in ``signed(node, size, b0, ...)`` allow to be similar."""
    names = [c for c in signed.columns if c != "node"]
    left = signed.select("node", *(F.col(c).alias(f"a_{c}") for c in names))
    right = signed.select(F.col("node").alias("other"), *(F.col(c).alias(f"b_{c}") for c in names))
    both = found.join(left, "node").join(right, "other")
    return both.filter(_bits_allow(similarity, "a_", "b_")).select("node", "other")


def _bits_allow(similarity: float, a: str, b: str) -> Column:
    """Whether the signatures differ in no more bits than sets of these sizes with the similarity may differ in hashes."""
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{a}b{i}").bitwiseXOR(F.col(f"{b}b{i}"))) for i in range(SIGNATURE)))
    return differ <= (F.col(f"{a}size") + F.col(f"{b}size")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def print_pairs(marks: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs ``(node, other)`` of ``marks(node, fp)`` that multi-index hashing finds; see :func:`near_links`.

    A fingerprint stands for its smallest node, with which its other nodes are paired.
    """
    least = stage(marks.groupBy("fp").agg(F.min("node").alias("least")), "print-nodes")
    same = marks.join(least, "fp").filter("node <> least").select("node", F.col("least").alias("other"))
    u, v = (least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")) for c in "uv")
    near = near_links(least.select("fp"), distance).join(u, "u").join(v, "v")
    return same.unionByName(near.select(F.greatest("u_node", "v_node").alias("node"), F.least("u_node", "v_node").alias("other")))


def star_pairs(shared: DataFrame, similarity: float, tries: int = 2) -> DataFrame:
    """Pairs ``(node, other)`` of each node and the smallest node of a word, for the ``tries`` such nodes with most words in common.

    They join large groups at little cost, but leave pairs of a word out:
    :func:`rest_pairs` has those.
    """
    able = _may_reach(similarity, F.col("size"), F.col("at"), F.col("least.size"), F.col("least.at"))
    met = shared.filter((F.col("least.node") < F.col("node")) & able).groupBy("node", F.col("least.node").alias("other")).agg(F.count("*").alias("words"))
    best = F.row_number().over(W.partitionBy("node").orderBy(F.desc("words"), "other"))
    return met.withColumn("nth", best).filter(F.col("nth") <= tries).select("node", "other")


def mixed_words(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``(word, node, size, at, root)`` of the words whose nodes are in several components of ``roots(node, root)``."""
    rooted = shared.join(roots, "node", "left").select("word", "node", "size", "at", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("word").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("word")
    return rooted.join(several, "word").select("word", "node", "size", "at", "root")


def bridge_pairs(mixed: DataFrame, similarity: float, turn: int = 0, tries: int = 2) -> DataFrame:
    """As :func:`star_pairs`, of each node and one node of one component of a word, if that is not its own.

    It is the smallest node of the smallest component at first, and one picked by a hash at each later ``turn``.
    """
    rank = lambda c: F.col(c) if turn == 0 else F.xxhash64(c, F.lit(turn))
    least = mixed.groupBy("word").agg(F.min(F.struct(rank("root").alias("root_rank"), "root", rank("node").alias("rank"), "node", "size", "at")).alias("least"))
    found = mixed.join(least, "word").filter(F.col("root") != F.col("least.root"))
    own, other = F.struct("node", "size", "at"), F.struct("least.node", "least.size", "least.at")
    larger = F.col("node") > F.col("least.node")
    pairs = found.select(F.when(larger, own).otherwise(other).alias("own"), F.when(larger, other).otherwise(own).alias("least"))
    return star_pairs(pairs.select("own.node", "own.size", "own.at", "least"), similarity, tries)


def crowded_words(mixed: DataFrame) -> DataFrame:
    """The rows of ``mixed`` whose words more than ``CROWD`` nodes have."""
    crowded = mixed.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("word")
    return mixed.join(crowded, "word")


def crowd_pairs(crowded: DataFrame, marks: DataFrame, similarity: float, turn: int = 0) -> DataFrame:
    """Pairs ``(node, other)`` of a word's nodes that have a piece of the fingerprint in common: each with one of them.

    Pieces are the whole of ``marks(node, fp)``, halves, quarters and bytes, of which the wide ones
    part large groups and the narrow ones meet far pairs.  Each ``turn`` cuts elsewhere and picks
    another node, so that a group of texts around the threshold, most of which aren't similar to
    each other, becomes few components before :func:`rest_pairs` compares what is left.
    """
    shift = 3 * turn % 64
    fp = F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift)) if shift else F.col("fp")
    pieces = F.array(*(F.struct(F.lit(width + i).alias("cut"), F.shiftrightunsigned(F.shiftleft(fp, 64 - width * (i + 1)), 64 - width).alias("bits")) for width in (64, 32, 16, 8) for i in range(64 // width)))
    keyed = crowded.join(marks, "node").select("word", "node", "size", "at", "root", F.explode(pieces).alias("piece"))
    picked = keyed.groupBy("word", "piece").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node", "size", "at", "root")).alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
    found = keyed.join(picked.filter("low <> high").select("word", "piece", "least"), ["word", "piece"])
    able = _may_reach(similarity, F.col("size"), F.col("at"), F.col("least.size"), F.col("least.at"))
    found = found.filter((F.col("root") != F.col("least.root")) & able)
    return found.select(F.greatest("node", "least.node").alias("node"), F.least("node", "least.node").alias("other")).distinct()


def rest_pairs(mixed: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``(node, other)`` that may be similar and that are in different components.

    A pair shows at its first word in common.  It is left out at words where one of
    the ``EARLIER`` words before, in either, is in both: there it has shown already.
    """
    known = mixed.join(signed.drop("size"), "node")
    in_order = W.partitionBy("node").orderBy("at", "word")
    known = known.withColumn("earlier", F.array_compact(F.array(*(F.lag("word", i).over(in_order) for i in range(1, EARLIER + 1)))))
    a, b = (known.select(*(F.col(c).alias(f"{x}_{c}") for c in known.columns)) for x in "ab")
    able = _may_reach(similarity, F.col("a_size"), F.col("a_at"), F.col("b_size"), F.col("b_at")) & _bits_allow(similarity, "a_", "b_")
    apart = (F.col("b_node") < F.col("a_node")) & (F.col("a_root") != F.col("b_root"))
    both = a.join(b, (F.col("a_word") == F.col("b_word")) & apart & ~F.arrays_overlap("a_earlier", "b_earlier") & able)
    return both.select(F.col("a_node").alias("node"), F.col("b_node").alias("other")).distinct()


def jaccard(a: str | None, b: str | None, words: int) -> float:
    """Jaccard similarity of the shingle sets; two texts without words are alike."""
    x, y = set(shingles(a or "", words)), set(shingles(b or "", words))
    return len(x & y) / len(x | y) if x or y else 1.0


def keep_one_per_group(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Groups are components of texts whose ``words``-shingle sets have at least the
    given Jaccard similarity, above 0; candidates come from :func:`print_pairs`,
    :func:`star_pairs`, :func:`crowd_pairs`, :func:`bridge_pairs` and :func:`rest_pairs`, of
    which the last loses none that the others leave, and each is verified on the texts themselves.  Texts that differ only in case or white space are one node.  Rows
    equal in id and text count as one, of which one stays; null ids come last.  A
    null text counts as empty, and texts without words form one group.  All columns
    of ``docs`` stay as they are, whatever their names.  An empty table gives no rows.
    """
    row_id = row_key(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    ship(docs.sparkSession)
    [row_col] = fresh(docs, "near_row")
    prints = stage(prefixes(docs.select(F.col(id_col).alias("id"), row_id.alias("row"), F.col(text_col).alias("text")), words, similarity), "prefixes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = stage(prints.groupBy("node").agg(first.alias("first")), "nodes")
    chosen = prints.select("node", "size", "prefix").dropDuplicates(["node"])
    signed = prints.dropDuplicates(["node"]).select("node", "size", *(F.col("bits")[i].alias(f"b{i}") for i in range(SIGNATURE)))
    signed = stage(signed, "signatures")
    marks = stage(prints.groupBy("node").agg(F.min("fp").alias("fp")), "marks")

    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([jaccard(a.as_py(), b.as_py(), words) >= similarity for a, b in zip(left, right, strict=True)], pa.bool_())

    def links_of(found: DataFrame, name: str) -> DataFrame:
        pairs = stage(found, f"{name}-pairs")
        wanted = pairs.select("node").unionByName(pairs.select(F.col("other").alias("node"))).distinct()
        rows = stage(nodes.join(wanted, "node", "left_semi").select("node", F.col("first.row").alias("row")), f"{name}-wanted")
        texts = docs.select(row_id.alias("row"), F.col(text_col).alias("text"))
        if rows.count() <= FEW_ROWS:
            # Most texts are not wanted: leave them out by a hash, before the join moves them.
            hashes = rows.select(F.xxhash64("row").alias("hash")).distinct()
            texts = texts.join(F.broadcast(hashes), F.xxhash64("row") == F.col("hash"), "left_semi")
        # Both joins with texts are merge joins at every size: what they join to grows with the corpus.
        texts = texts.join(rows.hint("merge"), "row").select("node", "text")
        texts = stage(texts.groupBy("node").agg(F.min("text").alias("text")), f"{name}-texts")
        both = pairs.join(texts.withColumnRenamed("text", "a"), "node").join(texts.select(F.col("node").alias("other"), F.col("text").alias("b")), "other")
        links = stage(both.filter(alike("a", "b")).select(F.col("node").alias("u"), F.col("other").alias("v")), f"{name}-links")
        drop_stage(pairs, rows, texts)
        return links

    shared = stage(shared_words(chosen), "shared")
    drop_stage(prints)
    first_pairs = print_pairs(marks).unionByName(star_pairs(shared, similarity)).distinct()
    links = links_of(signed_pairs(first_pairs, signed, similarity), "first")
    roots = components(links, "similar")
    mixed = stage(mixed_words(shared, roots), "mixed")
    drop_stage(shared)
    crowded = stage(crowded_words(mixed), "crowded")
    met = 0
    for turn in range(CROWD_ROUNDS):
        more = links_of(signed_pairs(crowd_pairs(crowded, marks, similarity, turn), signed, similarity), "crowd")
        if not (new := more.count()):
            break
        met += new
        links = stage(links.unionByName(more), "links")
        roots = components(links, "similar")
        crowded, old = stage(mixed_words(crowded.drop("root"), roots), "crowded"), crowded
        drop_stage(old)
        if new * 200 < crowded.count():
            break
    if met:
        mixed, old = stage(mixed_words(mixed.drop("root"), roots), "mixed"), mixed
        drop_stage(old)
    drop_stage(crowded)
    for turn in range(BRIDGES):
        more = links_of(signed_pairs(bridge_pairs(mixed, similarity, turn), signed, similarity), "bridge")
        if more.isEmpty():
            break
        links = stage(links.unionByName(more), "links")
        roots = components(links, "similar")
        mixed, old = stage(mixed_words(mixed.drop("root"), roots), "mixed"), mixed
        drop_stage(old)
    more = links_of(rest_pairs(mixed, signed, similarity), "rest")
    if not more.isEmpty():
        roots = components(links.unionByName(more), "similar")
    labelled = nodes.join(roots, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = stage(labelled.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row_col)), "kept")
    drop_stage(mixed, signed, marks, nodes)
    return docs.withColumn(row_col, row_id).join(kept.hint("merge"), row_col, "left_semi").dropDuplicates([row_col]).select(*docs.columns)
