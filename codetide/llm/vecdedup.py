"""Embedding near-dedup: spherical k-means cells and blocked cosine products.

A vector's home is the cell of its nearest centroid; it also visits the next
nearest cells, so that pairs across a border meet.  Cells that stay large are
split by a second level of centroids, a million cells in all.  Within a cell, vectors are
split into blocks, and each pair of blocks is one small matrix product.  A block
pair returns a count for each vector and the links of a spanning forest, so
what leaves it grows with its vectors, not with its pairs.

Cells are groups of centroids: centroids that are as near to each other as linked
vectors are share one cell, so a dense group is never cut into cells whose vectors
don't meet, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shipping import ship
from .common import stage
from .components import components

#: Bounds of the fit: vectors sampled, centroids, and rounds.
SAMPLE, MOST_CELLS, ROUNDS = 16_384, 1024, 8
#: The sample's bytes at most, so that long vectors make it smaller.
SAMPLE_BYTES = 1 << 26
#: Cells with more vectors than this are split by centroids of their own, fitted on about SPLIT_SAMPLE of them.
SPLIT_ABOVE, SPLIT_SAMPLE = 8192, 4096
#: Levels of cells below the first at most: numbers of cells of five levels of MOST_CELLS fit a long.
LEVELS = 4


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """``k`` unit centroids of unit rows by cosine; empty cells keep their last centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 1e-12
        centres[full] = sums[full] / norms[full, None]
    return centres


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small numbers would not be finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vec_col: str):
    """Not null, not empty, no null or non-finite component, and not all zero."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def cell_labels(centres: np.ndarray, threshold: float) -> np.ndarray:
    """The cell of each centroid: the smallest of those that steps of at least ``threshold`` lead to."""
    near = centres @ centres.T >= threshold
    labels = np.arange(len(centres))
    while True:
        least = np.where(near, labels[None, :], len(labels)).min(axis=1, initial=len(labels))
        least = np.minimum(labels, least)
        least = np.minimum(least, least[least])
        if (least == labels).all():
            return labels
        labels = least


def nearest_cells(x: np.ndarray, centres: np.ndarray, labels: np.ndarray, visits: int) -> np.ndarray:
    """For each vector its nearest cells by their nearest centroid, the home first."""
    order = np.argsort(labels, kind="stable")
    names, first = np.unique(labels[order], return_index=True)
    best = np.maximum.reduceat(x @ centres[order].T, first, axis=1)
    return names[np.argsort(-best, axis=1, kind="stable")[:, :visits]]


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their class, and one numbered row for each different usable vector."""
    key = F.when(usable(vec_col), F.md5(F.to_json(F.struct(F.col(vec_col)))))
    rows = stage(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"), key.alias("key")), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("v").alias("v"))
    return rows.select("id", "key"), stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def fit_cells(classes: DataFrame, cell_size: int, threshold: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Centroids and their cells for each dimension, fitted on the ``SAMPLE`` classes with the smallest hash, or as many as ``SAMPLE_BYTES`` hold."""
    n, longest = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (longest or 1))))
    sample = classes.select("v").orderBy(F.xxhash64("key"), "key").limit(most).toArrow()["v"].combine_chunks()  # bounded in rows and bytes
    ends, flat = sample.offsets.to_numpy(), sample.values.to_numpy()
    by: dict[int, list] = {}
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        by.setdefault(b - a, []).append(flat[a:b])
    out = {}
    for dim, rows in by.items():
        centres = spherical_kmeans(_unit(rows), max(1, min(MOST_CELLS, -(-n // cell_size), len(rows))))
        out[dim] = centres, cell_labels(centres, threshold)
    return out


def assign(classes: DataFrame, cells: dict[int, tuple[np.ndarray, np.ndarray]], visits: int) -> DataFrame:
    """``(node, copies, v, dim, cells)``: unit vectors and their nearest cells, the home first.

    A dimension that no sampled vector has gets one cell.
    """
    shared = classes.sparkSession.sparkContext.broadcast(cells)  # at most MOST_CELLS centroids for a dimension, of SAMPLE_BYTES in all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            units: list = [None] * len(rows)
            cells: list = [None] * len(rows)
            for dim in sorted({len(r) for r in rows}):
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                x = _unit([rows[i] for i in at])
                known = shared.value.get(dim)
                near = np.zeros((len(at), 1), np.int64) if known is None else nearest_cells(x, *known, visits)
                for i, u, n in zip(at, x.tolist(), near.tolist(), strict=True):
                    units[i], cells[i] = u, n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.list_(pa.float64())), pa.array([len(r) for r in rows], pa.int32()), pa.array(cells, pa.list_(pa.int64()))], names=["node", "copies", "v", "dim", "cells"])

    return classes.select("node", "copies", "v").mapInArrow(run, "node long, copies long, v array<double>, dim int, cells array<long>")


def split_cells(placed: DataFrame, above: int, cell_size: int, visits: int, threshold: float) -> DataFrame:
    """``placed`` with cells of a further level where a cell has more than ``above`` vectors.

    Each such cell gets centroids of its own.  They reach its vectors in groups of
    about ``SPLIT_SAMPLE``, so neither a hot cell nor the number of cells has to fit
    in one place.  Levels go on until no cell is that large, or none gets smaller:
    a dense group stays one cell.
    """
    for level in range(LEVELS):
        spread = placed.select("node", "v", "dim", F.posexplode("cells").alias("pos", "cell"))
        sizes = spread.groupBy("dim", "cell").agg(F.count("*").alias("n"))
        # Cells that the level before could not split have the same number, times MOST_CELLS, and are left alone.
        large = sizes.filter((F.col("n") > above) & (F.lit(level == 0) | (F.col("cell") % MOST_CELLS != 0)))
        large = stage(large.withColumn("groups", F.ceil(F.col("n") / SPLIT_SAMPLE).cast("int")), "large-cells")
        if large.isEmpty():
            break
        placed = _split(placed, spread, large, cell_size, visits, threshold)
    return placed


def _split(placed: DataFrame, spread: DataFrame, large: DataFrame, cell_size: int, visits: int, threshold: float) -> DataFrame:
    tagged = spread.join(large, ["dim", "cell"], "left")
    inside = tagged.filter("n is not null").withColumn("group", F.pmod(F.xxhash64("node"), "groups").cast("int"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist())
        k = max(1, min(MOST_CELLS - 1, -(-int(pdf["n"].iloc[0]) // cell_size), len(x)))
        centres = spherical_kmeans(x, k)
        labels = cell_labels(centres, threshold)
        # 0 says that the cell stays as it is: all its centroids are one cell.
        labels = labels + 1 if labels.any() else labels
        return pd.DataFrame({"dim": pdf["dim"].iloc[0], "cell": pdf["cell"].iloc[0], "centre": list(centres), "label": labels})

    fitted = inside.filter("group = 0").groupBy("dim", "cell").applyInPandas(fit, "dim int, cell long, centre array<double>, label long")
    fitted = stage(fitted, "further-centres").join(large.select("dim", "cell", "groups"), ["dim", "cell"])
    fitted = fitted.select("dim", "cell", "centre", "label", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))

    def near(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"node": [], "pos": [], "ids": []})
        if known.empty:  # the sample met no vector of this cell
            ids = np.zeros((len(rows), 1), np.int64)
        else:
            ids = nearest_cells(np.array(rows["v"].tolist()), np.array(known["centre"].tolist()), known["label"].to_numpy(), visits)
        return pd.DataFrame({"node": rows["node"], "pos": rows["pos"], "ids": list(rows["cell"].to_numpy()[:, None] * MOST_CELLS + ids)})

    keys = ["dim", "cell", "group"]
    second = inside.select("node", "pos", "v", *keys).groupBy(*keys).cogroup(fitted.groupBy(*keys)).applyInPandas(near, "node long, pos int, ids array<long>")
    first = tagged.filter("n is null").select("node", "pos", F.array(F.col("cell") * MOST_CELLS).alias("ids"))
    cells = first.unionByName(second).groupBy("node").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("cells"))
    return stage(placed.drop("cells").join(cells, "node"), "further-cells")


def compare(key: tuple, pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One pair of blocks of a cell: counts and a spanning forest of its links.

    A pair counts where the cell is home to one of the two and no smaller cell
    does the same, so that each pair counts once however many cells they share.
    """
    cell, left, right = (int(k) for k in key[1:])
    a = pdf[pdf["block"] == left]
    b = a if left == right else pdf[pdf["block"] == right]
    out = {"u": [], "v": [], "n": []}
    if len(a) and len(b):
        x, y = np.array(a["v"].tolist()), np.array(b["v"].tolist())
        i, j = np.nonzero(x @ y.T >= threshold)
        if left == right:
            i, j = i[i < j], j[i < j]
        cells_a, cells_b = _padded(a["cells"]), _padded(b["cells"])
        home_a, home_b = cells_a[i, 0], cells_b[j, 0]
        a_sees, b_sees = (cells_a[i] == home_b[:, None]).any(1), (cells_b[j] == home_a[:, None]).any(1)
        never = np.iinfo(np.int64).max
        where = np.minimum(np.where(b_sees, home_a, never), np.where(a_sees, home_b, never))
        i, j = i[where == cell], j[where == cell]
        ids_a, ids_b = a["node"].to_numpy(), b["node"].to_numpy()
        links = np.zeros(len(a) + len(b), np.int64)
        np.add.at(links, i, b["copies"].to_numpy()[j])
        np.add.at(links, j + len(a), a["copies"].to_numpy()[i])
        ids = np.concatenate((ids_a, ids_b))
        for at in np.nonzero(links)[0]:
            out["u"].append(ids[at])
            out["v"].append(ids[at])
            out["n"].append(links[at])
        parent = {}

        def root(z):
            while parent.setdefault(z, z) != z:
                parent[z] = z = parent[parent[z]]
            return z

        for u, v in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
                out["u"].append(u)
                out["v"].append(v)
                out["n"].append(0)
    return pd.DataFrame(out).astype("int64")


def _padded(cells: pd.Series) -> np.ndarray:
    """Cell lists of any lengths as a matrix; -1 is no cell."""
    out = np.full((len(cells), cells.map(len).max()), -1, np.int64)
    for i, c in enumerate(cells):
        out[i, : len(c)] = c
    return out


def near_vectors(vectors: DataFrame, threshold: float = 0.95, cell_size: int = 256, block: int = 512, visits: int = 3, split_above: int = SPLIT_ABOVE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row, by cosine in double precision.

    No pair below ``threshold`` is linked.  Pairs at or above it are missed only
    if neither vector visits the other's home cell (tests measure the recall).
    Equal vectors are one node with copies, linked with each other.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing,
    and vectors of different dimension never link.  Repeated rows stay
    and link with each other, and rows that share an id are told apart by their
    vectors.  Rows with a null id link like any other, but give a component no
    id: one of null ids alone has a null id.  Such rows are kept only there.  Other
    columns are ignored.  An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    rows, classes = vector_classes(vectors, id_col, vec_col)
    placed = split_cells(stage(assign(classes, fit_cells(classes, cell_size, threshold), visits), "cells"), split_above, cell_size, visits, threshold)
    sized = placed.select("dim", F.explode("cells").alias("cell")).groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    members = placed.select("node", "copies", "v", "cells", "dim", F.explode("cells").alias("cell")).join(sized, ["dim", "cell"])
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other")
    spread = members.select("node", "copies", "v", "cells", "dim", "cell", "block", other)
    spread = spread.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    found = spread.groupBy("dim", "cell", "left", "right").applyInPandas(lambda key, pdf: compare(key, pdf, threshold), "u long, v long, n long")
    found = stage(found, "links")
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("u <> v").select("u", "v"), "vectors")
    known = classes.select("key", "node", "least", "copies").join(counts, "node", "left").join(roots, "node", "left")
    known = stage(known.select("key", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    named = known.groupBy("root").agg(F.min("least").alias("component"))
    joined = rows.join(stage(known.join(named, "root").select("key", "n_links", "component"), "components"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
