"""Connected components by rounds of minimum-neighbour contraction.

Links stay in tables.  Each round points every node at the smallest id among
itself and its neighbours, follows the pointers to their roots by doubling, and
contracts the links to root pairs.  Every round at least halves the nodes that
still have links, so the rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_stage, stage


def components(links: DataFrame, name: str = "cc") -> DataFrame:
    """``links(u, v)`` of longs -> ``(node, root)`` for every node that has a link.

    ``root`` is the smallest id of the component.  Loops, null ends and repeated
    links are ignored; no links give an empty result.
    """
    pair = links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    edges = stage(pair.distinct(), f"{name}-links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        parents = _to_roots(stage(parents, f"{name}-parents"), name)
        if labels is None:
            labels = parents
        else:
            step, old = parents.select(F.col("node").alias("root"), F.col("root").alias("up")), labels
            labels = stage(labels.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels")
            drop_stage(old)
        pu = parents.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        pv = parents.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = edges.join(pu, "u").join(pv, "v").filter("ru <> rv")
        moved = moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        edges, old = stage(moved, f"{name}-links"), edges
        drop_stage(old)
        if labels is not parents:
            drop_stage(parents)
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


def _to_roots(parents: DataFrame, name: str) -> DataFrame:
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = parents.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved"))
        jumped, old = stage(jumped, f"{name}-jump"), parents
        parents = jumped.select("node", "root")
        drop_stage(old)
        if jumped.filter("moved").isEmpty():
            return parents
