"""Queries on a commit graph: merge bases, merged and squash-merged branches, ahead and behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from . import bridge as B
from .registry import query

_REACH = """WITH RECURSIVE reach(tip, node) AS (SELECT tip, node FROM v_graph_tips UNION SELECT r.tip, l.parent FROM reach r JOIN v_graph_links l ON l.node = r.node WHERE l.parent IS NOT NULL),
aim AS (SELECT min(tip) AS tip FROM v_graph_tips), aimed AS (SELECT node FROM reach JOIN aim USING (tip)), common AS (SELECT r.tip, r.node FROM reach r JOIN aimed a ON r.node = a.node)"""


def _aimed(spark, sf_dir):
    """The graph, the tips of its branches, and the branch to compare with: the one with the least name."""
    tips = B.graph_tips(spark, sf_dir)
    aim = tips.agg(F.min("tip")).first()[0]
    return G.graph(B.graph_links(spark, sf_dir)), tips, F.lit(aim)


@query(
    "ahead_behind",
    f"""{_REACH} SELECT r.tip, count(*) FILTER (WHERE a.node IS NULL) AS ahead, (SELECT count(*) FROM aimed) - count(a.node) AS behind, count(*) FILTER (WHERE a.node IS NULL) = 0 AS merged
    FROM reach r LEFT JOIN aimed a ON r.node = a.node GROUP BY r.tip""",
)
def ahead_behind(spark, sf_dir):
    own, tips, aim = _aimed(spark, sf_dir)
    return G.ahead_behind(G.reach(own, tips), aim)


@query("merge_base", f"{_REACH} SELECT c.tip, c.node FROM common c WHERE NOT EXISTS (SELECT 1 FROM v_graph_links l JOIN common d ON d.node = l.node WHERE l.parent = c.node AND d.tip = c.tip)")
def merge_base(spark, sf_dir):
    own, tips, aim = _aimed(spark, sf_dir)
    return G.merge_bases(own, G.reach_toward(own, tips, aim), aim)


@query(
    "squash_semi",
    f"""{_REACH}, trees AS (SELECT tree FROM (SELECT c.tree FROM v_graph_commits c JOIN aimed USING (node) ORDER BY made DESC, node DESC LIMIT 20))
    SELECT t.tip, t.tip IN (SELECT tip FROM common) AND c.tree IN (SELECT tree FROM trees) AS squashed FROM v_graph_tips t JOIN v_graph_commits c USING (node)""",
)
def squash_semi(spark, sf_dir):
    own, tips, aim = _aimed(spark, sf_dir)
    aimed = G.reach(own, tips.filter(F.col("tip") == aim))
    sharing = G.related(own, G.leading(own, aimed), tips)
    return G.squash_merged(own, aimed, tips, B.graph_commits(spark, sf_dir), aim, sharing=sharing)
