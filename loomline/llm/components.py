"""Connected components of links between integer ids, with joins and reliable cuts only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.spool import cut


#: Edges that one task reads at least.
EDGES = 100_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("x"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every linked node other than the roots themselves; the root is the least id.

    links: (u, v). Alternating large-star and small-star steps until nothing changes; no
    adjacency list is ever collected, only ids move.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    few = lambda e, n: e.coalesce(n // EDGES + 1)  # noqa: E731 - no more tasks than the edges are worth
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    if before[0] == 0:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        edges = cut(_star(_star(few(edges, before[0]), True), False))
        now = mark(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components have not settled after {rounds} rounds")
