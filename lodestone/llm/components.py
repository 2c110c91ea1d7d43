"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch

#: Far above the number of rounds any graph needs (a logarithm of its size).
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over links u > v.

    Large-star joins every larger neighbour of a node to the least node beside it;
    small-star joins every smaller neighbour, and the node itself, to the least.
    Both are a minimum per node and a join back, so no node's neighbours meet in a task.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    around = both if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    joined = around.join(least, around.u == least.node)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own link to its least neighbour is made by that neighbour's side
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """links (u, v) -> (id, component): the least id reachable, for every id that has a link.

    Self-links, repeated links and links with a null are no links. Each round is written
    to the shared folder, so a lost executor costs a task and not the rounds before.
    """
    edges = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.save(edges, f"{name}0")
    for k in range(MAX_ROUNDS):
        # done when the links are stars: no node has two links down, and no centre has one
        n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == nodes and edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count() == 0:
            break
        wide = scratch.save(_star(edges, large=True), f"{name}{k}l")
        edges = scratch.save(_star(wide, large=False), f"{name}{k + 1}")
        scratch.drop(f"{name}{k}", f"{name}{k}l")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
