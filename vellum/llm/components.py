"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Edges never come to the driver. Each half step joins the edges with one minimum per node, both read from written
tables, so that a hub's rows are split at run time. Nodes without a partner aren't returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(scratch: Scratch, edges: DataFrame, step: str, large: bool) -> DataFrame:
    """edges: distinct (a, b) with a > b. Large: each larger neighbour of a node moves to the node's minimum;
    small: each smaller neighbour, and the node itself, does."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        kept = F.col("v") > F.col("u")
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        kept = F.col("v") > F.col("m")
    least = scratch.write(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{step}-least")
    joined = sides.join(least.hint("merge"), "u")
    moved = joined.where(kept).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionAll(least.where(F.col("u") > F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = scratch.write(moved.where(F.col("a") != F.col("b")).distinct(), step)
    scratch.drop(f"{step}-least")
    return out


def _state(edges: DataFrame) -> tuple:
    """A digest of the edge set: equal digests mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links: (a, b) longs in any order, repeats allowed -> (node, root), root the least node of the component."""
    edges = scratch.write(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges-0"
    )
    before, name, n = _state(edges), "edges-0", 0
    while before[0]:
        n += 1
        mid = _star(scratch, edges, f"large-{n}", True)
        scratch.drop(name)
        edges, name = _star(scratch, mid, f"edges-{n}", False), f"edges-{n}"
        scratch.drop(f"large-{n}")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
