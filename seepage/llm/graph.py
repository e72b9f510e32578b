"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.session import settle


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One step for edges (a, b) with a > b.

    ``larger``: each node links its larger neighbours to the least of itself
    and its neighbours. Otherwise it links its smaller ones, and itself.
    """
    if larger:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("m"))
    joined = sides.join(least, "u")
    if larger:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node, root being the least node that links reach.

    Large-star and small-star steps until no link moves; every round is
    written to the shared folder, so lineage stays short and a lost executor
    costs one round at most. Links with a null end link nothing.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    edges = settle(edges, "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = tuple(mark)
        edges = settle(_stars(_stars(edges, True), False), "links")


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least index that each of 0..n-1 reaches by the pairs (u, v)."""
    root = np.arange(n)
    while len(u):
        lo, hi = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = lo != hi
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, hi[apart], lo[apart])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root
