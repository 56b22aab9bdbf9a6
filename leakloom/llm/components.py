"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that one task holds at most while it drops those that close a circle.
EDGES_A_TASK = 200_000


def _forest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's edges those that a spanning forest of them needs, as (root, node)."""
    up: dict = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    yield pd.DataFrame([(r, x) for x in list(up) if (r := root(x)) != x], columns=["a", "b"])


def _stars(e: DataFrame) -> bool:
    """Whether each node u has one edge, to a node v < u that has none of its own."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.where("down > 1 or down = 1 and up = 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges(a, b), long or string -> (node, comp): every node that has an edge with its component's least node, itself included.

    Each round is written to the shared folder, a file for EDGES_A_TASK edges; only a count of edges reaches the driver. Rounds end when all that is
    left are stars, so edges that one task's forest has settled need none.
    Self loops and repeated or reversed edges don't matter; no edges give no rows."""
    edges = edges.where("a <> b").select("a", "b")
    tasks = 1 + edges.count() // EDGES_A_TASK
    edges = edges.repartition(tasks).mapInPandas(_forest, edges.schema)
    e = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(tasks), f"{name}-forest")
    for i in range(60):
        if _stars(e):
            break
        # large star: a node's larger neighbours go to its least neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.keep(small.coalesce(tasks), f"{name}-{i}")
        if i > 1:
            scratch.drop(f"{name}-{i - 2}")
    else:
        raise RuntimeError("components did not settle in 60 rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
