"""Connected components of a table of links, without gathering a component anywhere.

Each round gives every node its smallest linked node and turns its other links into links
between those; when every node has one parent left, parents are followed by doubling. Rounds
are written to the shared folder. Joins are left to Spark, which splits a hot node's rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreweave.session import stored


def forest(a: np.ndarray, b: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Positions of those links among local node numbers that join two trees: union by smaller
    root with path halving. `group` gives nodes that are joined from the start."""
    size = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    if group is not None:
        size = max(size, len(group))
    parent = list(range(size))
    if group is not None:
        first: dict = {}
        for node, g in enumerate(group.tolist()):
            parent[node] = first.setdefault(g, node)
    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def components(links: DataFrame) -> DataFrame:
    """node, component for every node that occurs in links (a, b): the smallest node it reaches."""
    edges = links.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).where("c != p").distinct()
    while True:
        edges = stored(edges)
        least = edges.groupBy("c").agg(F.min("p").alias("m"), F.count("*").alias("k"))
        if not least.where("k > 1").limit(1).count():
            break
        joined = edges.join(least, "c")
        moved = joined.where("p != m").select(F.col("p").alias("c"), F.col("m").alias("p"))
        edges = joined.select("c", F.col("m").alias("p")).union(moved).distinct()
    while True:
        above = edges.select(F.col("c").alias("p"), F.col("p").alias("up"))
        jumped = stored(edges.join(above, "p", "left").select("c", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("far")))
        edges = jumped.select("c", "p")
        if not jumped.where("far").limit(1).count():
            break
    roots = edges.select(F.col("p").alias("node")).distinct()
    return roots.withColumn("component", F.col("node")).union(edges.select(F.col("c").alias("node"), F.col("p").alias("component")))
