"""Exact top-k by integer inner product: dual-tree search over cover trees.

Candidates are dealt into blocks of bounded size by a hash of their id, queries likewise; every
block becomes a cover tree, and each pair of a query block and a candidate block is searched as
a pair of trees. A node covers its points within its radius; children cover theirs within half
of it, and points too sparse for a child of their own share leaves. For a query node with centre
q and radius r and a candidate node with centre p and radius s no inner product can exceed
qp + r|p| + s|q| + rs; the pair is passed over when that is below the worst k-th score of the
node's queries. A task walks the candidate blocks of one query block one after another and
carries the k best along; a last ranking joins the tasks' lists.

Defined results: vectors that are null, empty or hold null or non-finite components, and null
ids, take no part; vectors of other lengths than the query's are no candidates; a query is never
its own candidate, repeated rows of another id are candidates as often as they occur; scores
beyond the range of a long are cut to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import groups, query
from .vectors import embeddings, usable

CANDIDATE_BLOCK = 2048
QUERY_BLOCK = 1024
BLOCKS_PER_TASK = 16
LEAF = 48


class CoverTree:
    """points in tree order, their ids, and nodes as parallel lists."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        norms = (points * points).sum(axis=1)
        far = np.sqrt(np.maximum(norms[:, None] - 2 * points @ points.T + norms[None, :], 0))
        self.center, self.radius, self.children, self.start, self.end = [], [], [], [], []
        order: list[int] = []
        self._grow(np.arange(len(ids)), 0, far, order)
        self.ids, self.points = ids[order], points[order]
        self.center = points[self.center]
        self.radius = np.array(self.radius) * (1 + 1e-9)
        self.length = np.sqrt((self.center * self.center).sum(axis=1)) * (1 + 1e-9)

    def _node(self, center: int, radius: float, start: int) -> int:
        self.center.append(center)
        self.radius.append(radius)
        self.children.append([])
        self.start.append(start)
        self.end.append(start)
        return len(self.center) - 1

    def _grow(self, members: np.ndarray, center: int, far: np.ndarray, order: list[int]) -> int:
        radius = float(far[center, members].max())
        node = self._node(center, radius, len(order))
        if len(members) <= LEAF or radius == 0:
            order.extend(members.tolist())
        else:
            sparse, rest = [], members
            while len(rest):
                near = far[rest[0], rest] <= radius / 2
                group = rest[near]
                if len(group) >= LEAF // 4:
                    self.children[node].append(self._grow(group, int(rest[0]), far, order))
                else:
                    sparse.append(group)
                rest = rest[~near]
            loose = np.concatenate(sparse) if sparse else members[:0]
            for at in range(0, len(loose), LEAF):
                part = loose[at : at + LEAF]
                child = self._node(center, float(far[center, part].max()), len(order))
                order.extend(part.tolist())
                self.end[child] = len(order)
                self.children[node].append(child)
        self.end[node] = len(order)
        return node


class Best:
    """The k best scores of each query, in the query tree's order."""

    def __init__(self, tree: CoverTree, k: int):
        self.tree, self.k = tree, k
        self.scores = np.full((len(tree.ids), k), -np.inf)
        self.found: list[list[tuple]] = [[] for _ in tree.ids]  # (-score, id) in order

    def offer(self, low: int, high: int, ids: np.ndarray, points: np.ndarray) -> None:
        left = self.tree.points[low:high]
        exact = not left.size or not points.size or np.abs(left).max() * np.abs(points).max() * points.shape[1] < 2.0**52
        if exact:
            scores = left @ points.T
        else:
            scores = np.array([[sum(int(x) * int(y) for x, y in zip(q, p)) for p in points] for q in left], object)
        hit = (scores >= self.scores[low:high, -1:]) & (ids[None, :] != self.tree.ids[low:high, None])
        for row in np.flatnonzero(hit.any(axis=1)).tolist():
            at = np.flatnonzero(hit[row])
            new = [(-int(s), int(i)) for s, i in zip(scores[row, at], ids[at])]
            best = self.found[low + row] = sorted(self.found[low + row] + new)[: self.k]
            if len(best) == self.k:
                self.scores[low + row] = [-s for s, _ in best]

    def search(self, other: CoverTree) -> None:
        mine, radius, slack = self.tree, self.tree.radius, 1 + 1e-9

        def bounds(q, ps):
            dots = other.center[ps] @ mine.center[q]
            loose = radius[q] * other.length[ps] + other.radius[ps] * mine.length[q] + radius[q] * other.radius[ps]
            return dots + loose * slack + np.abs(dots) * 1e-12

        todo = [(0, 0, np.inf)]
        while todo:
            q, p, bound = todo.pop()
            low, high = mine.start[q], mine.end[q]
            if bound < self.scores[low:high, -1].min():
                continue
            split_q, split_p = mine.children[q], other.children[p]
            if not split_q and not split_p:
                self.offer(low, high, other.ids[other.start[p] : other.end[p]], other.points[other.start[p] : other.end[p]])
            elif split_q and (not split_p or radius[q] >= other.radius[p]):
                todo.extend((c, p, float(bounds(c, [p])[0])) for c in split_q)
            else:
                reach = bounds(q, split_p)
                todo.extend((q, split_p[i], float(reach[i])) for i in np.argsort(reach))


def _blocks(rows: DataFrame, size: int, most: int) -> DataFrame:
    """(size, block, tree) for vectors of each length, at most about `most` in a block."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(frames, ["size", "block"]):
            tree = CoverTree(frame["id"].to_numpy(np.int64), np.array(frame["vector"].tolist(), np.float64))
            yield pd.DataFrame({"size": frame["size"].iloc[:1], "block": frame["block"].iloc[:1], "tree": [pickle.dumps(tree.__dict__)]})

    count = max(1, -(-size // most))
    keyed = rows.withColumn("size", F.size("vector")).withColumn(
        "block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(count)).cast("int")
    )
    return keyed.repartition("size", "block").sortWithinPartitions("size", "block", "id").mapInPandas(run, "size int, block int, tree binary")


def top_k(rows: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest inner products among all other
    rows, ties to the smaller id. Components must be whole numbers in double."""
    rows = rows.where(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")
    )
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    candidates = _blocks(rows.drop("asks"), total, CANDIDATE_BLOCK)
    queries = _blocks(rows.where("asks").drop("asks"), asking, QUERY_BLOCK)
    query_blocks = max(1, -(-asking // QUERY_BLOCK))
    lanes = max(1, -(-total // (CANDIDATE_BLOCK * BLOCKS_PER_TASK)))
    # each candidate block meets each query block: the stated queries against all rows
    met = candidates.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.select("size", F.col("block").alias("ask"), F.lit(-1).alias("block"), "tree")
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    both = met.withColumn("lane", F.pmod("block", F.lit(lanes))).select(*asked.columns).unionByName(asked)

    def restored(data: bytes) -> CoverTree:
        tree = CoverTree.__new__(CoverTree)
        tree.__dict__.update(pickle.loads(data))
        return tree

    def answers(best: Best) -> pd.DataFrame:
        limit = 2**63 - 1
        rows = [(q, i, max(-limit - 1, min(limit, -s))) for q, found in zip(best.tree.ids.tolist(), best.found) for s, i in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, at = None, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if (row.size, row.ask, row.lane) != at:
                    if best:
                        yield answers(best)
                    at, best = (row.size, row.ask, row.lane), None
                if row.block < 0:  # the query block comes first
                    best = Best(restored(row.tree), k)
                elif best:
                    best.search(restored(row.tree))
        if best:
            yield answers(best)

    found = (
        both.repartition("size", "ask", "lane").sortWithinPartitions("size", "ask", "lane", "block")
        .mapInPandas(run, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_exact_top_k", OP4_SQL)
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).where(usable("embedding")).select(  # before floor, which makes numbers of all
        "vec_id", F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("vector")
    )
    return top_k(rows, F.col("vec_id") % 50 == 0, 5)
