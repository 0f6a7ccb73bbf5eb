"""Near-duplicate vectors: inverted multi-index, multi-sequence traversal, verification.

Unit vectors are cut into halves, each half has a codebook of its own, and the pairs of
codewords form a grid of cells. A vector lies in the cell of its nearest codewords and visits
cells in order of the summed distances of its halves. How many it visits is set so that a pair
at the cosine limit, the hardest one, is met with the target recall: for sampled vectors a
partner exactly at the limit is drawn and the visits needed are counted. Codebooks are fitted on
at most `SAMPLE` vectors; every vector is indexed.

Equal vectors of a label form one class that stands for all of them. Vectors that meet in a cell
are compared in blocks by cosine in double; a task returns the number of links of each vector
and those links that join two of its trees, never all pairs.

Defined results: rows with a null label, or a vector that is null, empty, zero or holds null or
non-finite components, link with nothing; vectors of different lengths do not link; repeated rows
of an id count as that many vectors; a null id has no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.session import stored

from .common import groups, query
from .components import components, forest
from .vectors import embeddings, usable

SAMPLE = 16_384  # vectors that codebooks are fitted on
CELL = 256  # vectors a cell holds on average, over all labels
CODEWORDS = 512  # most codewords of one half; beyond, cells grow and are split into blocks
TARGET = 0.995
BLOCK = 1024


def _squares(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2 * points @ codes.T + (codes * codes).sum(axis=1)[None, :]


class MultiIndex:
    def __init__(self, sample: np.ndarray, words: int, limit: float, target: float, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.cut = sample.shape[1] // 2
        self.codes = [self._fit(part, words, draw) for part in self._halves(sample)]
        self.words = len(self.codes[0])
        self.visits = 1
        self.visits = self._calibrated(sample[:2000], limit, target, draw)

    def _halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, : self.cut], points[:, self.cut :]

    @staticmethod
    def _fit(points: np.ndarray, words: int, draw) -> np.ndarray:
        codes = points[draw.choice(len(points), min(words, len(points)), replace=False)].copy()
        for _ in range(10):
            nearest = _squares(points, codes).argmin(axis=1)
            size = np.bincount(nearest, minlength=len(codes))
            sums = np.zeros_like(codes)
            np.add.at(sums, nearest, points)
            codes = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], codes)
        return codes

    def _distances(self, points: np.ndarray) -> list[np.ndarray]:
        return [_squares(part, codes) for part, codes in zip(self._halves(points), self.codes)]

    def cells(self, points: np.ndarray) -> np.ndarray:
        first, second = self._distances(points)
        return first.argmin(axis=1) * self.words + second.argmin(axis=1)

    def _calibrated(self, points: np.ndarray, limit: float, target: float, draw) -> int:
        other = draw.normal(size=points.shape)
        other -= (other * points).sum(axis=1, keepdims=True) * points
        length = np.linalg.norm(other, axis=1, keepdims=True)
        partner = limit * points + np.sqrt(max(0.0, 1 - limit * limit)) * other / np.where(length > 0, length, 1)

        def needed(a, b):  # cells that a visits before the one of b
            first, second = self._distances(a)
            at = self.cells(b)
            reach = first[np.arange(len(a)), at // self.words] + second[np.arange(len(a)), at % self.words]
            return np.array([(f[:, None] + s[None, :] < r).sum() for f, s, r in zip(first, second, reach)])

        either = np.minimum(needed(points, partner), needed(partner, points))
        return int(np.quantile(either, target)) + 1

    def traversal(self, points: np.ndarray) -> np.ndarray:
        """Cells of each point in the order of the multi-sequence algorithm: a cell at places
        (i, j) of the two sorted lists is behind (i + 1)(j + 1) - 1 others, so only places with a
        product within the visits can be among them."""
        most = min(self.visits, self.words * len(self.codes[1]))
        first, second = self._distances(points)
        order = [np.argsort(d, axis=1, kind="stable") for d in (first, second)]
        i, j = np.divmod(np.arange(self.words * len(self.codes[1])), len(self.codes[1]))
        i, j = (p[(i + 1) * (j + 1) <= most] for p in (i, j))
        rows = np.arange(len(points))[:, None]
        a, b = order[0][:, i], order[1][:, j]
        visit = np.argsort(first[rows, a] + second[rows, b], axis=1, kind="stable")[:, :most]
        return (a * self.words + b)[rows, visit]


def _unit(vectors) -> np.ndarray:
    points = np.array([np.asarray(v, np.float64) for v in vectors])
    points /= np.maximum(np.abs(points).max(axis=1, keepdims=True), 1e-300)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _index(classes: DataFrame, size: int, limit: float, target: float) -> MultiIndex:
    sample = classes.where(F.size("vector") == size).orderBy(F.xxhash64("member"), "member").limit(SAMPLE)
    points = _unit(sample.select("vector").toPandas()["vector"])
    count = classes.where(F.size("vector") == size).count()
    return MultiIndex(points, int(min(CODEWORDS, max(1, round((count / CELL) ** 0.5)))), limit, target)


def _met(classes: DataFrame, size: int, index: MultiIndex) -> DataFrame:
    """One row for each class and cell it visits."""
    model = classes.sparkSession.sparkContext.broadcast(index.__dict__)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = MultiIndex.__new__(MultiIndex)
        index.__dict__.update(model.value)
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512].copy()
                part["visits"] = list(index.traversal(_unit(part["vector"])))
                yield part[["label", "member", "copies", "vector", "visits"]]

    rows = classes.where(F.size("vector") == size)
    visited = rows.mapInPandas(run, "label long, member long, copies long, vector array<double>, visits array<long>")
    return visited.select(F.lit(size).alias("size"), "*", F.explode("visits").alias("cell")).withColumn(
        "lives", F.col("cell") == F.element_at("visits", 1)
    )


def _compared(rows: DataFrame, limit: float) -> DataFrame:
    """(a, b, n): numbers of linked vectors (b null), and links that join trees (n null)."""
    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        here, asks = frame[frame["lives_here"]], frame[~frame["lives_here"]]
        if not len(here) or not len(asks):
            return frame.iloc[:0].assign(a=[], b=[], n=[])[["a", "b", "n"]]
        m, q = here["member"].to_numpy(), asks["member"].to_numpy()
        near = _unit(asks["vector"]) @ _unit(here["vector"]).T >= limit
        near &= q[:, None] != m[None, :]
        # a pair that meets in both cells, or twice in one, counts where the smaller id asks
        home = {i: set(v.tolist()) for i, v in zip(m.tolist(), here["visits"])}
        qs, ms = np.nonzero(near)
        own = [v[0] for v in asks["visits"]]
        once = np.array([q[i] < m[j] or own[i] not in home[m[j]] for i, j in zip(qs.tolist(), ms.tolist())], bool)
        qs, ms = qs[once], ms[once]
        counts = [
            pd.DataFrame({"a": q[qs], "n": here["copies"].to_numpy()[ms]}),
            pd.DataFrame({"a": m[ms], "n": asks["copies"].to_numpy()[qs]}),
        ]
        counts = pd.concat(counts).groupby("a", as_index=False)["n"].sum()
        known, place = np.unique(np.r_[q[qs], m[ms]], return_inverse=True)
        kept = forest(place[: len(qs)], place[len(qs) :])
        links = pd.DataFrame({"a": q[qs[kept]], "b": m[ms[kept]]})
        return pd.concat([counts, links]).reindex(columns=["a", "b", "n"]).astype("Int64")

    keys = ["size", "label", "cell", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(frames, keys):
            yield linked(frame)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, n long")


def near_vectors(rows: DataFrame, limit: float, vec_id: str = "vec_id", vector: str = "vector",
                 label: str = "label", target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; see the module for the rules."""
    rows = rows.select(
        F.col(vec_id).alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: x.cast("double")).alias("vector"),
    )
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("vector")
    able = able & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("key", F.when(able, F.struct(F.xxhash64("label", "vector"), F.xxhash64(F.lit(1), "vector", "label"))))
    classes = stored(
        rows.where("key is not null").groupBy("key", "label")
        .agg(F.min(F.struct("vec_id", "vector")).alias("first"), F.count("*").alias("copies"))
        .select("key", "label", "copies", F.col("first.vec_id").alias("member"), "first.vector")
    )
    sizes = [r[0] for r in classes.select(F.size("vector")).distinct().limit(1000).collect()]
    met = None
    for size in sizes:
        part = _met(classes, size, _index(classes, size, limit, target))
        met = part if met is None else met.unionByName(part)
    out = rows.select("vec_id", "key")
    if met is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = stored(met)
    held = met.groupBy("size", "label", "cell").agg(
        F.ceil(F.count_if("lives") / BLOCK).cast("int").alias("mine"), F.ceil(F.count("*") / BLOCK).cast("int").alias("theirs")
    ).where("mine > 0")
    met = met.join(held, ["size", "label", "cell"])
    spot = F.xxhash64("member")
    asks = met.withColumn("j", F.pmod(spot, "theirs").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)))
    here = met.where("lives").withColumn("i", F.pmod(spot, "mine").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    columns = ["size", "label", "cell", "i", "j", "member", "copies", "vector", "visits"]
    dealt = asks.select(*columns, F.lit(False).alias("lives_here")).union(here.select(*columns, F.lit(True).alias("lives_here")))
    found = stored(_compared(dealt, limit))
    joined = components(found.where("b is not null").select("a", "b"))
    linked = found.where("n is not null").groupBy(F.col("a").alias("member")).agg(F.sum("n").alias("n"))
    classes = (
        classes.select("key", "member", "copies").join(linked, "member", "left")
        .join(joined.withColumnRenamed("node", "member"), "member", "left")
        .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "member").alias("component_id"))
    )
    out = out.join(classes, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query("op8_near_vectors")
def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir), 0.93, vector="embedding")
