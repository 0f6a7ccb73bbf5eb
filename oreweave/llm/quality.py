"""Document quality: random-indexing word vectors, pooled, and a small calibrated network.

Words are the runs between ASCII blanks, in their own case. A word has a row among `WORDS` by its
hash, and its shape (runs of capitals, small letters, digits and each sign) one among `SHAPES`
rows of their own. Every word has a sparse random index vector, half of it given by its shape;
the vector of a row is the sum of the index vectors of its words' neighbours over the whole
corpus, where a neighbour equal to the word counts as one special
neighbour. A document is the mean and the spread of its words' unit vectors, and of those of their
shapes. A network with one
hidden layer is trained on at most `TRAIN_ROWS` labelled documents, and its temperature is fitted
on a fifth of them that the weights never saw.

Defined results: null, empty and blank texts pool to zero and get the network's score of that;
rows are scored one by one, repeated or not; without any usable label every score is 0.5.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, documents, fold, pack, per_worker, query, unpack

SHAPES, WORDS, SIZE = 256, 1 << 18, 48
ROWS = WORDS + SHAPES
FEATURES = 4 * SIZE
NONZERO = 4  # of an index vector's word half and of its shape half
PART = 256  # vectors in one row while the table is summed
TRAIN_ROWS = 20_000
HIDDEN = 32


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 9; every other sign once."""
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


def _code(word: bytes) -> int:
    """Number of the word among WORDS, and of its shape above that."""
    import xxhash

    form = shape(word[:64].decode("utf-8", "replace")).encode()
    return xxhash.xxh64_intdigest(form) % SHAPES * WORDS + xxhash.xxh64_intdigest(word) % WORDS


def _memo() -> Memo:
    return Memo(_code, 300_000)


def _codes(memo: Memo, text: str | None) -> np.ndarray:
    return np.array([memo[w] for w in text.encode().split()] if text else [], np.int64)


def index_vectors() -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and signs of the nonzeros for words and for shapes, each with a last row for `the word itself`."""
    draw = np.random.default_rng(20_24)
    return [
        (draw.integers(0, SIZE, (n + 1, NONZERO), np.int32), draw.integers(0, 2, (n + 1, NONZERO), np.int32) * 2 - 1)
        for n in (WORDS, SHAPES)
    ]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of words and behind them of shapes, from all documents; a table of fixed size."""
    job = uuid.uuid4().hex

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = per_worker(job, _memo)
        halves = index_vectors()
        total = np.zeros(ROWS * SIZE, np.int32)
        shapes = total[WORDS * SIZE :]

        def add(words: np.ndarray, beside: np.ndarray) -> None:
            for at in range(0, len(words), 1 << 18):
                w, v = words[at : at + (1 << 18)], beside[at : at + (1 << 18)]
                own, form = w % WORDS * SIZE, w // WORDS * SIZE
                same = w == v
                for (place, sign), n, rows in zip(halves, (WORDS, SHAPES), (v % WORDS, v // WORDS)):
                    rows = np.where(same, n, rows)
                    places, signs = place[rows], sign[rows]
                    np.add.at(total, (own[:, None] + places).ravel(), signs.ravel())
                    shapes[:] += np.bincount((form[:, None] + places).ravel(), signs.ravel(), SHAPES * SIZE).astype(np.int32)

        def flush(held: list[np.ndarray]) -> None:
            if held:
                both = np.concatenate(held)  # -1 stands between documents
                left, right = both[:-1], both[1:]
                inside = (left >= 0) & (right >= 0)
                add(left[inside], right[inside])
                add(right[inside], left[inside])

        held, size, gap = [], 0, np.array([-1])
        for frame in frames:
            for text in frame["text"]:
                words = _codes(memo, text)
                held += [words, gap]
                size += len(words)
                if size > 1 << 20:
                    flush(held)
                    held, size = [], 0
        flush(held)
        table = total.reshape(-1, PART * SIZE)
        some = np.flatnonzero(table.any(axis=1))
        for at in range(0, len(some), 64):
            yield pd.DataFrame({"part": some[at : at + 64], "sums": [pack(table[k]) for k in some[at : at + 64]]})

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, data in zip(frame["part"].tolist(), frame["sums"]):
                sums[part] = sums.get(part, 0) + unpack(data, np.int32).astype(np.int64)
        yield pd.DataFrame({"part": list(sums), "sums": [pack(s) for s in sums.values()]})

    partial = docs.select("text").mapInPandas(count, "part int, sums binary")
    summed = partial.repartition("part").mapInPandas(add_up, "part int, sums binary")
    table = np.zeros((ROWS, SIZE), np.float32)
    for row in summed.collect():
        sums = unpack(row.sums, np.int64).reshape(PART, SIZE).astype(np.float64)
        table[row.part * PART : (row.part + 1) * PART] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return table


def _pooled(memo: Memo, vectors: np.ndarray, text: str | None) -> np.ndarray:
    codes = _codes(memo, text)
    if not len(codes):
        return np.zeros(FEATURES, np.float32)
    out = []
    for rows in (codes % WORDS, WORDS + codes // WORDS):
        found = vectors[rows]
        mean = found.mean(axis=0)
        out += [mean, np.sqrt(np.maximum((found * found).mean(axis=0) - mean * mean, 0))]
    return np.concatenate(out)


class Network:
    """Logistic output over one hidden layer of tanh units, with a temperature."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        if not len(labels):
            features, labels = np.zeros((2, FEATURES)), np.array([0.0, 1.0])
        order = draw.permutation(len(labels))
        held = order[: len(order) // 5]
        learn = order[len(order) // 5 :]
        self.mean = features[learn].mean(axis=0)
        self.scale = features[learn].std(axis=0) + 1e-6
        x, y = self._scaled(features), labels.astype(np.float64)
        self.weights = [
            draw.normal(0, (1 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
            draw.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1),
        ]
        self._train(x[learn], y[learn], draw)
        self.temperature = 1.0
        if len(held):
            z, t = self._logits(x[held]), np.geomspace(0.25, 8, 61)
            loss = [np.logaddexp(0, np.where(y[held] == 1, -z, z) / k).mean() for k in t]
            self.temperature = float(t[int(np.argmin(loss))])

    def _scaled(self, features: np.ndarray) -> np.ndarray:
        return (features.astype(np.float64) - self.mean) / self.scale

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d[0]

    def _train(self, x: np.ndarray, y: np.ndarray, draw, epochs: int = 120, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3) -> None:
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for at in range(0, len(y), batch):
                rows = order[at : at + batch]
                hidden = np.tanh(x[rows] @ self.weights[0] + self.weights[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.weights[2] + self.weights[3][0], -40, 40))) - y[rows]) / len(rows)
                back = np.outer(error, self.weights[2]) * (1 - hidden * hidden)
                slopes = [x[rows].T @ back + decay * self.weights[0], back.sum(axis=0), hidden.T @ error + decay * self.weights[2], np.array([error.sum()])]
                step += 1
                for w, m, v, g in zip(self.weights, first, second, slopes):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def __call__(self, features: np.ndarray) -> np.ndarray:
        z = self._logits(self._scaled(features)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Word vectors and network; `score` gives a column."""

    def __init__(self, docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS):
        """labels: doc_id, label (1 good, else bad), null labels ignored; `learn` over doc_id."""
        self.vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
        known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
        sample = known.where(learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most `rows` rows: small enough to broadcast
        chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        found = chosen.select("doc_id", "label", self._features()("text").alias("x")).collect()
        found = sorted({r.doc_id: (r.x, r.label) for r in found}.items())
        x = np.array([np.frombuffer(v[0], np.float32) for _, v in found], np.float64).reshape(len(found), FEATURES)
        y = np.array([v[1] == 1 for _, v in found], bool)
        self.network = Network(x, y)

    def _features(self):
        vectors, job = self.vectors, uuid.uuid4().hex

        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            memo = per_worker(job, _memo)
            for texts in series:
                yield texts.map(lambda t: _pooled(memo, vectors.value, t).astype(np.float32).tobytes())

        return F.pandas_udf(run, "binary")

    def score(self, spark: SparkSession, text: str = "text") -> Column:
        vectors, job, network = self.vectors, uuid.uuid4().hex, self.network

        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            memo = per_worker(job, _memo)
            for texts in series:
                pooled = np.array([_pooled(memo, vectors.value, t) for t in texts]).reshape(len(texts), FEATURES)
                yield pd.Series(network(pooled))

        return F.pandas_udf(run, "double")(text)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return Model(docs, labels, fold("doc_id", 4) != 2)


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality_model(spark, docs, sf_dir)
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), model.score(spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
