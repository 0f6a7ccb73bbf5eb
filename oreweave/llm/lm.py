"""Language-model scores: deleted interpolation of word n-grams.

The model mixes maximum-likelihood estimates of bigrams and unigrams with a uniform share for
words never seen. The mixture weights depend on how often the context was counted, in buckets of
powers of two, and are learned by expectation-maximisation on held-out counts: a part of the
training documents is kept apart, counted estimates of the others predict it, and afterwards its
counts join theirs. The word before a document's first one is the end of a document.

Texts are turned into word numbers once, in blocks of one kind (counted, held out, only scored).
Blocks send their distinct words and pairs with counts, already summed, to buckets by hash, and
get back the counts over the whole corpus; no count table is ever in one place. For the weights,
held-out tokens are gathered in cells of (bucket, two estimates in quarter powers of two): a
table of bounded size whatever the corpus. Pairs are told apart by 40 bits within a bucket of
about a million, words by 48.

Defined results: null and empty texts are their end alone; null ids are in fold 0; repeated rows
count as often as they occur; without training documents every estimate is the uniform share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.session import stored

from .common import Memo, documents, fold, groups, id_in, id_out, mix, pack, query, unpack

BLOCK_TOKENS = 1 << 20  # of a block, and about the entries of one bucket
COUNTED, HELD_OUT, SCORED = 0, 1, 2
END = np.uint64(0xE4D0_0F_7E27)  # stands for the end of a document among word hashes
STEPS, SMALLEST = 4, 32  # cells: quarter powers of two, down to 2 ** -32
EM_ROUNDS = 200


def token_blocks(docs: DataFrame, kind: Column) -> DataFrame:
    """block, kind, tokens, ids, sizes, words (hashes in order), numbers (of each token's word)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        known = Memo(xxhash.xxh64_intdigest, 300_000)
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {COUNTED: [], HELD_OUT: [], SCORED: []}
        size = dict.fromkeys(held, 0)

        def block(kind):
            ids = np.array([i for i, _ in held[kind]], np.int64)
            sizes = np.array([len(t) for _, t in held[kind]], np.int64)
            words, numbers = np.unique(np.concatenate([t for _, t in held[kind]]), return_inverse=True)
            return pd.DataFrame({
                "block": [number], "kind": [kind], "tokens": [len(numbers)], "ids": [pack(ids)], "sizes": [pack(sizes)],
                "words": [pack(words)], "numbers": [pack(numbers.astype(np.uint32))],
            })

        for frame in frames:
            for doc_id, text, kind in zip(frame["doc_id"], frame["text"], frame["kind"].tolist()):
                words = text.encode().lower().split() if text else []
                tokens = np.array([*map(known.__getitem__, words), int(END)], np.uint64)
                held[kind].append((doc_id, tokens))
                size[kind] += len(tokens)
                if size[kind] >= BLOCK_TOKENS:
                    yield block(kind)
                    number, held[kind], size[kind] = number + 1, [], 0
        for kind in held:
            if held[kind]:
                yield block(kind)
                number += 1

    return docs.select(id_in(), "text", kind.cast("int").alias("kind")).mapInPandas(
        run, "block long, kind int, tokens long, ids binary, sizes binary, words binary, numbers binary"
    )


class Entries:
    """Distinct words or pairs of a block in the order (bucket, key), and the entry of each token."""

    def __init__(self, row, buckets: int, pairs: bool):
        words, numbers = unpack(row.words, np.uint64), unpack(row.numbers, np.uint32)
        hashes, bits = mix(words), 48
        self.of, self.count = numbers.astype(np.int64), np.bincount(numbers, minlength=len(words))
        if pairs:
            code = context(words, numbers) << np.uint64(32) | numbers.astype(np.uint64)
            code, self.of, self.count = np.unique(code, return_inverse=True, return_counts=True)
            left, right = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
            hashes, bits = mix(hashes[left] * np.uint64(3) + hashes[right]), 40
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        key = mix(hashes + END) >> np.uint64(64 - bits)
        order = np.lexsort((key, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of, self.count = place[self.of], self.count[order]
        self.key, bucket = key[order], bucket[order]
        self.buckets, self.starts = np.unique(bucket, return_index=True)

    def parts(self, values: np.ndarray) -> list[np.ndarray]:
        return np.split(values, self.starts[1:])

    def of_tokens(self, replies, name: str) -> np.ndarray:
        """One of the replied counts, for every token."""
        found = {r["bucket"]: r[name] for r in replies}
        return np.concatenate([unpack(found[b], np.uint32) for b in self.buckets.tolist()]).astype(np.int64)[self.of]


def context(words: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Number of the word before each token; documents follow one another, each ended by END."""
    end = np.searchsorted(words, END)
    return np.r_[end, numbers[:-1]].astype(np.uint64)


def _asked(table: DataFrame, buckets: int, pairs: bool) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                e = Entries(row, buckets, pairs)
                count = e.count if row.kind != SCORED else np.zeros_like(e.count)
                rows = [
                    (b, row.block, row.kind, pack(k.astype(np.uint32)), pack((k >> np.uint64(32)).astype(np.uint16)), pack(c.astype(np.uint32)))
                    for b, k, c in zip(e.buckets.tolist(), e.parts(e.key), e.parts(count))
                ]
                yield pd.DataFrame(rows, columns=["bucket", "block", "kind", "low", "high", "count"])

    return table.select("block", "kind", "words", "numbers").mapInPandas(
        run, "bucket long, block long, kind int, low binary, high binary, count binary"
    )


def _counted(asked: DataFrame) -> DataFrame:
    """For each block and bucket the corpus counts of its entries, without and with the held-out
    documents; `distinct` of them were counted in this bucket (in its first row only)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(frames, ["bucket"]):
            low = [unpack(v, np.uint32) for v in frame["low"]]
            sizes = [len(p) for p in low]
            key = np.concatenate(low).astype(np.uint64)
            key |= np.concatenate([unpack(v, np.uint16) for v in frame["high"]]).astype(np.uint64) << np.uint64(32)
            count = np.concatenate([unpack(v, np.uint32) for v in frame["count"]]).astype(np.float64)
            kind = np.repeat(frame["kind"].to_numpy(), sizes)
            _, of = np.unique(key, return_inverse=True)
            both = np.bincount(of, count)
            counted = np.bincount(of, count * (kind == COUNTED))
            cuts = np.cumsum(sizes)[:-1]
            split = lambda c: [pack(p) for p in np.split(c[of].astype(np.uint32), cuts)]
            yield pd.DataFrame({
                "block": frame["block"].to_numpy(), "bucket": frame["bucket"].to_numpy(),
                "counted": split(counted), "both": split(both),
                "distinct": np.r_[(both > 0).sum(), np.zeros(len(sizes) - 1, np.int64)],
                "distinct_counted": np.r_[(counted > 0).sum(), np.zeros(len(sizes) - 1, np.int64)],
            })

    dealt = asked.repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInPandas(run, "block long, bucket long, counted binary, both binary, distinct long, distinct_counted long")


def _with_counts(table: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """A block with the replies of its buckets: at most one from each."""
    for name, replies in (("word_counts", words), ("pair_counts", pairs)):
        held = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "counted", "both")).alias(name))
        table = table.join(held, "block")
    return table


def _estimates(row, buckets: int, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each token's pair, context and word."""
    single, pair = Entries(row, buckets, False), Entries(row, buckets, True)
    word = single.of_tokens(row.word_counts, name)
    by_number = np.zeros(len(single.count), np.int64)
    numbers = unpack(row.numbers, np.uint32)
    by_number[numbers] = word
    before = context(unpack(row.words, np.uint64), numbers).astype(np.int64)
    return pair.of_tokens(row.pair_counts, name), by_number[before], word


def frequency_bucket(count: np.ndarray) -> np.ndarray:
    """0 for contexts never counted, else one more than the whole part of the binary logarithm."""
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0)


def _level(share: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        level = np.rint(-STEPS * np.log2(share))
    return np.minimum(level, SMALLEST * STEPS).astype(np.int64) + 1


class Weights:
    """Mixture weights (pair, word, uniform) for each frequency bucket, by EM over cells."""

    def __init__(self, cells: np.ndarray, uniform: float, rounds: int = EM_ROUNDS):
        """cells: rows of bucket, pair level, word level, tokens; level 0 stands for never seen."""
        size = 64
        bucket, tokens = cells[:, 0].astype(int), cells[:, 3]
        share = np.where(cells[:, 1:3] > 0, 2.0 ** (-(cells[:, 1:3] - 1) / STEPS), 0)
        share = np.c_[share, np.full(len(cells), uniform)]
        pooled = self._fit(share, tokens, np.zeros(len(cells), int), 1, rounds)[0]
        self.table = np.tile(pooled, (size, 1))
        fitted = self._fit(share, tokens, bucket, size, rounds)
        some = np.bincount(bucket, tokens, size) > 0
        self.table[some] = fitted[some]
        self.table = np.maximum(self.table, 1e-7)
        self.table[0, 0] = 0
        self.table /= self.table.sum(axis=1, keepdims=True)

    @staticmethod
    def _fit(share, tokens, bucket, size: int, rounds: int) -> np.ndarray:
        weights = np.full((size, 3), 1 / 3)
        for _ in range(rounds):
            part = weights[bucket] * share
            part *= (tokens / np.maximum(part.sum(axis=1), 1e-300))[:, None]
            total = np.stack([np.bincount(bucket, part[:, k], size) for k in range(3)], axis=1)
            sums = total.sum(axis=1, keepdims=True)
            weights = np.where(sums > 0, total / np.maximum(sums, 1e-300), weights)
        return weights


def _cells(table: DataFrame, buckets: int, counted_tokens: int) -> np.ndarray:
    """Held-out tokens by frequency bucket and levels of both estimates; at most
    64 * (32 * 4 + 2) ** 2 rows whatever the corpus."""
    width = SMALLEST * STEPS + 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                pair, before, word = _estimates(row, buckets, "counted")
                pair_level = np.where(pair > 0, _level(np.maximum(pair, 1) / np.maximum(before, 1)), 0)
                word_level = np.where(word > 0, _level(np.maximum(word, 1) / max(counted_tokens, 1)), 0)
                cell, tokens = np.unique((frequency_bucket(before) * width + pair_level) * width + word_level, return_counts=True)
                yield pd.DataFrame({"cell": cell, "tokens": tokens})

    sums = table.mapInPandas(run, "cell long, tokens long").groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect()
    cells = np.array(sorted((r.cell, r.tokens) for r in sums), np.float64).reshape(-1, 2)
    return np.c_[cells[:, 0] // width**2, cells[:, 0] // width % width, cells[:, 0] % width, cells[:, 1]]


def score(docs: DataFrame, learn: Column, tune: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    `learn` marks training documents; `tune` those of them that the weights are learned on.
    """
    kind = F.when(~learn, SCORED).when(tune, HELD_OUT).otherwise(COUNTED)
    table = stored(token_blocks(docs, kind))
    totals = {r.kind: r.tokens for r in table.groupBy("kind").agg(F.sum("tokens").alias("tokens")).collect()}
    buckets = max(1, -(-sum(totals.values()) // BLOCK_TOKENS))
    counted_tokens = totals.get(COUNTED, 0)
    train_tokens = counted_tokens + totals.get(HELD_OUT, 0)
    words = stored(_counted(_asked(table, buckets, False)))
    pairs = stored(_counted(_asked(table, buckets, True)))
    distinct, distinct_counted = words.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("distinct_counted"), F.lit(0))).first()
    held_out = _with_counts(table.where(F.col("kind") == HELD_OUT), words, pairs)
    weights = Weights(_cells(held_out, buckets, counted_tokens), 1 / (distinct_counted + 1)).table
    uniform, base_total = 1 / (distinct + 1), train_tokens + distinct + 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                pair, before, word = _estimates(row, buckets, "both")
                w = weights[frequency_bucket(before)]
                share = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(train_tokens, 1) + w[:, 2] * uniform
                ids, sizes = unpack(row.ids, np.int64), unpack(row.sizes, np.int64)
                starts = np.cumsum(sizes) - sizes
                yield pd.DataFrame({
                    "doc_id": ids, "held_out": row.kind == SCORED, "n_tokens": sizes,
                    "n_known": np.add.reduceat((word > 0).astype(np.int64), starts), "train_tokens": train_tokens,
                    "base_score": np.add.reduceat(np.log10((word + 1) / base_total), starts),
                    "score": np.add.reduceat(np.log10(share), starts),
                })

    return id_out(_with_counts(table, words, pairs).mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    ))


@query("op9_lm_scores")
def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fold("doc_id", 7)
    return score(documents(spark, sf_dir), learn=part != 2, tune=part == 6)
