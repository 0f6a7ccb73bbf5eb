"""Alignment of two tokenisations of a text by diagonal run skipping.

Both tokenisations cover the same bytes, so each is the rising list of its tokens' ends. At a
common end the lists are compared at the current shift between their indices: stretches of
1, 2, 4, ... tokens as long as all ends agree, then halves of the last one, so a run of one-to-one
tokens is jumped in logarithmically many comparisons. Where the ends differ, both lists are
walked to the next common end; that is one irregular group, its overlapping tokens are linked
on the way, and the shift becomes what the group left.

Texts are cut before single blanks between other signs, which no token of either vocabulary
spans. All new stretches of a window are encoded and aligned as one text, and the groups and
links of each are remembered for its next occurrence. A task holds
the links of about `BLOCK_BYTES` of text and passes on each pair of ids once per block: pairs are
counted and joined with their counts as plain rows, and one row per block brings them back.

Defined results: null and empty texts, and texts that the tokens of either side do not give back
byte by byte, have zeros and an empty digest. A null id is kept; repeated rows are counted and
returned each.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.session import stored

from .common import documents, groups, id_in, id_out, pack, per_worker, query, unpack

CUT = re.compile(r"(?<=\S)(?= \S)")
STRETCHES = 300_000  # stretches of text in the younger half of a worker's memory
SHORT = 100  # signs of a stretch that is remembered
WINDOW = 1 << 14  # stretches aligned together
BLOCK_BYTES = 12 << 20  # text whose pairs are counted together
JOINED = 1 << 15  # signs of new stretches encoded and aligned together
Entry = tuple[int, int, int, bytes, bytes]  # tokens of both sides, groups, their text, linked pairs


def byte_signs() -> dict[str, int]:
    """Signs by which byte-level vocabularies write bytes: themselves if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Aligner:
    """Stretches of text (each begins with a blank) to their aligned tokens."""

    def __init__(self, byte_model: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_str(byte_model)
        self._a.encode_special_tokens = True
        signs = byte_signs()
        self.a_bytes = {i: bytes(map(signs.__getitem__, t)) for t, i in self._a.get_vocab(with_added_tokens=False).items() if all(c in signs for c in t)}
        self._b = SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes = [self._piece(i) for i in range(self._b.get_piece_size())]
        self._young: dict[str, Entry | None] = {}
        self._old: dict[str, Entry | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes.fromhex(piece[3:-1]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def _aligned(self, stretches: list[str]) -> list[Entry | None]:
        """New stretches, encoded and aligned as one text; None for one that a side changes."""
        text = "".join(stretches)
        ids_a = self._a.encode(text, add_special_tokens=False).ids
        ids_b = self._b.encode(text[1:]) if len(text) > 1 else []  # it adds the blank itself
        parts_a, parts_b, data = [self.a_bytes[i] for i in ids_a], [self.b_bytes[i] for i in ids_b], text.encode()
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            half = len(stretches) // 2
            return [*self._aligned(stretches[:half]), *self._aligned(stretches[half:])] if half else [None]
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        entries, links_a, links_b = align(ends_a, ends_b)
        groups_, ends = [], []
        for i, end_a, j, end_b in entries:
            if i >= 0:
                groups_ += map("%d|%d".__mod__, zip(ids_a[i:end_a], ids_b[j:end_b]))
                ends += ends_a[i:end_a]
            else:
                groups_.append(",".join(map(str, ids_a[~i:end_a])) + "|" + ",".join(map(str, ids_b[j:end_b])))
                ends.append(ends_a[end_a - 1])
        codes = np.array(ids_a, np.int64)[links_a] * len(self.b_bytes) + np.array(ids_b, np.int64)[links_b]
        whole_a, whole_b = np.array(ends_a, np.int64), np.array(ends_b, np.int64)
        cuts = np.cumsum([len(s.encode()) for s in stretches]) if len(stretches) > 1 else whole_a[-1:]
        sides = (whole_a, whole_b, np.array(ends, np.int64), np.minimum(whole_a[links_a], whole_b[links_b]))
        places = [[0, *np.searchsorted(side, cuts, "right").tolist()] for side in sides]
        data = codes.tobytes()
        return [
            (a1 - a0, b1 - b0, g1 - g0, ";".join(groups_[g0:g1]).encode(), data[8 * l0 : 8 * l1])
            for a0, a1, b0, b1, g0, g1, l0, l1 in zip(*(side[k : k + len(cuts)] for side in places for k in (0, 1)))
        ]

    def __call__(self, stretches: list[str]) -> list[Entry | None]:
        if len(self._young) > STRETCHES:
            self._old, self._young = self._young, {}
        young, old, once, new, size = self._young, self._old, {}, [], 0

        def learn(some: list[str]) -> None:
            for s, found in zip(some, self._aligned(some)):
                (young if len(s) < SHORT else once)[s] = found

        for s in dict.fromkeys(stretches):
            if s in young:
                continue
            if s in old:
                young[s] = old[s]
            elif s[-1].isspace() or s[1].isspace():  # begins or ends a text with blanks: not to be joined
                learn([s])
            else:
                new.append(s)
                size += len(s)
                if size > JOINED:
                    learn(new)
                    new, size = [], 0
        if new:
            learn(new)
        return [young[s] if s in young else once[s] for s in stretches] if once else [young[s] for s in stretches]


def run_length(left: bytes, right: bytes, i: int, j: int) -> int:
    """Tokens from i and j on whose ends (four bytes each) agree one to one."""
    run, step = 0, 1
    while True:  # double
        p, q, width = 4 * (i + run), 4 * (j + run), 4 * step
        part = left[p : p + width]
        if len(part) < width or part != right[q : q + width]:
            break
        run, step = run + step, 2 * step
    while step > 1:  # halve
        step //= 2
        p, q, width = 4 * (i + run), 4 * (j + run), 4 * step
        part = left[p : p + width]
        if len(part) == width and part == right[q : q + width]:
            run += step
    return run


def align(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Groups between common ends and linked indices, for two rising lists with the same last end.

    An entry is (first, behind) of the left and of the right side: a run of one-to-one groups, or
    one irregular group, whose first is given as its complement.
    """
    left, right = np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()
    links_a, links_b = array("q"), array("q")
    found, i, j, total = [], 0, 0, len(a)
    while i < total:
        if a[i] == b[j]:
            run = run_length(left, right, i, j)
            found.append((i, i + run, j, j + run))
            links_a.extend(range(i, i + run))
            links_b.extend(range(j, j + run))
            i, j = i + run, j + run
        else:
            first, other = i, j
            end_a, end_b = a[i], b[j]
            while True:
                links_a.append(i)
                links_b.append(j)
                if end_a < end_b:
                    i += 1
                    end_a = a[i]
                elif end_b < end_a:
                    j += 1
                    end_b = b[j]
                else:
                    break
            i, j = i + 1, j + 1
            found.append((~first, i, other, j))
    return found, np.frombuffer(links_a, np.int64), np.frombuffer(links_b, np.int64)


class Aligned:
    """Counts, digest and links of one text, put together from its stretches."""

    def __init__(self, aligner: Aligner, text: str | None):
        self.n_a = self.n_b = self.n_groups = 0
        digest, links = hashlib.sha256(), []
        stretches = CUT.split(" " + text) if text else []
        for at in range(0, len(stretches), WINDOW):
            found = aligner(stretches[at : at + WINDOW])
            if None in found:
                self.n_a = self.n_b = self.n_groups = 0
                links = []
                break
            a, b, n, texts, codes = zip(*found)
            digest.update((b";" if at else b"") + b";".join(texts))
            self.n_a, self.n_b, self.n_groups = self.n_a + sum(a), self.n_b + sum(b), self.n_groups + sum(n)
            links += codes
        self.digest = digest.hexdigest() if self.n_a else ""
        self.links = np.frombuffer(b"".join(links), np.int64)


def aligned_blocks(docs: DataFrame, byte_model_path: str, piece_model_path: str) -> DataFrame:
    """One row per block of documents: packed counts and digests, the block's pairs, and each document's among them."""
    context = docs.sparkSession.sparkContext
    models = context.broadcast((open(byte_model_path, encoding="utf-8").read(), open(piece_model_path, "rb").read()))
    job = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = per_worker(job, lambda: Aligner(*models.value))
        first, number = TaskContext.get().partitionId() << 32, 0
        held, digests, pairs, times, size = [], [], [], [], 0

        def block() -> pd.DataFrame:
            which, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
            each, widths = np.concatenate(times), np.array([len(p) for p in pairs], np.int64)
            total = np.bincount(inverse, each, len(which)).astype(np.int64)
            return pd.DataFrame({
                "block": [first + number], "rows": [pack(np.array(held, np.int64).reshape(-1, 5).T.ravel())], "digests": ["\n".join(digests)],
                "pairs": [pack(np.diff(which, prepend=0))], "times": [pack(total)], "widths": [pack(widths)],
                "places": [pack(inverse.astype(np.uint32))], "each": [pack(each)],
            })

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"]):
                found = Aligned(aligner, text)
                codes, n = np.unique(found.links, return_counts=True)
                held.append((doc_id, found.n_a, found.n_b, found.n_groups, len(found.links)))
                digests.append(found.digest)
                pairs.append(codes)
                times.append(n)
                size += len(text.encode()) if text else 0
                if size >= BLOCK_BYTES or len(held) >= 1 << 17:
                    yield block()
                    held, digests, pairs, times, size, number = [], [], [], [], 0, number + 1
        if held:
            yield block()

    schema = "block long, rows binary, digests string, pairs binary, times binary, widths binary, places binary, each binary"
    return docs.select(id_in(), "text").mapInPandas(run, schema)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """block, pair, n: the pairs of ids of each block and how many links hold them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, pairs, times in zip(frame["block"], frame["pairs"], frame["times"]):
                yield pd.DataFrame({"block": block, "pair": np.cumsum(unpack(pairs, np.int64)), "n": unpack(times, np.int64)})

    return blocks.select("block", "pairs", "times").mapInPandas(run, "block long, pair long, n long")


def pair_counts(pairs: DataFrame, b_size: int) -> DataFrame:
    """pair, count over the corpus, best: whether no pair of the same B id has a higher count."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("b", F.col("pair") % b_size)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, byte_model_path: str, piece_model_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    from sentencepiece import SentencePieceProcessor

    b_size = SentencePieceProcessor(model_file=piece_model_path).get_piece_size()
    blocks = stored(aligned_blocks(docs, byte_model_path, piece_model_path))
    pairs = block_pairs(blocks)
    counts = stored(pair_counts(pairs, b_size))
    known = pairs.select("block", "pair").join(counts, "pair").repartition("block").sortWithinPartitions("block", "pair")

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(frames, ["block"]):
            count, best = frame["count"].to_numpy(np.int64), frame["best"].to_numpy(np.uint8)
            yield pd.DataFrame({"block": frame["block"].iloc[:1], "counts": [pack(count)], "best": [pack(best)]})

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, n_a, n_b, n_groups, n_links = unpack(row.rows, np.int64).reshape(5, -1)
                count, best = (unpack(row.counts, np.int64), unpack(row.best, np.uint8)) if row.counts is not None else (np.zeros(0, np.int64),) * 2
                place, each, widths = unpack(row.places, np.uint32), unpack(row.each, np.int64), unpack(row.widths, np.int64)
                ends = np.cumsum(widths)
                sums = [np.concatenate([[0], np.cumsum(values)]) for values in (best[place] * each, count[place] * each)]
                n_best, count_sum = (s[ends] - s[ends - widths] for s in sums)
                yield pd.DataFrame({
                    "doc_id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                    "n_best": n_best, "count_sum": count_sum, "groups_sha256": row.digests.split("\n"),
                })

    back = known.mapInPandas(gathered, "block long, counts binary, best binary")
    whole = blocks.select("block", "rows", "digests", "widths", "places", "each").join(back, "block", "left")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return id_out(whole.mapInPandas(finish, schema))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
