"""Near-duplicate documents: SuperMinHash signatures, banding, verification, union-find.

Words are the runs between the six ASCII blanks of the text with A-Z lowered; a document's set
holds its distinct shingles of `width` words. Every element orders the signature's slots by its
own permutation and offers step j + r to the slot at place j, so one element gives each slot a
value of another rank: correlated ranks with less variance than independent minima. An element
stops as soon as its step number exceeds the document's largest slot value.

Documents with equal sets form one class with the smallest id as its member that is compared.
Signatures are cut into bands; members that share a band value are compared on their full sets,
in blocks, and a task returns only links that join two of its trees. The bands come in two
rounds: the second one looks only at band values that still hold two components. Copies in a
class, and pairs already connected, are never compared.

Defined results: null, empty and blank texts have an empty set and stay alone; fewer words than
`width` make one shingle; repeated rows of an id count once; a null id has no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.session import stored

from .common import Memo, documents, forget_worker, groups, id_in, id_out, mix, query
from .components import components, forest

BAND_ROWS = 5
ROUNDS = (4, 16)  # bands in each round; at 0.85 a pair shares none of them once in 120,000
BLOCK = 192  # members of one side of a comparison
SLICE = 65_536  # elements whose permutations are held at a time


class Shingles:
    """Sets of 64-bit shingle hashes."""

    def __init__(self, width: int):
        import xxhash

        self.width = width
        self.word = Memo(xxhash.xxh64_intdigest, 300_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.array([self.word[w] if len(w) < 64 else self.word.make(w) for w in words], np.uint64)
        width = min(self.width, len(hashes))
        size = len(hashes) - width + 1
        out = np.full(size, width, np.uint64)
        for k in range(width):
            out = mix(out + hashes[k : k + size])
        return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures of many sets, one row each; rows of empty sets are infinite."""
    out = np.full(len(sets) * slots, np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for at in range(0, len(elements), SLICE):
        own, element = owner[at : at + SLICE], elements[at : at + SLICE]
        order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(own), 1))
        for j in range(slots):
            if j:
                worst = out.reshape(-1, slots).max(axis=1)
                live = worst[own] > j
                if not live.all():
                    own, element, order = own[live], element[live], order[live]
                if not len(own):
                    break
            rows = np.arange(len(own))
            draw = mix(element + np.uint64(0x9E3779B97F4A7C15 * (2 * j + 1) % 2**64))
            place = j + (draw % np.uint64(slots - j)).astype(np.int64)
            chosen = order[rows, place]
            order[rows, place] = order[:, j]
            value = j + (mix(draw) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            np.minimum.at(out, own * slots + chosen, value)
    return out.reshape(len(sets), slots)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (128 bits of the set, null if empty) and the band values."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        forget_worker()
        shingles = Shingles(width)
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                sets = [shingles(t) for t in part["text"]]
                words = super_minhash(sets, bands * rows).view(np.uint64).reshape(len(sets), bands, rows)
                value = np.full((len(sets), bands), 1, np.uint64) * np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(rows):
                    value = mix(value + words[:, :, k])
                value = value.view(np.int64)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"],
                    "n_shingles": [len(s) for s in sets],
                    "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "bands": [v if len(s) else v[:0] for s, v in zip(sets, value)],
                })

    rows = docs.select(id_in(), "text").mapInPandas(run, "doc_id long, n_shingles long, key binary, bands array<long>")
    return id_out(rows)


def _compared(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join trees within each group of (band, i, j): members of blocks i and j."""
    shingles = Shingles(width)

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t) for t in frame["text"]]
        ids, block, comp = (frame[c].to_numpy() for c in ("member", "block", "component"))
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        number = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
        often = np.bincount(number) > 1  # only shingles that two members have can meet
        keep = often[number]
        owner, number = owner[keep], (np.cumsum(often) - 1)[number[keep]]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(often.sum()), 8192):
            a, b = np.searchsorted(number, (low, low + 8192))
            part = np.zeros((len(sets), min(8192, int(often.sum()) - low)), np.float32)
            part[owner[a:b], number[a:b] - low] = 1
            shared += part @ part.T
        shared = shared.astype(np.int64)
        near = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
        near &= comp[:, None] != comp[None, :]
        if frame["i"].iloc[0] != frame["j"].iloc[0]:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(near, 1))
        kept = forest(a, b, comp)
        return pd.DataFrame({"a": ids[a[kept]], "b": ids[b[kept]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_worker()
        for frame in groups(frames, ["band", "i", "j"]):
            yield linked(frame)

    keys = ["band", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def _candidates(members: DataFrame, joined: DataFrame | None, low: int, high: int) -> DataFrame:
    """member, component, band, block, blocks for band values that hold two components."""
    rows = members.select("member", F.explode(F.slice("bands", low + 1, high - low)).alias("band"))
    own = F.col("member")
    if joined is not None:
        rows = rows.join(joined.withColumnRenamed("node", "member"), "member", "left")
        own = F.coalesce("component", "member")
    rows = rows.select("member", "band", own.alias("component"))
    met = rows.groupBy("band").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.sum(F.xxhash64("member").cast("decimal(38,0)")).alias("who"),
    ).where("low != high")
    # the same members often meet in several bands: one of these is enough
    met = met.groupBy("size", "low", "high", "who").agg(F.min("band").alias("band"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return rows.join(met.select("band", blocks.alias("blocks")), "band").withColumn(
        "block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    )


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; see the module for the rules."""
    bands = sum(ROUNDS)
    signed = stored(signatures(docs, width, bands, BAND_ROWS))
    found = signed.where("key is not null and doc_id is not null")
    members = stored(
        found.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("first"))
        .select("key", F.col("first.doc_id").alias("member"), "first.bands")
    )
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("member"), "text")
    links = joined = None
    low = 0
    for count in ROUNDS:
        rows = _candidates(members, joined, low, low + count)
        by_member = rows.groupBy("member", "component").agg(F.collect_list(F.struct("band", "block", "blocks")).alias("met"))
        with_text = by_member.join(texts, "member").select("member", "component", "text", F.explode("met").alias("m"))
        with_text = with_text.select("member", "component", "text", "m.*")
        dealt = with_text.select(
            "member", "component", "text", "band", "block",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
        ).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        fresh = stored(_compared(dealt.drop("other"), width, percent))
        links = fresh if links is None else links.union(fresh)
        joined = stored(components(links))
        low += count
    classes = members.join(joined.withColumnRenamed("node", "member"), "member", "left")
    classes = classes.select("key", F.coalesce("component", "member").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)
