"""Removal of passages that an earlier document already has, by suffix arrays.

A byte goes if it lies in a string of `WINDOW` bytes that also starts in a document with a
smaller id. To bring equal windows together without moving all text, every window is keyed by
the smallest hash of the strings of `GRAM` bytes in it; a run of windows with one key is a
segment. Documents are written once in blocks. Three steps follow, each a shuffle of small rows:

1. Blocks send the keys and a digest of their distinct segments. Where a key is met, equal
   segments leave all but the smallest id, and keys with several different segments are open.
2. Blocks send the text of open segments. Where it is met, a suffix array over all of them and
   the common prefixes of its neighbours give the windows that two segments share and the
   smallest document of each.
   Of a key with more than `HOT_SEGMENTS` open segments no text is sent: blocks deal the digests
   of its single windows over all buckets, where equal ones meet.
3. Blocks take the answers and cut their documents.

A segment that a third of all documents hold is sent once by each block. Digests have 48 bits
and are only compared under one key of 32 bits within one bucket; those of single windows have 64.

Defined results: null and empty texts have no bytes; null ids count as larger than any other;
rows that repeat an id do not remove each other; shorter texts than the window stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.session import stored

from .common import documents, forget_worker, groups, id_in, id_out, mix, pack, query, text_bytes, unpack
from .suffixes import common_prefixes, suffix_array, words_at

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1  # strings of GRAM bytes in a window
MOST = 32  # windows in a segment: one bit each
SLICE = 1 << 18  # windows hashed at a time
HOT_SEGMENTS = 1 << 15  # open segments of a key whose texts are still sorted together
BLOCK_BYTES = 4 << 20  # text in a block, and text whose segments meet in one bucket


#: Timestamps in JSON keep their microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def blocks(docs: DataFrame) -> DataFrame:
    """Documents in rows of about BLOCK_BYTES of text: block, ids, sizes, data, rest.

    `rest` holds the other columns of each document as JSON. Block numbers are only fixed once
    the table is written.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]), JSON_TIMES) if others else F.lit(None).cast("string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        forget_worker()
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block():
            ids = np.array([i for i, _, _ in held], np.int64)
            sizes = np.array([len(t) for _, t, _ in held], np.int64)
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t, _ in held))
            return pd.DataFrame({"block": [number], "ids": [pack(ids)], "sizes": [pack(sizes)], "data": [data], "rest": [[r for _, _, r in held]]})

        for frame in frames:
            for doc_id, text, other in zip(frame["doc_id"], frame["text"], frame["rest"]):
                data = text.encode() if text else b""
                held.append((doc_id, data, other))
                size += len(data) + 16
                if size >= BLOCK_BYTES:
                    yield block()
                    number, held, size = number + 1, [], 0
        if held:
            yield block()

    return docs.select(id_in(), "text", rest.alias("rest")).mapInPandas(
        run, "block long, ids binary, sizes binary, data binary, rest array<string>"
    )


class Segments:
    """Windows of a block's documents as segments, and its distinct ones in a fixed order.

    For each segment: doc (place in the block), at (first window), count (of windows), of (which
    distinct one). For each distinct one: bucket, key, digest, smallest id, and a segment like it.
    """

    def __init__(self, row, buckets: int):
        import zstandard

        self.ids, self.sizes = unpack(row.ids, np.int64), unpack(row.sizes, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row.data)
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.at = self.count = self.doc = self.of = self.like = np.empty(0, np.int64)
        self.bucket = self.key = self.digest = self.first = np.empty(0, np.int64)
        n = len(self.data)
        valid = np.zeros(n + 1, bool)  # places where a window starts; those of two documents are never neighbours
        for size, end in zip(self.sizes.tolist(), self.ends.tolist()):
            if size >= WINDOW:
                valid[end - size : end - WINDOW + 1] = True
        if not valid.any():
            return
        words = words_at(self.data)
        low = np.zeros(n + 1, np.uint64)
        for begin in range(0, n - WINDOW + 1, SLICE):
            count = min(SLICE, n - WINDOW + 1 - begin)
            low[begin : begin + count] = _window_keys(words, begin, count)
        differs = valid.copy()
        differs[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        stops = ~valid
        stops[1:] &= valid[:-1]
        edges = np.flatnonzero(differs | stops)
        lengths = np.diff(np.r_[edges, n])[differs[edges]]
        edges = edges[differs[edges]]
        pieces = -(-lengths // MOST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.at = np.repeat(edges, pieces) + nth * MOST
        self.count = np.minimum(np.repeat(lengths, pieces) - nth * MOST, MOST)
        self.doc = np.searchsorted(self.ends, self.at, side="right")
        key = low[self.at]
        del low, valid, differs, stops, edges, lengths, pieces, nth
        digest = self.count.astype(np.uint64)
        for base in (self.at, self.at + self.count - 1):  # its first and last window hold all of a segment
            for step in (*range(0, WINDOW - 8, 8), WINDOW - 8):
                digest = (digest ^ words[base + step]) * np.uint64(0x9E3779B97F4A7C15)
                digest ^= digest >> np.uint64(29)
        digest = mix(digest) >> np.uint64(16)
        del words
        place = (key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | key >> np.uint64(32)
        order = np.argsort(place, kind="stable")
        p, d = place[order], digest[order]
        tied = np.flatnonzero(np.r_[p[1:] == p[:-1], False] | np.r_[False, p[1:] == p[:-1]])
        order[tied] = order[tied][np.lexsort((d[tied], p[tied]))]
        d = digest[order]
        new = np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1])]
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.bucket, self.key, self.digest = (p[new] >> np.uint64(32)).astype(np.int64), p[new] & np.uint64(0xFFFFFFFF), d[new]
        self.like = order[new]
        self.first = np.minimum.reduceat(self.ids[self.doc[order]], np.flatnonzero(new))

    def by_bucket(self, chosen: np.ndarray):
        """(bucket, distinct segments of it) for chosen distinct segments."""
        buckets, starts = np.unique(self.bucket[chosen], return_index=True)
        return zip(buckets.tolist(), np.split(chosen, starts[1:]))

    def single_windows(self, chosen: np.ndarray, buckets: int):
        """Distinct windows of chosen distinct segments by bucket (bucket, digest, smallest id), and
        for each window of each segment which distinct one, whose and the how many-th it is."""
        like = self.like[chosen]
        counts = self.count[like]
        owner = np.repeat(np.arange(len(chosen)), counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        place, words = self.at[like][owner] + step, words_at(self.data)
        digest = np.zeros(len(place), np.uint64)
        for at in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            digest = (digest ^ words[place + at]) * np.uint64(0x9E3779B97F4A7C15)
            digest ^= digest >> np.uint64(29)
        digest, doc = mix(digest), self.first[chosen][owner]
        bucket = (digest % np.uint64(buckets)).astype(np.int64) + buckets  # numbers behind those of the keys
        order = np.lexsort((doc, digest, bucket))
        d = digest[order]
        new = np.r_[True, d[1:] != d[:-1]]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return bucket[order][new], d[new], doc[order][new], of, owner, step

    def answers(self, replies, chosen: np.ndarray, dtype) -> np.ndarray:
        """Replies of all buckets, for the chosen distinct segments in order."""
        found = {r["bucket"]: r["reply"] for r in replies} if replies is not None else {}
        parts = [unpack(found[b], dtype) for b, _ in self.by_bucket(chosen)] if len(chosen) else []
        return np.concatenate(parts) if parts else np.empty(0, dtype)


def _window_keys(words: np.ndarray, begin: int, count: int) -> np.ndarray:
    """Smallest hash of the GRAM-byte strings in each of some windows."""
    stop = begin + count + SPAN - 1
    gram = words[begin:stop] * np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(32)
    gram += words[begin + 8 : stop + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    gram ^= gram >> np.uint64(29)
    gram += words[begin + GRAM - 8 : stop + GRAM - 8] * np.uint64(0x165667B19E3779F9)
    low = mix(gram)
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    return np.minimum(low[:count], low[SPAN - 16 : count + SPAN - 16])


DUPLICATE, OPEN, HOT = 1, 2, 3


def _keys(table: DataFrame, buckets: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_worker()
        for frame in frames:
            for row in frame.itertuples(index=False):
                s = Segments(row, buckets)
                rows = [
                    (b, row.block, pack(s.key[e].astype(np.uint32)), pack(s.digest[e].astype(np.uint32)),
                     pack((s.digest[e] >> np.uint64(32)).astype(np.uint16)), pack(s.first[e]))
                    for b, e in s.by_bucket(np.arange(len(s.bucket)))
                ]
                yield pd.DataFrame(rows, columns=["bucket", "block", "key", "low", "high", "doc"])

    return table.select("block", "ids", "sizes", "data").mapInPandas(
        run, "bucket long, block long, key binary, low binary, high binary, doc binary"
    )


def _met_keys(keys: DataFrame) -> DataFrame:
    """For each block and bucket, what is known of its distinct segments: 0, DUPLICATE, OPEN or HOT."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_worker()
        for frame in groups(frames, ["bucket"]):
            parts = [unpack(v, np.uint32) for v in frame["key"]]
            sizes = [len(p) for p in parts]
            key = np.concatenate(parts).astype(np.uint64)
            digest = np.concatenate([unpack(v, np.uint32) for v in frame["low"]]).astype(np.uint64)
            digest |= np.concatenate([unpack(v, np.uint16) for v in frame["high"]]).astype(np.uint64) << np.uint64(32)
            doc = np.concatenate([unpack(v, np.int64) for v in frame["doc"]])
            order = np.lexsort((doc, digest, key))
            k, d, i = key[order], digest[order], doc[order]
            new_key = np.r_[True, k[1:] != k[:-1]]
            new = new_key | np.r_[True, d[1:] != d[:-1]]
            lead = np.flatnonzero(new)
            least = i[lead][np.cumsum(new) - 1]  # smallest id with this segment
            number = np.cumsum(new_key) - 1
            several = np.bincount(number, new)[number] > 1
            most = np.maximum.reduceat(i, np.flatnonzero(new_key))[number]
            fewest = np.minimum.reduceat(i, np.flatnonzero(new_key))[number]
            state = np.where(i > least, DUPLICATE, np.where(several & (most > fewest), OPEN, 0))
            state[(state == OPEN) & (np.bincount(number, state == OPEN)[number] > HOT_SEGMENTS)] = HOT
            out = np.empty(len(order), np.uint8)
            out[order] = state
            yield pd.DataFrame({
                "block": frame["block"].to_numpy(), "bucket": frame["bucket"].to_numpy(),
                "reply": [pack(p) for p in np.split(out, np.cumsum(sizes)[:-1])],
            })

    dealt = keys.repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInPandas(run, "block long, bucket long, reply binary")


def _open_texts(answered: DataFrame, buckets: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for frame in frames:
            for row in frame.itertuples(index=False):
                s = Segments(row, buckets)
                state = s.answers(row.states, np.arange(len(s.bucket)), np.uint8)
                rows = []
                for b, e in s.by_bucket(np.flatnonzero(state == OPEN)):
                    like = s.like[e]
                    text = b"".join(s.data[a : a + c + WINDOW - 1].tobytes() for a, c in zip(s.at[like].tolist(), s.count[like].tolist()))
                    rows.append((b, row.block, pack(s.count[like].astype(np.uint8)), pack(s.first[e]), zstandard.ZstdCompressor(level=1).compress(text)))
                hot = np.flatnonzero(state == HOT)
                if len(hot):
                    bucket, digest, doc, *_ = s.single_windows(hot, buckets)
                    numbers, starts = np.unique(bucket, return_index=True)
                    parts = zip(numbers.tolist(), np.split(digest, starts[1:]), np.split(doc, starts[1:]))
                    rows += [(b, row.block, b"", pack(i), pack(d)) for b, d, i in parts]
                yield pd.DataFrame(rows, columns=["bucket", "block", "count", "doc", "text"])

    return answered.mapInPandas(run, "bucket long, block long, count binary, doc binary, text binary")


def shared_windows(counts: np.ndarray, docs: np.ndarray, text: bytes) -> np.ndarray:
    """For segments given by their numbers of windows, documents and joined text: a bit for each
    window that a segment of a smaller document has too, by a suffix array over all of them."""
    lengths = counts + WINDOW - 1
    begin = np.cumsum(lengths + 1) - lengths - 1
    data = np.full(int(lengths.sum()) + len(counts), 255, np.uint8)  # a byte that UTF-8 never has stands behind each
    inside = np.ones(len(data), bool)
    inside[begin + lengths] = False
    data[inside] = np.frombuffer(text, np.uint8)
    del inside
    segment = np.repeat(np.arange(len(counts), dtype=np.int32), lengths + 1)
    starts = np.tile(np.array([True, False]), len(counts))  # of each segment the windows, and the bytes behind them
    segment[~np.repeat(starts, np.stack([counts, np.full(len(counts), WINDOW, counts.dtype)], 1).reshape(-1))] = -1
    words = words_at(data, ">")
    order = suffix_array(data, words)
    order = order[segment[order] >= 0]
    new = np.r_[True, common_prefixes(order, words) < WINDOW]
    del words
    doc = np.unique(docs, return_inverse=True)[1].astype(np.int32)[segment[order]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))
    hit = order[doc > least[np.cumsum(new, dtype=np.int32) - 1]]
    bits = np.zeros(len(counts), np.uint32)
    np.bitwise_or.at(bits, segment[hit], np.uint32(1) << (hit - begin[segment[hit]]).astype(np.uint32))
    return bits


def _seen_before(digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same digest."""
    order = np.lexsort((doc, digest))
    d, i = digest[order], doc[order]
    new = np.r_[True, d[1:] != d[:-1]]
    out = np.empty(len(order), np.uint8)
    out[order] = i > i[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _met_texts(texts: DataFrame, buckets: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for frame in groups(frames, ["bucket"]):
            docs = np.concatenate([unpack(v, np.int64) for v in frame["doc"]])
            if frame["bucket"].iloc[0] >= buckets:
                parts = [unpack(v, np.uint64) for v in frame["text"]]
                bits = _seen_before(np.concatenate(parts), docs)
            else:
                parts = [unpack(v, np.uint8) for v in frame["count"]]
                text = b"".join(zstandard.ZstdDecompressor().decompress(t) for t in frame["text"])
                bits = shared_windows(np.concatenate(parts).astype(np.int64), docs, text)
            yield pd.DataFrame({
                "block": frame["block"].to_numpy(), "bucket": frame["bucket"].to_numpy(),
                "reply": [pack(p) for p in np.split(bits, np.cumsum([len(p) for p in parts])[:-1])],
            })

    dealt = texts.repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInPandas(run, "block long, bucket long, reply binary")


def _with_replies(table: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """A block with its buckets' replies: at most one from each bucket."""
    held = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias(name))
    return table.join(held, "block", "left")


def covered(row, buckets: int) -> tuple[Segments, np.ndarray]:
    """A block's segments, and for each byte whether it goes."""
    s = Segments(row, buckets)
    state = s.answers(row.states, np.arange(len(s.bucket)), np.uint8)
    bits = np.zeros(len(s.bucket), np.uint32)
    chosen = np.flatnonzero(state == OPEN)
    bits[chosen] = s.answers(row.windows, chosen, np.uint32)
    hot = np.flatnonzero(state == HOT)
    if len(hot):
        bucket, _, least, of, owner, step = s.single_windows(hot, buckets)
        found = {r["bucket"]: r["reply"] for r in row.windows}
        seen = np.concatenate([unpack(found[b], np.uint8) for b in np.unique(bucket).tolist()])[of] == 1
        seen |= s.first[hot][owner] > least[of]  # in this block
        np.bitwise_or.at(bits, hot[owner[seen]], np.uint32(1) << step[seen].astype(np.uint32))
    bits[state == DUPLICATE] = 0xFFFFFFFF
    mine = bits[s.of]
    mine[s.ids[s.doc] > s.first[s.of]] = 0xFFFFFFFF  # a smaller document of this block has it
    starts = np.zeros(len(s.data) + 1, np.int32)
    for step in range(MOST):
        hit = (s.count > step) & (mine >> np.uint32(step) & np.uint32(1) == 1)
        starts[s.at[hit] + step] = 1
    starts = np.cumsum(starts[:-1], dtype=np.int32)
    gone = starts > 0  # a window that goes starts at one of the last WINDOW places
    gone[WINDOW:] = starts[WINDOW:] > starts[:-WINDOW]
    return s, gone


def answered_blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """Blocks with all answers, and the number of buckets that gave them."""
    buckets = max(1, -(-text_bytes(docs) // BLOCK_BYTES))
    table = stored(blocks(docs))
    states = stored(_met_keys(_keys(table, buckets)))
    bare = table.select("block", "ids", "sizes", "data")
    windows = stored(_met_texts(_open_texts(_with_replies(bare, states, "states"), buckets), buckets))
    return _with_replies(_with_replies(table, states, "states"), windows, "windows"), buckets


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    table, buckets = answered_blocks(docs.select("doc_id", "text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_worker()
        for frame in frames:
            for row in frame.itertuples(index=False):
                s, gone = covered(row, buckets)
                rows = []
                for doc_id, size, end in zip(s.ids.tolist(), s.sizes.tolist(), s.ends.tolist()):
                    part = gone[end - size : end]
                    spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
                    kept = hashlib.sha256(s.data[end - size : end][~part].tobytes()).hexdigest()
                    rows.append((doc_id, size, int(part.sum()), spans, kept))
                yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return id_out(table.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def _left(data: np.ndarray, gone: np.ndarray) -> str:
    """What stays of a document; a character goes if all its bytes do."""
    if gone.any():
        head = np.flatnonzero((data & 0xC0) != 0x80)
        whole = np.minimum.reduceat(gone.astype(np.uint8), head).astype(bool)
        data = data[~np.repeat(whole, np.diff(head, append=len(data)))]
    return data.tobytes().decode()


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns with repeated passages cut from text; characters cut in part stay whole."""
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    table, buckets = answered_blocks(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_worker()
        for frame in frames:
            for row in frame.itertuples(index=False):
                s, gone = covered(row, buckets)
                rows = [
                    (i, _left(s.data[e - n : e], gone[e - n : e]), r)
                    for i, n, e, r in zip(s.ids.tolist(), s.sizes.tolist(), s.ends.tolist(), row.rest)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "text", "rest"])

    out = id_out(table.mapInPandas(run, "doc_id long, text string, rest string"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    if others:
        out = out.withColumn("rest", F.from_json("rest", kind, JSON_TIMES))
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir))
