"""Packing token sequences: bounded-space online best-fit.

Documents are tokenised where they lie; only piece lengths travel. A packer keeps a fixed number
of open bins. A bitset has one bit for each amount of free space, set while an open bin has it,
so the tightest bin that still takes a piece is the lowest set bit at or above the length. When
a piece needs a new bin and all are open, the fullest bin closes. Pieces come in the order of the
table, hashed over the packers: no sorting by length, which would hold back every short piece.

Each packer gets about `packer_sequences` sequences of tokens, so their number follows the
input and their memory does not; packers share no state and can be repeated after a loss.

Defined results: the content of an added token in a text gets that token's id, as the library does
by default; a null or empty text has only its end id; repeated rows are packed as often as
they occur; an empty table gives no sequences.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave.session import stored

from .common import Memo, documents, free_names, id_in, id_out, per_worker, query

SEQUENCE_TOKENS = 4096
OPEN_BINS = 256
PACKER_SEQUENCES = 2048
CACHE_WORDS, CACHE_PIECES = 600_000, 200_000  # in the younger half of a worker's memory


class OpenBins:
    """A fixed number of open bins, found by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made, self.closed = size, most, 0, 0, 0
        self.bits, self.at = 0, [[] for _ in range(size + 1)]  # bins by free space

    def _take(self, free: int) -> int:
        held = self.at[free]
        found = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.open == self.most:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            found, free, self.made = self.made, self.size, self.made + 1
        left = free - length
        if left:
            if not self.at[left]:
                self.bits |= 1 << left
            self.at[left].append(found)
            self.open += 1
        return found, self.size - free


def best_fit(pieces: DataFrame, size: int, open_bins: int, packer_sequences: int, length: str = "length") -> DataFrame:
    """Pieces (any columns, one of them a length of 1 to `size`) with sequence_id and offset.

    The pieces must be a stored table: packers number rows and may be run again.
    """
    total = pieces.agg(F.coalesce(F.sum(length), F.lit(0))).first()[0]
    packers = max(1, -(-total // (size * packer_sequences)))
    columns = pieces.columns
    row, lane = free_names(pieces, "_row", "_packer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, bins = None, None
        for batch in batches:
            ids, offsets = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            keys, needs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (lane, length))
            for i, (p, need) in enumerate(zip(keys, needs)):
                if p != packer:
                    packer, bins = p, OpenBins(size, open_bins)
                ids[i], offsets[i] = bins.place(need)
                ids[i] += p << 32
            whole = batch.select(columns)
            names = [*columns, "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(ids), pa.array(offsets)], names=names)

    keyed = pieces.withColumn(row, F.monotonically_increasing_id())
    keyed = keyed.withColumn(lane, F.pmod(F.xxhash64(row), F.lit(packers)))
    dealt = keyed.repartition(packers, lane).sortWithinPartitions(lane, row)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # of printable ASCII without blanks


class WordIds:
    """Ids of whole texts as little-endian bytes, by a tokenizer that never joins across blanks.

    The model file must split and normalise as `word_bpe_49k.json` does. Its rules work within
    stretches free of blanks, so the ids of a text are those of its stretches. Printable ASCII is
    split here; any other stretch goes through the tokenizer's own normaliser and splitter.
    With `added`, texts that contain an added token are encoded by the tokenizer itself, which
    gives the token its own id; without, such a token is text like any other.
    """

    def __init__(self, model: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        tokens = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self._added = tokens
        self._normal, self._split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self._tokens = self.tokenizer.model.tokenize
        self._piece = Memo(lambda p: np.array([t.id for t in self._tokens(p)], "<u4").tobytes(), CACHE_PIECES)
        self._word = Memo(self._ids, CACHE_WORDS)

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii() and text.isprintable():
            pieces = PLAIN.findall(text.lower())
        else:
            pieces = [p for p, _ in self._split(self._normal(text))]
        return b"".join([self._piece[p] for p in pieces])

    def __call__(self, text: str | None) -> bytes:
        if text and any(token in text for token in self._added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self._word.__getitem__, text.encode().split())) if text else b""


def token_pieces(docs: DataFrame, model_path: str, size: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `size` tokens, whole documents unless longer: doc_id, piece, start,
    length, ids_crc32 and, if asked for, the ids."""
    model = docs.sparkSession.sparkContext.broadcast(open(model_path, encoding="utf-8").read())
    job = uuid.uuid4().hex
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = per_worker(job, lambda: WordIds(model.value, added=True)), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):  # one text at a time leaves the batch
                doc_id, ids = doc_id.as_py(), ids_of(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype("int32")) if with_ids else row)
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return id_out(docs.select(id_in(), "text").mapInArrow(run, schema))


def pack_documents(docs: DataFrame, model_path: str, size: int = SEQUENCE_TOKENS, end_id: int = 1,
                   open_bins: int = OPEN_BINS, packer_sequences: int = PACKER_SEQUENCES,
                   with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most `size` tokens; see the module for the rules."""
    pieces = stored(token_pieces(docs, model_path, size, end_id, with_ids))
    return best_fit(pieces, size, open_bins, packer_sequences)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
