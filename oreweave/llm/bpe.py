"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

The merge table is a dictionary of token bytes to ranks. A piece of text is read byte by byte.
For every prefix the last token of its encoding is known: the only token that ends there and is
compatible with the last token of the prefix before it, where two tokens are compatible if
their joined bytes encode to just these two. A state is the set of tokens begun, each with the
token before it; a transition on a byte gives the token that ends there. Tokens that all of
those begun agree on are decided and emitted: the lookahead is bounded by the longest token.
States and transitions are made when first reached and kept.

Defined results: null and empty texts encode to no ids. Bytes without a token are an error of
the vocabulary (a byte-level vocabulary has all 256).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, documents, id_in, id_out, per_worker, query

STRETCHES = 400_000  # stretches of text, and half as many pieces, in the younger half of a worker's memory
LOOKAHEAD = 1024  # bytes of a long piece between emissions
CHUNK = 65_536  # ids decoded at a time
STATES = 250_000  # states made before the transducer starts anew
CUT = re.compile(r"(?<=\S)(?=\s\S)")  # no match of a pretokeniser pattern with ` ?` spans this place


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class MergeTransducer:
    """Ids of one piece of bytes under ranked merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.right_edge = Memo(lambda token: self._edge(token, -1), len(ranks))
        self.left_edge = Memo(lambda token: self._edge(token, 0), len(ranks))
        self.compatible = Memo(self._compatible, 4 * STATES)
        self._start()

    def _start(self) -> None:
        self._ids: dict[tuple, int] = {}
        self._states: list[tuple[tuple[bytes, int], ...]] = []
        self._moves: list[dict[int, tuple[int, int]]] = []
        self._state(((b"", -1),))

    def _state(self, key: tuple) -> int:
        found = self._ids.get(key)
        if found is None:
            found = self._ids[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
        return found

    def merged(self, piece: bytes, below: int = 1 << 60) -> list[bytes]:
        """Parts after all merges of a rank under a bound: lowest rank first, the left one of equals."""
        parts, none = [piece[i : i + 1] for i in range(len(piece))], 1 << 60
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """Parts at one edge of a token while it is built: bytes, rank made, rank joined away."""
        gone, out = 1 << 60, []
        piece = self.bytes_of[token]
        while True:
            made = self.ranks[piece] if len(piece) > 1 else -1
            out.append((piece, made, gone))
            if made < 0:
                return out
            piece, gone = self.merged(piece, made)[side], made

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """No part at the right edge of the left token ever joins one at the left edge of the right."""
        for u, made_u, gone_u in self.right_edge[pair[0]]:
            for v, made_v, gone_v in self.left_edge[pair[1]]:
                if made_u < gone_v and made_v < gone_u:  # there at the same time
                    rank = self.ranks.get(u + v)
                    if rank is not None and rank < gone_u and rank <= gone_v:
                        return False
        return True

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and the token that ends at this byte."""
        last = bytes((byte,))
        grown = [(begun + last, left) for begun, left in self._states[state]]
        for begun, left in grown:  # the longest first
            token = self.ranks.get(begun)
            if token is not None and (left < 0 or self.compatible[left, token]):
                break
        else:
            raise ValueError(f"no token ends after byte {byte}")
        still = tuple(g for g in grown if g[0] in self.prefixes)
        move = self._moves[state][byte] = self._state((*still, (b"", token))), token
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if len(self._states) > STATES:
            self._start()
        state, moves, ends, done = 0, self._moves, [], []
        for byte in piece:
            state, token = moves[state].get(byte) or self._move(state, byte)
            ends.append(token)
            if len(ends) % LOOKAHEAD == 0:  # what all tokens begun agree on is decided
                chains = [self._chain(ends, len(ends) - len(begun)) for begun, _ in self._states[state]]
                same = 0
                for tokens in zip(*chains):
                    if len(set(tokens)) > 1:
                        break
                    same += 1
                done.extend(chains[0][:same])
                del ends[: sum(map(self.length.__getitem__, chains[0][:same]))]
        return (*done, *self._chain(ends, len(ends)))

    def _chain(self, ends: list[int], at: int) -> list[int]:
        """Tokens that lead to a place, from the token that ends at each place."""
        out = []
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]


class Encoder:
    """Texts to ids: stretches between single blanks are looked up, new ones go through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = MergeTransducer(ranks)
        self.pieces = regex.compile(pattern)
        self._piece = Memo(self.transducer.encode, STRETCHES // 2)
        self._stretch = Memo(self._encode, STRETCHES)

    def _encode(self, stretch: str) -> tuple[int, ...]:
        pieces = [p.encode() for p in self.pieces.findall(stretch)]
        if len(pieces) == 1:
            return self._piece[pieces[0]] if len(stretch) < 100 else self.transducer.encode(pieces[0])
        return tuple(i for p in pieces for i in (self._piece[p] if len(p) < 100 else self.transducer.encode(p)))

    def stretches(self, text: str | None) -> Iterator[tuple[int, ...]]:
        parts = CUT.split(text) if text else []
        if len(max(parts, key=len, default="")) < 100:
            return map(self._stretch.__getitem__, parts)
        return (self._stretch[p] if len(p) < 100 else self._encode(p) for p in parts)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.stretches(text)))


def _utf8_moves() -> list[list[int]]:
    """States: 0 between characters, 1 to 3 that many plain continuations due, 4 to 7 the first
    continuation of E0, ED, F0 and F4, 8 malformed."""
    moves = [[8] * 256 for _ in range(9)]
    ranges = [(0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE1, 0xEF, 2), (0, 0xF1, 0xF3, 3), (1, 0x80, 0xBF, 0),
              (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2),
              (7, 0x80, 0x8F, 2)]
    for state, low, high, to in ranges:
        moves[state][low : high + 1] = [to] * (high - low + 1)
    for byte, to in ((0xE0, 4), (0xED, 5), (0xF0, 6), (0xF4, 7)):
        moves[0][byte] = to
    return moves


UTF8 = _utf8_moves()


class StreamDecoder:
    """Ids to bytes in chunks that end between characters; an open character waits for its rest.

    Malformed bytes, which ids of another text may hold, are passed on as they are.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self._get, self._open = bytes_of.__getitem__, b""

    def feed(self, ids: Iterable[int]) -> bytes:
        data = self._open + b"".join(map(self._get, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):  # the last lead byte, if its character may be open
            if data[-back] >= 0xC0:
                state = 0
                for byte in data[-back:]:
                    state = UTF8[state][byte]
                if state not in (0, 8):
                    cut -= back
                break
            if data[-back] < 0x80:
                break
        self._open = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        rest, self._open = self._open, b""
        return rest


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Every row with a column of ids (empty for null texts). A column of that name is replaced."""
    data, job = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read()), uuid.uuid4().hex

    def batches(series):
        encoder = per_worker(job, lambda: Encoder(load_ranks(data.value), pattern))
        for texts in series:
            yield texts.map(encoder.encode)

    return docs.withColumn(into, _over_texts(batches, "array<int>")(F.col(text)))


def decode(rows: DataFrame, ranks_path: str, ids: str = "ids", into: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Every row with the text of its ids; null ids give null, malformed bytes become U+FFFD."""
    data = rows.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read())

    def text_of(bytes_of, values):
        if values is None:
            return None
        decoder = StreamDecoder(bytes_of)
        parts = [decoder.feed(values[i : i + chunk]) for i in range(0, len(values), chunk)] + [decoder.close()]
        return "".join(p.decode("utf-8", "replace") for p in parts)

    def batches(series):
        bytes_of = {i: t for t, i in load_ranks(data.value).items()}
        for lists in series:
            yield lists.map(lambda v: text_of(bytes_of, v))

    return rows.withColumn(into, _over_texts(batches, "string")(F.col(ids)))


def _over_texts(batches, kind: str):

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from batches(series)

    return F.pandas_udf(run, kind)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to, without moving the ids."""
    data, job = docs.sparkSession.sparkContext.broadcast(open(ranks_path, "rb").read()), uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = per_worker(job, lambda: Encoder(load_ranks(data.value), pattern))
        bytes_of = encoder.transducer.bytes_of
        name = {i: str(i) for i in bytes_of}.__getitem__
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                digest, decoded, decoder, count = hashlib.sha256(), hashlib.sha256(), StreamDecoder(bytes_of), 0
                ids, lead = chain.from_iterable(encoder.stretches(text)), ""
                while part := list(islice(ids, CHUNK)):
                    digest.update((lead + " ".join(map(name, part))).encode())
                    decoded.update(decoder.feed(part))
                    count, lead = count + len(part), " "
                decoded.update(decoder.close())
                rows.append((doc_id, count, digest.hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(id_in(), "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return id_out(rows)


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
