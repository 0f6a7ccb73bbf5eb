"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL twin where SQL can say it."""

    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


NO_ID = 2**63 - 1  # stands for a null id inside Python, where null numbers would turn to floats


def id_in(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def id_out(rows: DataFrame, column: str = "doc_id") -> DataFrame:
    return rows.withColumn(column, F.when(F.col(column) != NO_ID, F.col(column)))


def fold(column: Column | str, modulus: int) -> Column:
    """Remainder of crc32 over the decimal text of an id; null ids fall in fold 0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


class Memo(dict):
    """Results of a function, for at most twice `most` keys: when full, the older half goes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def per_worker(key: str, make):
    """An object that a Python worker keeps for its later tasks of the same job."""
    held = vars(sys.modules.setdefault("_oreweave_worker", types.ModuleType("_oreweave_worker")))
    if held.get("key") != key:
        held.update(key=key, value=make())
    return held["value"]


def forget_worker() -> None:
    """Let go of what an earlier job left in this Python worker."""
    sys.modules.pop("_oreweave_worker", None)


def groups(frames, keys: list[str]):
    """Runs of rows with equal keys from the batches of a sorted partition, one at a time."""
    import pandas as pd

    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        differ = np.zeros(max(len(frame) - 1, 0), bool)
        for key in keys:
            values = frame[key].to_numpy()
            differ |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(differ) + 1).tolist()]
        for low, high in zip(cuts, cuts[1:]):
            yield frame.iloc[low:high]
        rest = frame.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield rest


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an unsigned array: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(array: np.ndarray) -> bytes:
    """An integer array as compressed byte planes; sorted or small values shrink most."""
    import zstandard

    width = array.dtype.itemsize
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of text in a table: the figure that sizes blocks and buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
