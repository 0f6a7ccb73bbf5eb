"""Language of texts: multinomial naive Bayes over hashed character n-grams.

A text becomes small letters (letters and marks of any script), every run of anything else one
blank, with a blank at both ends. Its features are the n-grams of 1 to `ORDER` characters, hashed
into `BUCKETS`. Learning counts the buckets of each language over all learned texts: a task adds
up its texts before anything travels, so a language that holds most rows is no hot key. The
matrix of log probabilities has one row per bucket and one column per language; its size does
not grow with the input and is checked before it is broadcast. Scoring gathers the matrix rows
of a batch's n-grams and adds them up by text, slice by slice, so long texts need little memory.

Defined results: null texts and texts without a letter are `und` with score 0, as is every text
when nothing was learned; they teach nothing. Ties go to the language first in order of its
name; the score is the posterior of the predicted language; a repeated row gets the same one
each time. More than `LANGUAGES` languages are an error.
"""

from __future__ import annotations

import sys
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, pack, per_worker, query, unpack

BUCKETS = 1 << 16
ORDER = 4
SMOOTH = 0.1  # added to every count
PART = 1 << 12  # buckets of one language in a row while counts are summed
SLICE = 1 << 18  # characters looked at together
CELLS = 1 << 22  # matrix cells gathered together
LANGUAGES = 1024  # the matrix then has 256 MB
HELD = 64  # languages a task counts before it passes counts on
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For each code point its small form, negative if a mark, a blank if neither letter nor mark."""
    table = np.full(sys.maxunicode + 1, 32, np.int32)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LM":
            table[code] = ord(chr(code).lower()[0]) if kind == "L" else -code
    return table


def letters(table: np.ndarray, text: str | None) -> np.ndarray | None:
    """Characters of the cleaned text, or None if it has no letter."""
    if not text:
        return None
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    if not (codes > 32).any():
        return None
    codes = np.concatenate([[32], np.abs(codes), [32]])
    blank = codes == 32
    return codes[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]


def grams(codes: np.ndarray, starts: int) -> np.ndarray:
    """Buckets of the n-grams of 1 to ORDER characters that begin in the first `starts` places."""
    out, code = [], np.zeros(len(codes), np.uint64)
    for n in range(1, min(ORDER, len(codes)) + 1):
        code = code[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :].astype(np.uint64) + np.uint64(n)
        own = code[:starts]
        mixed = (own ^ (own >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(48)).astype(np.int32) % BUCKETS)
    return np.concatenate(out)


def batches(table: np.ndarray, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of several texts, or of slices of a long one, with the row each stretch belongs to."""
    found, rows, size = [], [], 0
    for row, text in enumerate(texts):
        codes = letters(table, text)
        if codes is None:
            continue
        for at in range(0, len(codes), SLICE):
            found.append(grams(codes[at : at + SLICE + ORDER - 1], SLICE))
            rows.append(row)
            size += len(found[-1])
            if size >= SLICE:
                yield found, np.array(rows)
                found, rows, size = [], [], 0
    if found:
        yield found, np.array(rows)


class Model:
    """Log probabilities of buckets by language, and of the languages themselves."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray):
        """counts: one row per language over the buckets; texts: learned texts of each."""
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS
        self.matrix = np.ascontiguousarray(np.log((counts + SMOOTH) / total).T.astype(np.float32))
        self.prior = np.log(texts / max(texts.sum(), 1))

    def __call__(self, table: np.ndarray, texts) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text."""
        texts = list(texts)
        width = len(self.languages)
        total, known = np.zeros((len(texts), width)), np.zeros(len(texts), bool)
        if width:
            step = max(CELLS // width, 1)
            for found, rows in batches(table, texts):
                known[rows] = True
                ends = np.cumsum([len(f) for f in found])
                flat = np.concatenate(found)
                for at in range(0, len(flat), step):
                    part = flat[at : at + step]
                    first = int(np.searchsorted(ends, at, "right"))
                    last = int(np.searchsorted(ends, at + len(part), "left"))
                    cuts = np.concatenate([[0], ends[first:last] - at]).astype(np.int64)
                    sums = np.add.reduceat(self.matrix[part], cuts, axis=0, dtype=np.float64)
                    np.add.at(total, rows[first : last + 1], sums)
            total += self.prior
            total -= total.max(axis=1, keepdims=True)
            best = total.argmax(axis=1)  # the first of equals
            score = 1 / np.exp(total).sum(axis=1)
        else:
            best = score = np.zeros(len(texts), np.int64)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return names, np.where(known, score, 0.0).astype(np.float64)


def learn(texts: DataFrame) -> Model:
    """Model of a table of (lang, text), all rows of it; null languages teach nothing."""
    job = uuid.uuid4().hex

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = per_worker(job, letter_table)
        held: dict[str, list] = {}

        def passed_on() -> Iterator[pd.DataFrame]:
            for lang, (counts, taught) in held.items():
                parts = counts.reshape(-1, PART)
                yield pd.DataFrame({
                    "lang": lang, "part": np.arange(len(parts), dtype=np.int32), "counts": [pack(p) for p in parts],
                    "texts": np.array([taught, *[0] * (len(parts) - 1)], np.int64),
                })
            held.clear()

        for frame in frames:
            for lang, part in frame.groupby("lang", sort=False):
                if lang not in held and len(held) >= HELD:
                    yield from passed_on()
                own = held.setdefault(lang, [np.zeros(BUCKETS, np.int64), 0])
                seen = -1
                for found, rows in batches(table, part["text"]):
                    own[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                    own[1] += len(np.unique(rows)) - (rows[0] == seen)
                    seen = rows[-1]
        yield from passed_on()

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for frame in frames:
            for lang, part, data, taught in zip(frame["lang"], frame["part"].tolist(), frame["counts"], frame["texts"].tolist()):
                own = sums.setdefault((lang, part), [0, 0])
                own[0] = own[0] + unpack(data, np.int64)
                own[1] += taught
        for (lang, part), (counts, taught) in sums.items():
            yield pd.DataFrame({"lang": [lang], "part": [part], "counts": [pack(counts)], "texts": [taught]})

    schema = "lang string, part int, counts binary, texts long"
    usable = texts.where("lang is not null and text is not null").select("lang", "text")
    named = usable.select("lang").distinct().limit(LANGUAGES + 1).count()
    if named > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: raise LANGUAGES and the memory of executors")
    rows = usable.mapInPandas(count, schema).repartition("lang", "part").mapInPandas(add_up, schema).collect()
    taught: dict[str, int] = {}
    for r in rows:
        taught[r.lang] = taught.get(r.lang, 0) + r.texts
    names = sorted(lang for lang, n in taught.items() if n)
    place = {lang: i for i, lang in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS), np.int64)
    for r in rows:
        if r.lang in place:
            counts[place[r.lang], r.part * PART : (r.part + 1) * PART] = unpack(r.counts, np.int64)
    return Model(names, counts, np.array([taught[lang] for lang in names], np.float64))


def predict(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Every row with a column `into` of (lang, score). A column of that name is replaced."""
    shared, job = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = per_worker(job, letter_table)
        for texts in series:
            names, scores = shared.value(table, texts)
            yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": scores})

    return docs.withColumn(into, F.pandas_udf(run, "lang string, score double")(F.col(text)))


@query("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(docs.where(fold("doc_id", 5) != 0).select("lang", "text"))
    found = predict(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
