"""Keep-first, keep-last and top-n rules.

All of them are ``row_number`` filters: Spark keeps only the needed rows of each group
before the shuffle (window group limit), so a group holding a large share of all rows
sends a handful of rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every group in the given total order."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, keys, order, 1)


def keep_first_ci(df: DataFrame, text: str, order: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """First spelling of every text, compared trimmed and case-insensitively; blanks are dropped."""
    clean = df.withColumn(text, F.trim(F.col(text))).where(F.col(text) != "")
    return keep_first(clean, [*keys, F.lower(F.col(text))], order)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last write per key over the union of both sides; ``order`` lists the newest first."""
    return keep_first(current.unionByName(changes), list(keys), order)


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``seen`` (resume rule). No distinct is needed on the seen side."""
    return df.join(seen.select(*keys), list(keys), "left_anti")


def overfetch_top_k(
    df: DataFrame, score: str, tie: Sequence[str], k: int, accept: Column, factor: int = 8
) -> DataFrame:
    """Take ``factor * k`` rows by score, then filter, then keep ``k``.

    The inner limit is part of the rule: rows beyond it never compete for a slot.
    """
    order = [F.desc(score), *[F.asc(t) for t in tie]]
    pool = df.orderBy(*order).limit(max(factor * k, k))
    return pool.where((F.col(score) > 0) & accept).orderBy(*order).limit(k)
