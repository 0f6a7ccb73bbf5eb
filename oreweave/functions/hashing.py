"""Identity expressions: content hashes and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column, length: int = 16) -> Column:
    """Leading hex digits of the SHA-1 of the UTF-8 text."""
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, length)


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    """Stable id of parts joined by ``:``; a null part counts as an empty string."""
    columns = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return short_hash(F.concat_ws(":", *columns), length)


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_bucket(token: Column, buckets: int) -> Column:
    """Unsigned 64-bit value of the 16 hex digits modulo ``buckets``.

    The value is split in two 32-bit halves so the arithmetic stays in 64-bit integers.
    """
    digest = F.sha1(F.encode(token, "UTF-8"))
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    return ((high % buckets) * ((1 << 32) % buckets) + low) % buckets


def point_id(identifier: Column) -> Column:
    """16 hex digits read as an unsigned 64-bit number, the id form of the vector tables."""
    return F.conv(short_hash(identifier), 16, 10).cast("decimal(20,0)")


def iso_seconds(timestamp: Column | None = None) -> Column:
    value = F.current_timestamp() if timestamp is None else timestamp
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
