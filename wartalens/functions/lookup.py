"""Lookup tables of bounded size carried inside the plan as one hashed literal.

A membership test against thousands of words would otherwise be thousands of plan nodes
(slow to analyse) or a linear array search (slow to run). Here the words are hashed into
buckets; a test hashes its argument and looks into one bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_SIZE = 2


def _slot(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _buckets(df: DataFrame, limit: int) -> tuple[list, int] | None:
    """Rows of a small table grouped by hash bucket, or None beyond ``limit`` rows."""
    rows = df.select(F.xxhash64(df.columns[0]).alias("_h"), *df.columns).take(limit + 1)
    if len(rows) > limit:
        return None
    count = max(1, len(rows) // BUCKET_SIZE)
    grouped: list[list] = [[] for _ in range(count)]
    for hashed, *cells in rows:
        grouped[hashed % count].append(cells[0] if len(cells) == 1 else {"k": cells[0], "v": cells[1]})
    return grouped, count


def inline_set(words: DataFrame, limit: int) -> Callable[[Column], Column] | None:
    """Membership test for a one-column table of at most ``limit`` rows, else None."""
    found = _buckets(words, limit)
    if found is None:
        return None
    grouped, count = found
    table = F.from_json(F.lit(json.dumps(grouped)), "array<array<string>>")
    return lambda value: F.array_contains(F.get(table, _slot(value, count)), value)


def inline_map(pairs: DataFrame, limit: int) -> Callable[[Column], Column] | None:
    """Lookup (null if absent) for a two-column table of at most ``limit`` rows, else None."""
    found = _buckets(pairs, limit)
    if found is None:
        return None
    grouped, count = found
    table = F.from_json(F.lit(json.dumps(grouped)), "array<array<struct<k:string,v:string>>>")
    return lambda value: F.get(
        F.filter(F.get(table, _slot(value, count)), lambda e: e["k"] == value), F.lit(0)
    )["v"]
