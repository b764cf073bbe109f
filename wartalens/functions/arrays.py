"""In-row array helpers. All are native expressions, linear in the array length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wartalens.functions.batches import arrow_column


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it inside nested lambdas.

    Without the binding the optimizer may inline the expression into a lambda and
    evaluate it once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def adjacent_pairs(tokens: Column | str, delimiter: str = " ") -> Column:
    """``[a, b, c]`` -> ``["a b", "b c"]``."""
    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(
            F.slice(t, F.lit(1), n),
            F.slice(t, F.lit(2), n),
            lambda left, right: F.concat(left, F.lit(delimiter), right),
        )

    return let(as_column(tokens), pairs)


def merge_marked(tokens: Column | str, marks: Column, delimiter: str = "_") -> Column:
    """Join token ``i`` with its successor where ``marks`` holds ``1``, left to right, no overlap.

    ``marks`` is a string with one character per token, the last one always ``0``.
    Rewriting every ``1x`` of it to ``HT`` is exactly the left-to-right choice (a head
    swallows its tail), so no sequential state is needed.
    """
    def merged(t: Column) -> Column:
        roles = F.split(F.regexp_replace(marks, "1.", "HT"), "")
        following = F.slice(t, F.lit(2), F.greatest(F.size(t), F.lit(1)))
        cells = F.zip_with(
            F.arrays_zip(t.alias("this"), following.alias("next")),
            roles,
            lambda cell, role: F.when(role == "H", F.concat(cell["this"], F.lit(delimiter), cell["next"]))
            .when(role == "0", cell["this"]),
        )
        return F.when(F.size(t) < 2, t).otherwise(F.filter(cells, lambda cell: cell.isNotNull()))

    return let(as_column(tokens), merged)


def merge_pairs(
    tokens: Column | str, is_phrase: Callable[[Column], Column], separator: str = " ", delimiter: str = "_"
) -> Column:
    """Join adjacent tokens whose pair (``left separator right``) passes ``is_phrase``."""
    def merged(t: Column) -> Column:
        marks = F.transform(adjacent_pairs(t, separator), lambda p: F.when(is_phrase(p), "1").otherwise("0"))
        return merge_marked(t, F.concat(F.array_join(marks, ""), F.lit("0")), delimiter)

    return let(as_column(tokens), merged)


def marks_at(positions: Column | str, length: Column) -> Column:
    """Mark string of ``length`` characters with ``1`` at the given zero-based positions."""
    def build(p: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))))
        cells = F.zip_with(p, before, lambda here, prev: F.concat(F.repeat(F.lit("0"), here - prev - 1), F.lit("1")))
        return F.rpad(F.array_join(cells, ""), length, "0")

    none = F.array().cast("array<int>")
    return let(F.sort_array(F.coalesce(as_column(positions), none)), build)


def run_counter() -> Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """A function from lists of terms to ``(sorted distinct terms, row, term number, count)``, by row and term.

    Distinct terms of a slice of rows are numbered in their order, so that counting sorts numbers only. Rows
    with the same number in ``groups`` are counted as one row of that number.
    """
    def count(lists: pa.Array, groups: np.ndarray | None = None):
        coded = lists.flatten().dictionary_encode(null_encoding="encode")
        order = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        rows = np.repeat(np.arange(len(lists)) if groups is None else groups, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        terms = max(1, len(order))
        cells, counts = np.unique(rows * terms + rank[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        return coded.dictionary.take(order), cells // terms, cells % terms, counts

    return count


def run_lengths(values: Column | str) -> Column:
    """Counts of equal values: array of ``struct(term, tf)``, sorted by term."""
    count = run_counter()

    def prepare():
        def work(lists: pa.Array) -> pa.Array:
            terms, rows, numbers, counts = count(lists)
            offsets = np.searchsorted(rows, np.arange(len(lists) + 1))
            found = pa.StructArray.from_arrays([terms.take(pa.array(numbers)), pa.array(counts, pa.int64())], ["term", "tf"])
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)

        return work

    return arrow_column(prepare, "array<struct<term:string,tf:bigint>>")(as_column(values))


def explode_rows(df: DataFrame, keys: list, array: Column, name: str, position: str | None = None) -> DataFrame:
    """Explode a computed array without computing it twice.

    A plain ``explode`` makes the optimizer add a "not empty" filter that evaluates the
    array expression once more; the outer form does not, and its null rows are dropped
    after the explosion.
    """
    if position is None:
        rows = df.select(*keys, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keys, F.posexplode_outer(array).alias(position, name))
    return rows.filter(F.col(name).isNotNull())
