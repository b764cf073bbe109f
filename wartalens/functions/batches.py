"""Row expressions that work on whole Arrow batches, where one look-up serves all repeats of a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F

SLICE_BYTES = 8 * 2**20       # text of a batch that is worked on at a time


def slicer(limit: int | None = None) -> Callable:
    """A function that cuts a batch or array into slices of about ``limit`` bytes (:data:`SLICE_BYTES`), at least one."""
    limit = SLICE_BYTES if limit is None else limit

    def cut(batch):
        rows = max(1, len(batch) // (batch.nbytes // limit + 1))
        return (batch.slice(i, rows) for i in range(0, max(1, len(batch)), rows))

    return cut


def arrow_column(prepare: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Callable:
    """Column function of one column: ``prepare`` runs once a task and gives the work on a slice of a batch.

    The functions are made inside their makers, so that they travel with the tasks.
    """
    cut = slicer()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = prepare()
        for batch in batches:
            parts = [work(part) for part in cut(batch)]
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    return F.arrow_udf(run, kind)
