"""Arrow functions that are made where they are used: a module that holds them can be imported without a session."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a function makes before it hands that on: rows, and bytes or characters of what they come from.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def slices(batch: Iterable) -> Iterator[list]:
    """A batch's values in short runs, one at least. Spark's batches hold 10,000 rows of any length; what is made of them
    is to be held for a few rows at a time."""
    run, size, some = [], 0, False
    for value in batch:
        run.append(value)
        size += len(value) if isinstance(value, str | bytes | bytearray) else 0
        if len(run) == SLICE_ROWS or size >= SLICE_BYTES:
            yield run
            run, size, some = [], 0, True
    if run or not some:
        yield run


def arrow_function(kind: str):
    """A pandas UDF with the return type `kind`, from a function of batches with type hints."""

    def of(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return of
