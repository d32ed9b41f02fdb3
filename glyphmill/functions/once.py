"""Values that an expression uses often and computes once, and running sums, which take one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .lattice import ranges


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda refers to by its expression is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Entries of lists that are summed at once.
ENTRIES = 1 << 20


@F.arrow_udf(ArrayType(LongType()))
def running(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """[0] and the running sums of each list; of a null, [0].  Built-in aggregates would copy the list for each element."""
    for lists in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
        for a, z in ranges(sizes, ENTRIES):
            yield sums_of(lists.slice(a, z - a))


def sums_of(lengths: pa.ListArray) -> pa.ListArray:
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lengths), 0), dtype=np.int64)
    flat = np.asarray(pa.compute.fill_null(lengths.flatten(), 0), dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([[0], np.cumsum(flat)])
    row = np.repeat(np.arange(len(sizes)), sizes + 1)
    at = np.arange(len(row)) - row  # one entry more in each list
    offsets = begin + np.arange(len(begin))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sums[at] - sums[begin[:-1]][row]))
