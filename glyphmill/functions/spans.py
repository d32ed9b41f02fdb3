"""Spans around an anchor segment, and offsets of readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .once import let, running
from .profile import TARGET

DIRECTIONS = ("backward", "forward", "bidirectional")


def targets_before(labels: Column, texts: Column) -> Column:
    """Exclusive prefix sums of the lengths of target segments, one more than segments."""
    return running(F.zip_with(labels, texts, lambda l, t: F.when(l == TARGET, F.length(t)).otherwise(0)).cast("array<bigint>")).cast("array<int>")


def select_span(labels: Column, k: Column, direction: str) -> Column:
    """struct(sel, end) of the run of target segments at the k-th one (from 1).

    backward goes right from the anchor, forward goes left and ends with it, bidirectional both.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction: {direction}")
    at = F.filter(F.transform(labels, lambda l, i: F.when(l == TARGET, i)), lambda x: x.isNotNull())
    anchor = F.get(at, k - 1)
    n = F.size(labels)
    others = F.filter(F.transform(labels, lambda l, i: F.when(l != TARGET, i)), lambda x: x.isNotNull())

    def span(anchor: Column) -> Column:
        right = F.coalesce(F.array_min(F.filter(others, lambda i: i > anchor)), n)
        left = F.coalesce(F.array_max(F.filter(others, lambda i: i < anchor)) + 1, F.lit(0))
        sel = anchor if direction == "backward" else left
        end = anchor + 1 if direction == "forward" else right
        return F.struct(sel.cast("int").alias("sel"), end.cast("int").alias("end"))

    return let(anchor, span)
