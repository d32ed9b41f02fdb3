"""What both exact-substring operators share: anchors, per-document places, spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, slices
from .winnow import Anchors, anchors

#: Turns joined texts into unit hashes and, for each text, where its units begin.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a 31-bit tag of the text.

    A document is known by (doc_id, tag): rows that repeat both id and text count as
    one document, rows that share only the id as two.
    """
    return docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("tag"))


def per_slice(batch: pa.RecordBatch, units: Units) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for a, z in slices(batch):
        part = batch.slice(a, z - a)
        raw, offsets = joined(part.column("text"))
        yield part, raw, *units(raw, offsets)


def tags_of(part: pa.RecordBatch) -> np.ndarray:
    return part.column("tag").to_numpy(zero_copy_only=False).astype(np.int64)


def anchor_rows(docs: DataFrame, units: Units, window: int, k: int) -> DataFrame:
    """doc_id, at (tag and place), key and neighbourhood of each anchor of ``tagged`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, values, offsets in per_slice(batch, units):
                found: Anchors = anchors(values, offsets, window, k)
                at = (tags_of(part)[found.doc] << 32) | found.place
                ids = part.column("doc_id").take(pa.array(found.doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(found.key.view(np.int64)), pa.array(found.around.view(np.int64))], ["doc_id", "at", "key", "around"])

    return docs.mapInArrow(run, "doc_id long, at long, key long, around long")


def meet(rows: DataFrame) -> DataFrame:
    """Adds what an anchor's other occurrences say.

    rank: 1 for the first of those with the same neighbourhood; repeated: that
    neighbourhood is found elsewhere too; branching: the anchor has another
    neighbourhood somewhere.  One shuffle and one sort; the window functions stream,
    and what they hold of a hot anchor spills.
    """
    same = Window.partitionBy("key", "around")
    first = same.orderBy(F.asc_nulls_first("doc_id"), "at")
    by_key = Window.partitionBy("key")
    where = F.xxhash64("doc_id", "at")
    return (
        rows.repartition("key")
        .withColumn("rank", F.rank().over(first))
        .withColumn("repeated", F.min(where).over(same) != F.max(where).over(same))
        .withColumn("branching", F.min("around").over(by_key) != F.max("around").over(by_key))
        .withColumn("n_key", F.count(F.lit(1)).over(by_key))
        .where("repeated or branching")
    )


def gathered(rows: DataFrame, value: F.Column) -> DataFrame:
    """The values of each document in a list, which is no longer than the document."""
    return rows.groupBy("doc_id", F.shiftright("at", 32).alias("tag")).agg(F.collect_list(value).alias("places"))


def with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``tagged`` documents with their lists of places."""
    right = places.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "places")
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), how).select("doc_id", "text", "tag", "places")


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
    return np.repeat(np.arange(len(column)), lens), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def place_number() -> F.Column:
    return F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in any of the ranges."""
    step = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
