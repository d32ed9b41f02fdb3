"""Substring deduplication on the graph of token k-mers.

Each window of ``window`` words is an edge of a de Bruijn graph.  Edges are not shuffled
one by one.  Every edge is stood for by its anchor, a content-chosen ``k``-mer (a sparse
de Bruijn graph in minimizer space), and an anchor whose occurrences all lie in the same
neighbourhood is a nonbranching stretch: it is compacted and decided as a whole, by its
earliest source coordinate.  Only at branching anchors are the single edges compared, again by
their source coordinates, which Spark joins back to the documents as spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, save, word_hashes, words_of
from .substring import anchor_rows, covered, gathered, lists, meet, per_slice, place_number, runs, tagged, tags_of, with_places
from .winnow import anchors


def word_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words_of(raw, offsets)
    return word_hashes(raw, start, end), first


def debruijn_dedup(docs: DataFrame, window: int = 20, k: int = 6) -> DataFrame:
    """Remove words covered by a window whose words also start earlier in the corpus.

    Earlier is a smaller doc_id (null first) or an earlier place in the same document;
    the first occurrence stays.  Returns doc_id, text (kept words joined by one space),
    n_words, n_removed, spans (removed word ranges, end exclusive), one row for each row of
    ``docs``.  Null text has no words; texts shorter than a window lose nothing; rows that
    repeat both id and text count as one document; other columns are ignored.
    """
    docs = tagged(docs)
    marks = save(meet(anchor_rows(docs, word_units, window, k)).select("doc_id", "at", "rank", "branching"))
    edges = single_edges(with_places(docs, gathered(marks.where("branching and rank = 1"), place_number()), "inner"), window, k)
    later = Window.partitionBy("edge", "key").orderBy(F.asc_nulls_first("doc_id"), "at")
    again = save(edges.repartition("edge").withColumn("rank", F.rank().over(later)).where("rank > 1").select("doc_id", "at"))
    spans = marks.where("rank > 1").select("doc_id", "at", (place_number() * 2).alias("value")).unionByName(again.select("doc_id", "at", (place_number() * 2 + 1).alias("value")))
    return without(with_places(docs, gathered(spans, F.col("value")), "left"), window, k)


def single_edges(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Every window that chose one of the document's places as its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, values, offsets in per_slice(batch, word_units):
                row, place = lists(part.column("places"))
                wanted = np.zeros(len(values) + 1, dtype=bool)
                wanted[offsets[row] + place] = True
                chosen = anchors(values, offsets, window, k).chosen
                start = np.flatnonzero((chosen >= 0) & wanted[chosen])
                doc = np.searchsorted(offsets, start, side="right") - 1
                rolling = Rolling(values)
                at = (tags_of(part)[doc] << 32) | (start - offsets[doc])
                edge, key = rolling.ranges(start, start + window), rolling.ranges(chosen[start], chosen[start] + k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(at), pa.array(edge.view(np.int64)), pa.array(key.view(np.int64))], ["doc_id", "at", "edge", "key"])

    return docs.mapInArrow(run, "doc_id long, at long, edge long, key long")


def without(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Texts without the words of their places (even: 2 x an anchor; odd: 2 x a window start + 1)."""
    reach = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, values, offsets in per_slice(batch, word_units):
                row, value = lists(part.column("places"))
                at, lone = offsets[row] + (value >> 1), (value & 1) == 1
                start = np.where(lone, at, np.maximum(at - reach, offsets[row]))
                end = np.where(lone, at + window, np.minimum(at + reach + k, offsets[row + 1]))
                gone = covered(len(values), start, end)
                kept, removed, spans = [], np.add.reduceat(np.append(gone, False), offsets[:-1], dtype=np.int64), []
                removed[np.diff(offsets) == 0] = 0
                for i, text in enumerate(part.column("text").to_pylist()):
                    words = (text or "").encode().split()
                    if removed[i]:
                        mask = gone[offsets[i] : offsets[i + 1]]
                        words = compress(words, (~mask).tolist())
                        spans.append([{"start": a, "end": z} for a, z in zip(*map(np.ndarray.tolist, runs(mask)), strict=True)])
                    else:
                        spans.append([])
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "text", "n_words", "n_removed", "spans"],
                )

    return docs.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>")
