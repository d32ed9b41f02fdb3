"""Substring deduplication with suffix arrays made by two-stage sorting.

A suffix array of the whole corpus would sort every byte.  Strings of ``length`` bytes that occur
twice share their anchor, so suffixes are sorted only where an anchor occurs in several
neighbourhoods; where it has one neighbourhood found twice, all of that is repeated.

``two_stage`` sorts the suffixes of a block: those smaller than their successor directly, all
others induced from these by one scan over the buckets of first bytes; then common prefixes of
neighbours are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Rolling, save
from .substring import anchor_rows, covered, gathered, lists, meet, per_slice, place_number, runs, tagged, tags_of, with_places
from .winnow import anchors

#: Bytes of neighbourhoods that are sorted together.
BLOCK_BYTES = 4 << 20
#: An anchor with more neighbourhoods is dealt out by its windows' place and hash.
HOT = 40_000


def byte_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_VALUES[raw], offsets


def words8(text: np.ndarray, room: int) -> np.ndarray:
    """The eight bytes at each place as one big-endian number, zeros after the end."""
    padded = np.concatenate([text, np.zeros(room + 8, dtype=np.uint8)])
    n = len(text) + room
    out = np.zeros(n, dtype=np.uint64)
    for j in range(8):
        out |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


def direct_sort(at: np.ndarray, eight: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of their first ``length`` bytes: eight at a time, and only where still tied."""
    at = at[np.argsort(eight[at], kind="stable")]
    key = eight[at]
    tied = np.zeros(len(at), dtype=bool)
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.zeros(0, np.int64)
    for depth in range(8, length, 8):
        same = group[1:] == group[:-1]
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key, g = eight[at[where] + depth], group[where]
        order = np.lexsort((key, g))
        at[where] = at[where][order]
        key = key[order]
        new = np.zeros(len(at), dtype=np.int64)
        new[where[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group * 1 + np.cumsum(new)
    return at


def two_stage(text: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the wanted suffixes (each followed somewhere by a zero byte) and the common prefix of each with the one before, ``length`` at most.

    Suffixes that agree in ``length`` bytes stand together.
    """
    n = len(text)
    eight = words8(text, length + 8)
    after = np.append(text[1:], np.uint8(0))
    step = np.where(text < after, 1, np.where(text > after, -1, 0)).astype(np.int8)
    step[-1] = 1
    step[text == 0] = 1  # ends of regions: the least of all
    index = np.where(step != 0, np.arange(n), n - 1)
    smaller = step[np.minimum.accumulate(index[::-1])[::-1]] > 0
    # a suffix larger than its successor is induced from it, so that one takes part too, up to the next smaller one
    next_small = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    at = np.flatnonzero(wanted)
    taking = covered(n, at, next_small[at] + 1)
    direct = direct_sort(np.flatnonzero(taking & smaller), eight, length)
    induced = taking & ~smaller
    first = text[direct].astype(np.int64)
    edges = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """Give the predecessors of what was found to their buckets; return those of this bucket."""
        before = found - 1
        before = before[before >= 0]
        before = before[induced[before]]
        if not len(before):
            return before
        letters = text[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.diff(letters)) + 1
        own = before[:0]
        for part in np.split(before, cuts):
            if (d := int(text[part[0]])) == c:
                own = part
            else:
                waiting[d].append(part)
        return own

    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(found):
            out.append(found)
            found = induce(found, c)
        if edges[c + 1] > edges[c]:
            out.append(direct[edges[c] : edges[c + 1]])
            induce(out[-1], c)
    order = np.concatenate(out) if out else direct
    order = order[wanted[order]]
    return order, common_prefixes(order, eight, length)


def common_prefixes(order: np.ndarray, eight: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before, up to ``length``."""
    common = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(1, len(order))
    for depth in range(0, length, 8):
        differ = eight[order[open_] + depth] ^ eight[order[open_ - 1] + depth]
        equal = differ == 0
        ended = differ[~equal]
        # leading zero bytes: the number of times the difference fits below a power of 256
        zeros = sum((ended < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8)) if len(ended) else ended.astype(np.int64)
        common[open_[~equal]] = depth + zeros
        common[open_[equal]] = depth + 8
        open_ = open_[equal]
    return np.minimum(common, length)


def suffix_dedup(docs: DataFrame, length: int = 200, k: int = 32) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Overlaps count, all occurrences go, matches never cross documents.  Returns doc_id,
    content (remaining bytes, binary, as cuts may split characters), n_bytes, n_removed, spans (removed byte
    ranges), one row for each row of ``docs``.  Null text is empty; rows that repeat both id
    and text count as one document; other columns are ignored.
    """
    docs = tagged(docs)
    marks = save(meet(anchor_rows(docs, byte_units, length, k)).select("doc_id", "at", "rank", "repeated", "branching", "n_key"))
    # of a neighbourhood found twice, one occurrence stands for all
    wanted = marks.where("branching and rank = 1").select("doc_id", "at", (place_number() * 2 + (F.col("n_key") > HOT).cast("long")).alias("value"))
    found = save(sorted_regions(regions(with_places(docs, gathered(wanted, F.col("value")), "inner"), length, k), length))
    spans = marks.where("repeated").select("doc_id", "at", F.struct(place_number().alias("start"), F.lit(-1).cast("long").alias("n")).alias("value"))
    spans = spans.unionByName(found.select("doc_id", "at", F.struct(place_number().alias("start"), "n").alias("value")))
    return without(with_places(docs, gathered(spans, F.col("value")), "left"), length, k)


def regions(docs: DataFrame, length: int, k: int) -> DataFrame:
    """For each wanted anchor the bytes of all windows that chose it.

    A hot anchor (odd value) gives one row for each window instead, dealt by its place and hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, values, offsets in per_slice(batch, byte_units):
                row, value = lists(part.column("places"))
                anchor = offsets[row] + (value >> 1)
                order = np.argsort(anchor, kind="stable")
                row, anchor, hot = row[order], anchor[order], (value[order] & 1) == 1
                chosen = anchors(values, offsets, length, k).chosen
                start = np.flatnonzero(chosen >= 0)
                low, high = np.searchsorted(chosen[start], anchor, "left"), np.searchsorted(chosen[start], anchor, "right")
                some = high > low
                row, anchor, hot, low, high = row[some], anchor[some], hot[some], low[some], high[some]
                rolling = Rolling(values)
                bucket = rolling.ranges(anchor, anchor + k)
                begin, n = start[low], high - low
                if hot.any():
                    each = np.repeat(np.arange(len(row)), np.where(hot, n, 1))
                    step = np.arange(len(each)) - np.concatenate([[0], np.cumsum(np.where(hot, n, 1))])[:-1][each]
                    row, hot, begin, n, bucket = row[each], hot[each], begin[each] + step, np.where(hot[each], 1, n[each]), bucket[each]
                    bucket = np.where(hot, rolling.ranges(begin, begin + length), bucket)
                tail = np.minimum(begin + n + length + 8, offsets[row + 1])
                body = raw.tobytes()
                data = [body[a:z] for a, z in zip(begin.tolist(), tail.tolist(), strict=True)]
                at = (tags_of(part)[row] << 32) | (begin - offsets[row])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), part.column("doc_id").take(pa.array(row)), pa.array(at), pa.array(n), pa.array(data, pa.binary())], ["bucket", "doc_id", "at", "n", "data"])

    return docs.mapInArrow(run, "bucket long, doc_id long, at long, n long, data binary")


def sorted_regions(rows: DataFrame, length: int) -> DataFrame:
    """Runs of window starts whose string is found twice: doc_id, at, n (length of what they cover)."""

    def solve(block: pa.Table) -> pa.RecordBatch:
        data = block.column("data").to_pylist()
        n = block.column("n").to_numpy()
        lens = np.array([len(x) + 1 for x in data])
        text = np.frombuffer(b"\0".join(data) + b"\0", dtype=np.uint8)
        # a zero byte of a text counts as the least letter and must not end a region, so all bytes but the ends move up; 255 is no byte of UTF-8
        ends = np.cumsum(lens) - 1
        text = text + 1
        text[ends] = 0
        begins = np.concatenate([[0], ends[:-1] + 1])
        wanted = covered(len(text), begins, begins + n)
        order, common = two_stage(text, wanted, length)
        region = np.searchsorted(ends, order)
        at = block.column("at").to_numpy()[region] + order - begins[region]
        ids = block.column("doc_id").combine_chunks().take(pa.array(region))
        owner = np.asarray(pa.compute.fill_null(ids, -(1 << 63)))
        pair = (common[1:] >= length) & ((at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))
        twice = np.zeros(len(order), dtype=bool)
        # within a run of equal strings, another place somewhere makes all of them repeated
        same = np.concatenate([[False], common[1:] >= length])
        group = np.cumsum(~same) - 1
        many = np.bincount(group[1:][pair], minlength=len(group) + 1) > 0
        twice = many[group] if len(group) else twice
        mask = np.zeros(len(text), dtype=bool)
        mask[order[twice]] = True
        a, z = runs(mask)
        region = np.searchsorted(ends, a)
        return pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks().take(pa.array(region)), pa.array(block.column("at").to_numpy()[region] + a - begins[region]), pa.array(z - a + length - 1)], ["doc_id", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column("data").nbytes
            if size < BLOCK_BYTES:
                continue
            block = pa.Table.from_batches(held)
            keys = block.column("bucket").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on
            if cut:
                yield solve(block.slice(0, cut))
                held = block.slice(cut).combine_chunks().to_batches()
                size = sum(b.column("data").nbytes for b in held)
        if held and sum(map(len, held)):
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, at long, n long")


def without(docs: DataFrame, length: int, k: int) -> DataFrame:
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, _, offsets in per_slice(batch, lambda raw, offsets: (raw, offsets)):
                column = part.column("places")
                lens = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
                row, flat = np.repeat(np.arange(len(column)), lens), column.flatten()
                at, n = offsets[row] + flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                around = n < 0
                gone = covered(len(raw), np.where(around, np.maximum(at - reach, offsets[row]), at), np.where(around, np.minimum(at + reach + k, offsets[row + 1]), at + n))
                kept, spans, removed = [], [], []
                body = raw.tobytes()
                for i in range(len(part)):
                    a, z = int(offsets[i]), int(offsets[i + 1])
                    mask = gone[a:z]
                    removed.append(int(mask.sum()))
                    if removed[-1]:
                        kept.append(raw[a:z][~mask].tobytes())
                        spans.append([{"start": x, "end": y} for x, y in zip(*map(np.ndarray.tolist, runs(mask)), strict=True)])
                    else:
                        kept.append(body[a:z])
                        spans.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "content", "n_bytes", "n_removed", "spans"],
                )

    return docs.mapInArrow(run, "doc_id long, content binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")
