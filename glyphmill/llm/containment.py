"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment.

Items of few shingles weigh too little in any window for MinHash and are looked up by their shingles instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Rolling, joined, kept, lean, mix, save, slices, word_hashes, words_of

#: Words here are runs of ASCII letters, digits and all bytes beyond ASCII, so punctuation never hides an item.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
HASHES = 32
#: Shingles in a block; a window is made up of whole blocks.
BASE = 8
#: Items of up to so many shingles are looked up by their shingles.
FEW = 11
#: Characters of items that are searched for at once.  More items are searched in several passes.
MOST_ITEM_CHARS = 64 << 20
_ODD = (np.random.Generator(np.random.PCG64(99)).integers(1 << 31, size=HASHES) * 2 + 1).astype(np.uint32)
LEAK = "array<struct<item_id:long,n_shared:long,n_shingles:long>>"


def shingled(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, where each text's begin, word hashes, and where each text's begin."""
    raw, offsets = joined(column)
    start, end, first = words_of(LOWER[raw], offsets, SEPARATOR)
    values = word_hashes(LOWER[raw], start, end)
    n = np.maximum(np.diff(first) - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], n)
    return Rolling(values).every(k)[at] if len(at) else np.zeros(0, np.uint64), bounds, values, first


def minhash_view(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Partition:
    """Items of a size class: at most ``blocks * BASE`` shingles long with what a window may add."""

    window: int  #: blocks in a window
    values: list[np.ndarray]  #: by hash function the items' minima, sorted
    items: list[np.ndarray]
    seen: np.ndarray  #: one bit for each value's low bits


class Index:
    """The items in memory: exact shingles, and MinHash signatures in partitions by size."""

    def __init__(self, ids: list[int | None], texts: list[str | None], k: int, share: float) -> None:
        self.k, self.ids = k, ids
        hashes, bounds, words, first = shingled(pa.array(texts, pa.string()), k)
        self.shingles = [np.unique(hashes[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # items below k words, by length
        short: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(np.diff(first).tolist()):
            if 0 < n < k:
                whole = Rolling(words[first[i] : first[i + 1]]).every(n)
                self.shingles[i] = whole
                short.setdefault(n, []).append((int(whole[0]), i))
        for n, rows in short.items():
            rows.sort()
            self.short[n] = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows])
        classes: dict[int, list[int]] = {}
        for i, s in enumerate(self.shingles):
            if len(s) > FEW and np.diff(first)[i] >= k:
                classes.setdefault(max(1, int(np.ceil(2 * np.log2(max(len(s), BASE) / BASE)))), []).append(i)
        few = [i for i, s in enumerate(self.shingles) if 0 < len(s) <= FEW and np.diff(first)[i] >= k]
        self.few_values, self.few_items = self._rarest(few, share)
        self.few_seen = np.zeros(1 << 20, dtype=bool)
        self.few_seen[self.few_values & np.uint64(0xFFFFF)] = True
        self.partitions = []
        for c, rows in sorted(classes.items()):
            most = BASE * 2 ** (c / 2)
            values, items, seen = [], [], np.zeros((HASHES, 1 << 16), dtype=bool)
            views = [minhash_view(self.shingles[i]) for i in rows]
            for j in range(HASHES):
                v = np.array([int((x * _ODD[j]).min()) for x in views], dtype=np.uint32)
                order = np.argsort(v, kind="stable")
                values.append(v[order])
                items.append(np.array(rows)[order])
                seen[j, v & np.uint32(0xFFFF)] = True
            # a run of ``most`` shingles and a fifth more lies in this many blocks, wherever it begins
            self.partitions.append(Partition(int(np.ceil(most * 1.2 / BASE)) + 1, values, items, seen))

    def _rarest(self, few: list[int], share: float) -> tuple[np.ndarray, np.ndarray]:
        """Sorted shingles of these items with the item of each: of each item so many that a text without them holds too few.

        They are the rarest among the items, so that no list is long without need.
        """
        if not few:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        lens = np.array([len(self.shingles[i]) for i in few])
        flat = np.concatenate([self.shingles[i] for i in few])
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(few)), lens)
        order = np.lexsort((flat, counts[inverse], owner))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        taken = rank <= (lens - np.maximum(np.ceil(share * lens), 1))[owner]
        values, items = flat[order][taken], np.array(few)[owner[taken]]
        order = np.argsort(values, kind="stable")
        return values[order], items[order]

    def search(self, column: pa.Array) -> set[tuple[int, int]]:
        """Pairs (text, item) that may be contained."""
        hashes, bounds, words, first = shingled(column, self.k)
        found: set[tuple[int, int]] = set()
        for n, (values, items) in self.short.items():
            grams = Rolling(words).every(n)
            at = np.flatnonzero(np.isin(grams, values))
            text = np.searchsorted(first, at, side="right") - 1
            ok = at + n <= first[text + 1]
            for p, t in zip(at[ok].tolist(), text[ok].tolist(), strict=True):
                a, z = np.searchsorted(values, grams[p], "left"), np.searchsorted(values, grams[p], "right")
                found.update((t, int(i)) for i in items[a:z])
        at = np.flatnonzero(self.few_seen[hashes & np.uint64(0xFFFFF)])
        low, high = np.searchsorted(self.few_values, hashes[at], "left"), np.searchsorted(self.few_values, hashes[at], "right")
        at, low, high = at[high > low], low[high > low], high[high > low]
        text = np.searchsorted(bounds, at, side="right") - 1
        for t, a, z in zip(text.tolist(), low.tolist(), high.tolist(), strict=True):
            found.update((t, int(i)) for i in self.few_items[a:z])
        if not len(hashes) or not self.partitions:
            return found
        lens = np.diff(bounds)
        n_blocks = -(-lens // BASE)
        block_text = np.repeat(np.arange(len(lens)), n_blocks)
        starts = np.concatenate([[0], np.cumsum(n_blocks)])
        at = (np.arange(starts[-1]) - starts[:-1][block_text]) * BASE + bounds[:-1][block_text]
        view = minhash_view(hashes)
        for j in range(HASHES):
            least = np.minimum.reduceat(view * _ODD[j], at)
            width = 1
            window = least
            for p in self.partitions:  # windows grow from one partition to the next
                while width < p.window:
                    step = min(width, p.window - width)
                    wider = window.copy()
                    near = block_text[step:] == block_text[:-step] if step < len(window) else np.zeros(0, bool)
                    wider[: len(window) - step][near] = np.minimum(window[: len(window) - step], window[step:])[near]
                    window, width = wider, width + step
                hit = np.flatnonzero(p.seen[j, window & np.uint32(0xFFFF)])
                low, high = np.searchsorted(p.values[j], window[hit], "left"), np.searchsorted(p.values[j], window[hit], "right")
                for b, a, z in zip(hit.tolist(), low.tolist(), high.tolist(), strict=True):
                    t = int(block_text[b])
                    found.update((t, int(i)) for i in p.items[j][a:z])
        return found

    def leaks(self, column: pa.Array, share: float) -> list[list[dict]]:
        short = {int(i) for _, items in self.short.values() for i in items}
        out: list[list[dict]] = [[] for _ in range(len(column))]
        pairs = sorted(self.search(column))
        if not pairs:
            return out
        hashes, bounds, words, first = shingled(column, self.k)
        last, own = -1, hashes[:0]
        for t, i in pairs:
            if t != last:
                last, own = t, np.unique(hashes[bounds[t] : bounds[t + 1]])
            want = self.shingles[i]
            shared = len(want) if i in short else int(np.isin(want, own, assume_unique=True).sum())
            if shared >= share * len(want):
                out[t].append({"item_id": self.ids[i], "n_shared": shared, "n_shingles": len(want)})
        return out


def index_of(search: str, ids: list, texts: list, k: int, share: float) -> Index:
    return kept(("index", search), lambda: Index(ids, texts, k, share))


def with_leaks(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """``docs`` with ``leaks``: the items of which each text holds at least ``share`` of the distinct ``k``-word shingles.

    Words are runs of letters and digits, A-Z lower-cased.  Items of up to ``FEW`` shingles are looked up by shingles, which
    misses none.  Longer ones are in partitions by size; each partition is
    searched with windows 1.2 to 2.7 times as long as its items, so that a short item weighs enough in a long
    document; a window whose MinHash agrees with an item's anywhere makes a candidate, and candidates are verified by
    exact containment in the whole text.  An item below ``k`` words is one shingle of its own length; items without words and
    null or empty texts match nothing; repeated items count one by one, and so do ties and repeated rows.  All columns and rows of ``docs`` stay, but for a column
    ``leaks`` of its own, which is replaced; no items: no leaks.  A pass holds the items of ``MOST_ITEM_CHARS`` characters, and is written before the next
    one, so neither the driver nor a worker holds more at once.
    """
    items = items.select("item_id", "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = -(-int(chars) // MOST_ITEM_CHARS) or 1
    schema = T.StructType([f for f in docs.schema.fields if f.name != "leaks"] + [T.StructField("leaks", T._parse_datatype_string(LEAK))])
    names = [f.name for f in schema.fields[:-1]]
    out = docs.select(*names)
    for n in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        rows = part.orderBy("item_id", "text").collect()  # at most about MOST_ITEM_CHARS
        ids, texts = [r.item_id for r in rows], [r.text for r in rows]
        found = out.mapInArrow(lean(_searcher(ids, texts, k, share, names, n > 0), keeps=True), schema)
        out = save(found, drop=[out]) if n < passes - 1 else found
    return out


def _searcher(ids: list, texts: list, k: int, share: float, names: list[str], more: bool):
    search = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_shingles", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(search, ids, texts, k, share)
        for batch in batches:
            for a, z in slices(batch):
                part = batch.slice(a, z - a)
                leaks = index.leaks(part.column("text"), share)
                if more:
                    leaks = [x + y for x, y in zip(part.column("leaks").to_pylist(), leaks, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(leaks, kind)], [*names, "leaks"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, share: float = 0.8) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay, one named ``leaks`` too."""
    own = "leaks" in docs.columns
    found = with_leaks(docs.withColumnRenamed("leaks", "own leaks") if own else docs, items, k, share).where(F.size("leaks") == 0).drop("leaks")
    return found.withColumnRenamed("own leaks", "leaks").select(*docs.columns) if own else found
