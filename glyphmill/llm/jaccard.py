"""Documents that share most of their word shingles: a size-aware join with a light and a heavy side.

Light sets enumerate their subsets that are large enough to be an intersection: two linked sets share one.
Heavy sets are found by scanning inverted lists.  A list of a single shingle can hold a third of all documents, and in prose
most shingles are found elsewhere too, so the lists are those of parts: a set's shingles are dealt by hash into so many
parts that, of two linked sets, at least one part that is not empty agrees as a whole.  The boundary is
where the subsets and the list entries of all sets are fewest.

A list proposes links.  Two sets that are neighbours in several lists are nearly always linked, so those make up the first
families, and in a family sets are compared exactly, block by block.  What lists still hold sets of different
components is then searched: each pair of a list has a lower bound on how much it differs, from
sketches of one parity bit for each of some hundred buckets, and only pairs whose bound allows a link are compared too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations
from math import ceil, comb, exp, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import LOWER, Rolling, joined, lean, mix, save, slices, word_hashes, words_of
from .graph import components
from .substring import tagged

#: Sets, and shingles of sets, that are compared with each other in one task at once, about.
BLOCK, BLOCK_SHINGLES = 256, 2 << 20
#: Sets of a list whose sketches are compared at once.
LIST_BLOCK = 512
#: Bytes of texts whose shingles and signatures are made at once: a set has several signatures for each five words.
AT_ONCE = 1 << 19
#: Ratio of the sizes in a class of heavy sets.
CLASS_RATIO = Fraction(13, 10)
SEEDS = 3
LARGEST_LIGHT = 40
#: A set and the least set of so many of its lists are compared first.
STRONG = 3
#: Bits of the filter of documents that are compared: for each of them, and at most (8 MB).
MEMBER_BITS, MOST_BITS = 16, 1 << 26


def shingle_sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each set begins."""
    raw, offsets = joined(part.column("text"))
    raw = LOWER[raw]
    start, end, first = words_of(raw, offsets)
    values = word_hashes(raw, start, end)
    n = np.diff(first)
    rolling = Rolling(values)
    grams = rolling.every(k)
    owner = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
    at = np.arange(len(owner)) - np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])[:-1][owner] + first[:-1][owner]
    short = np.flatnonzero((n > 0) & (n < k))
    owner = np.concatenate([owner, short])
    hashes = np.concatenate([grams[at], rolling.ranges(first[:-1][short], first[1:][short])])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[fresh], hashes[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[offsets[1:]] - total[offsets[:-1]]


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A set's id: a hash of its size and of a sum over its members."""
    with np.errstate(over="ignore"):
        return mix(sums(mix(hashes), offsets) + mix(np.diff(offsets).astype(np.uint64)))


@cache
def parts_of(low: int, high: int, t: Fraction) -> tuple[int, int]:
    """Parts of sets of ``low`` to ``high`` shingles, and how many of them may be empty.

    Two linked sets, the smaller of this class, differ in so many shingles at most; each spoils one part; the empty
    ones agree but tell nothing.  Sets that leave more parts empty are dealt anew.
    """
    both = high + floor(high / t)
    spoilt = both - 2 * ceil(both * t / (1 + t)) + 1  # sizes just below round otherwise by one at most
    m, empty = spoilt + 1, 0
    while m < spoilt + 1 + empty or not empty:
        m = spoilt + 1 + empty
        p = exp(-low / m)
        empty = max(1, ceil(m * p + 3 * sqrt(m * p * (1 - p))))
        if empty * 2 > m:  # a class of few shingles: most parts are empty, so the allowance is what is left
            return max(m, 2 * spoilt + 2), spoilt + 1
    return m, empty


class Scheme:
    """Which signatures a set of a size has, for links of at least ``percent`` of the union."""

    def __init__(self, percent: int, boundary: int) -> None:
        self.t = Fraction(percent, 100)
        self.boundary = boundary
        edges = [max(ceil(self.t * (boundary + 1)), 1)]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, ceil(edges[-1] * CLASS_RATIO)))
        self.edges = np.array(edges)
        made = [parts_of(a, z - 1, self.t) for a, z in zip(edges, edges[1:], strict=False)]
        self.parts, self.empty = (np.array(x) for x in zip(*made, strict=True))

    def removals(self, n: int) -> int:
        return n - ceil(self.t * n)

    def classes(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Set numbers with their classes: a set's own, and those below in which it can be the larger set of a pair."""
        at = np.flatnonzero(n >= self.edges[0])
        own = np.searchsorted(self.edges, n[at], side="right") - 1
        lowest = np.maximum(np.searchsorted(self.edges, -(-n[at] * self.t.numerator // self.t.denominator), side="right") - 1, 0)
        many = own - lowest + 1
        row = np.repeat(np.arange(len(at)), many)
        return at[row], own[row] - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))

    def cost(self, n: int) -> int:
        light = sum(comb(n, d) for d in range(self.removals(n) + 1)) if n <= self.boundary else 0
        return light + int(self.parts[self.classes(np.array([n]))[1]].sum())


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The boundary with the fewest signatures, for counts of the sets of each size up to ``LARGEST_LIGHT``."""
    made = [Scheme(percent, b) for b in range(LARGEST_LIGHT + 1)]
    return min(made, key=lambda x: (sum(v * x.cost(n) for n, v in sizes.items()), x.boundary)).boundary


def signatures(hashes: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers and signatures of all sets."""
    n = np.diff(offsets)
    mixed = mix(hashes)
    owners, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for i in np.flatnonzero((n > 0) & (n <= scheme.boundary)):
            own = mixed[offsets[i] : offsets[i + 1]]
            total = own.sum(dtype=np.uint64)
            size = int(n[i])
            sigs = [total + np.uint64(size)]
            for d in range(1, scheme.removals(size) + 1):
                index = np.array(list(combinations(range(size), d)))
                sigs.append(total - own[index].sum(axis=1, dtype=np.uint64) + np.uint64(size - d))
            sigs = np.hstack(sigs)
            owners.append(np.full(len(sigs), i))
            out.append(mix(sigs ^ np.uint64(0x5851F42D4C957F2D)))
        row, cls = scheme.classes(n)
        for seed in range(SEEDS):
            if not len(row):
                break
            m = scheme.parts[cls]
            base = np.concatenate([[0], np.cumsum(m)])
            lens = n[row]
            each = np.repeat(np.arange(len(row)), lens)
            at = np.arange(len(each)) - np.repeat(np.cumsum(lens) - lens, lens) + offsets[row][each]
            x = mix(mixed[at] + np.uint64(seed + 1))
            slot = base[each] + (((x >> np.uint64(32)) * m[each].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            low = np.bincount(slot, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(np.uint64)
            high = np.bincount(slot, (mixed[at] >> np.uint64(32)).astype(np.float64), base[-1]).astype(np.uint64)
            empty = np.bincount(slot, minlength=base[-1]) == 0
            number = np.repeat(np.arange(len(row)), m)
            place = np.arange(base[-1]) - base[number]
            label = mix((cls[number] * 4 + seed).astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)))
            sig = mix(mix(low + label) ^ (high * np.uint64(0x9E3779B97F4A7C15)))
            # sets with too many empty parts are dealt anew with another seed; the last seed counts them too
            over = np.bincount(number, empty, len(row)) > scheme.empty[cls]
            emit = ~empty if seed < SEEDS - 1 else ~empty | over[number]
            owners.append(row[number[emit]])
            out.append(sig[emit])
            row, cls = row[over], cls[over]
    return np.concatenate(owners), np.concatenate(out)


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set one parity bit for each bucket, at least as many buckets as shingles (a power of two, 64 at least).

    A shingle that only one of two sets has flips one bit, so their sketches differ in no more bits than the sets do in shingles.
    """
    n = np.diff(offsets)
    bits = np.int64(1) << np.maximum(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 6)
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    slot = base[owner] + (mix(hashes + np.uint64(0xA5A5)).view(np.int64) & (bits[owner] - 1))
    packed = np.packbits((np.bincount(slot, minlength=base[-1]) & 1).astype(np.uint8)).tobytes()
    return [packed[a:z] for a, z in zip((base[:-1] // 8).tolist(), (base[1:] // 8).tolist(), strict=True)]


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch as it would be with fewer buckets."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def plausible(n: np.ndarray, found: list[bytes], part: np.ndarray, left: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that may be linked and are in different components.  With ``left``, only pairs of one before it and one from it on."""
    size = np.array([len(x) for x in found])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for width in np.unique(size):
        # pairs whose smaller sketch has this width; sizes of linked sets are not farther apart
        rows = np.flatnonzero((size >= width) & (size <= width << (100 // percent).bit_length()))
        bits = np.stack([folded(np.frombuffer(found[i], np.uint8), width) for i in rows]).view(np.uint64)
        for x in range(len(rows)):
            i = rows[x]
            others = np.arange(x + 1, len(rows))
            y = rows[others]
            with_own = (size[i] == width) | (size[y] == width)
            keep = with_own & (part[y] != part[i]) & ((i < left) != (y < left) if left else True)
            both = n[i] + n[y]
            keep &= 100 * np.minimum(n[i], n[y]) >= percent * np.maximum(n[i], n[y])
            others, y, both = others[keep], y[keep], both[keep]
            if not len(y):
                continue
            differ = np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1, dtype=np.int64)
            near = differ <= both - 2 * -(-both * percent // (100 + percent))
            out.append((np.full(int(near.sum()), i), y[near]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def forest(m: int, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """The components of pairs among m things, each as pairs of its first one and another."""
    parent = list(range(m))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in zip(left, right, strict=True):
        if (a := find(i)) != (b := find(j)):
            parent[max(a, b)] = min(a, b)
    return [(find(i), i) for i in range(m) if find(i) != i]


def linked(sets: list[np.ndarray], left: int, percent: int) -> list[tuple[int, int]]:
    """Components of the links among sets, each as pairs of its first set and another.  With ``left``, only pairs of one before it and one from it on link."""
    m = len(sets)
    n = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (n.sum() - both) else []
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), n)
    shared = counts[inverse] > 1
    owner, inverse = owner[shared], (np.cumsum(counts > 1) - 1)[inverse[shared]]
    common = np.zeros((m, m), dtype=np.float32)
    width = 8192
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    for a in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        low, high = np.searchsorted(inverse, [a, a + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[owner[low:high], inverse[low:high] - a] = 1
        common += x @ x.T
    hit = 100.0 * common >= percent * (n[:, None] + n[None, :] - common.astype(np.float64))
    hit = np.triu(hit, 1)
    if left:
        hit[:left, :left] = hit[left:, left:] = False
    x, y = np.nonzero(hit)
    return forest(m, x.tolist(), y.tolist())


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The component of each document under links of at least ``percent`` % of shared shingles.

    A set: the distinct ``k``-word shingles, A-Z lower-cased; with fewer words the whole sequence as one;
    without words (null or empty text) empty, and linked with nothing.  Returns doc_id, tag (of the text), n_shingles,
    root (a number of the component), component_id (its least doc_id; null only if all its ids are null), one row
    for each row of ``docs``; no rows for an empty table.  Equal sets are one node, whatever their ids, so copies and repeated rows are
    never paired; a very long text is one set as any other; other columns are ignored.
    """
    docs = tagged(docs)

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, limit=AT_ONCE):
                part = batch.slice(a, z - a)
                hashes, offsets = shingle_sets(part, k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array(np.diff(offsets)), pa.array(set_ids(hashes, offsets).view(np.int64)), pa.array(sketches(hashes, offsets), pa.binary())], ["doc_id", "tag", "n_shingles", "set_id", "sketch"])

    rows = save(docs.mapInArrow(lean(identify), "doc_id long, tag long, n_shingles long, set_id long, sketch binary"))
    small = {r.n_shingles: r["count"] for r in rows.where(F.col("n_shingles").between(1, LARGEST_LIGHT)).groupBy("n_shingles").count().collect()}
    entries = save(lists(docs, k, Scheme(percent, choose_boundary(small, percent))))
    strong = entries.where("a <> b").groupBy("a", "b").count().where(F.col("count") >= STRONG).select("a", "b")
    merged = compared(docs, rows, components(strong), k, percent)
    more = save(proposed(entries, merged, rows, percent), drop=[entries])
    if not more.isEmpty():
        merged = joined_parts(merged, compared(docs, rows, components(more), k, percent))
    sets = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    rooted = sets.join(merged.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_id", "first", F.coalesce("root", "set_id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, "root").select("set_id", "root", "component_id")
    out = rows.drop("sketch").join(labels, "set_id", "left")
    return out.select("doc_id", "tag", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_seen(ids: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which rows have an id that is not in ``seen`` yet; adds them."""
    out = np.zeros(len(ids), dtype=bool)
    for i, s in enumerate(ids.tolist()):
        if s not in seen:
            seen.add(s)
            out[i] = True
    return out


def keep_one(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one document of each component: that of the least doc_id (then tag), null first.

    Documents without words all stay; of rows that repeat id and text one stays.
    """
    rows = save(jaccard_components(docs, k, percent).where("n_shingles > 0"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("one")).select("one.doc_id", "one.tag")
    gone = rows.select("doc_id", "tag").join(first.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left_anti").distinct()
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("key"))
    kept = keyed.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_tag")), "left_anti")
    if not rows.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "key"])
    return kept.select("row.*")


def lists(docs: DataFrame, k: int, scheme: Scheme) -> DataFrame:
    """Entries of the lists of two sets or more: sig, b (the set), and a, the list's least set.  They are most of what is shuffled, so sizes of sets stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task: copies in it emit once
        for batch in batches:
            for a, z in slices(batch, limit=AT_ONCE):
                part = batch.slice(a, z - a)
                hashes, offsets = shingle_sets(part, k)
                ids = set_ids(hashes, offsets).view(np.int64)
                keep = first_seen(ids, seen)
                n = np.diff(offsets)
                owner, sig = signatures(hashes[np.repeat(keep, n)], np.concatenate([[0], np.cumsum(n[keep])]), scheme)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[keep][owner])], ["sig", "b"])

    by_list = Window.partitionBy("sig")
    rows = docs.select("text").mapInArrow(lean(run), "sig long, b long")
    return rows.withColumn("a", F.min("b").over(by_list)).withColumn("most", F.max("b").over(by_list)).where("a <> most").drop("most")


def proposed(entries: DataFrame, merged: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of one list that are in different components and may be linked by their sketches."""
    parts = entries.select("sig", "b").join(merged.withColumnRenamed("node", "b"), "b", "left").select("sig", "b", F.coalesce("root", "b").alias("part"))
    by_list = Window.partitionBy("sig")
    parts = parts.withColumn("one", F.min("part").over(by_list)).withColumn("other", F.max("part").over(by_list)).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(by_list) / LIST_BLOCK).cast("long"))
    parts = save(parts.where("one <> other").select("sig", "b", "part", "blocks"))
    wanted = parts.select("b").distinct()
    found = rows.where("n_shingles > 0").select(F.col("set_id").alias("b"), "n_shingles", "sketch").join(wanted, "b", "left_semi").groupBy("b").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    own = F.pmod(F.xxhash64("b"), F.col("blocks"))
    dealt = parts.join(found.hint("merge"), "b").withColumn("own", own).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), (F.col("own") > F.col("to")).alias("right"), "b", "n", "part", "sketch")
    dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "right", "b")

    def pairs(group: dict[str, list], left: int) -> list[tuple[int, int]]:
        x, y = plausible(np.array(group["n"], dtype=np.int64), group["sketch"], np.array(group["part"]), left, percent)
        b = group["b"]
        # pairs only join families, so those that connect the same sets will do
        return [(b[i], b[j]) for i, j in forest(len(b), x.tolist(), y.tolist())]

    return dealt.mapInArrow(by_blocks(["sig", "i", "j"], "b", pairs, [("a", pa.int64()), ("b", pa.int64())]), "a long, b long").distinct()


def by_blocks(key: list[str], item: str, solve: Callable[[dict[str, list], int], list[tuple]], fields: list[tuple[str, pa.DataType]]) -> Callable:
    """A function for mapInArrow over rows sorted by key (its last two: numbers of blocks), right and item.

    It gives each group to ``solve``, once for each item, with the number of items of the first block, 0 if both blocks are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: dict[str, list] = {}
        found: list[tuple] = []

        def flush() -> None:
            left = held["right"].count(False)
            one = at[-2] == at[-1]
            if len(held[item]) > 1 and (one or 0 < left < len(held[item])):
                found.extend(solve(held, 0 if one else left))

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, (_, t) in enumerate(fields)], [c for c, _ in fields])
            found.clear()
            return out

        for batch in batches:
            names = batch.schema.names
            for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                row = dict(zip(names, values, strict=True))
                now = tuple(row[c] for c in key)
                if now != at:
                    if at is not None:
                        flush()
                    at, held = now, {c: [] for c in names}
                if not held[item] or held[item][-1] != row[item]:
                    for c in names:
                        held[c].append(row[c])
            yield give()
        if at is not None:
            flush()
            yield give()

    return lean(run)


def joined_parts(first: DataFrame, second: DataFrame) -> DataFrame:
    """node, root of the components that two such tables make up together."""
    of = lambda c: first.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    across = second.select(F.col("node").alias("a"), F.col("root").alias("b")).join(of("a"), "a", "left").join(of("b"), "b", "left")
    across = components(across.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    again = across.select(F.col("node").alias("root"), F.col("root").alias("last"))
    inner = first.join(again, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return save(inner.unionByName(across.join(first.select("node"), "node", "left_anti")), free=False)


def compared(docs: DataFrame, rows: DataFrame, families: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root of the components of links among the sets of each family; sets without link may be left out.

    A family of up to a block is compared, and its components are found, at once.  The sets of a larger one are dealt into blocks, and each block
    meets block 0, the pivots.  Then all sets that are outside the family's largest component so far meet all others but the
    pivots, so the work is linear where most sets of a family are near copies of some pivot.
    """
    members = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.struct("doc_id", "tag")).alias("one"), F.first("n_shingles").alias("n")).join(families.withColumnRenamed("node", "set_id"), "set_id")
    members = save(members.select("set_id", F.col("root").alias("family"), F.col("one.doc_id").alias("_id"), F.col("one.tag").alias("_tag"), "n"))

    def blocks() -> F.Column:
        return F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")

    def dealt_by(rows: DataFrame, n: str) -> F.Column:
        return F.pmod(F.xxhash64("set_id"), F.col(n))

    sizes = members.groupBy(F.col("family").alias("_family")).agg(blocks().alias("blocks"))
    members = members.join(sizes, F.col("family") == F.col("_family")).drop("_family").withColumn("own", dealt_by(members, "blocks"))
    whole = F.when(F.col("own") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = members.select("set_id", "_id", "_tag", "family", F.lit(0).cast("long").alias("i"), F.explode(whole).alias("j"), (F.col("own") > 0).alias("right"), (F.col("blocks") > 1).alias("large"))
    links = save(solved(docs, first, k, percent))
    small = links.where("not large").select(F.col("b").alias("node"), F.col("a").alias("root"))
    small = small.unionByName(small.select(F.col("root").alias("node"), "root").distinct())
    large = members.where("blocks > 1")
    if large.isEmpty():
        return small
    links = links.where("large").select("a", "b")
    part = large.join(components(links).withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("part", F.coalesce("root", "set_id"))
    most = part.groupBy(F.col("family").alias("_family"), "part").count().groupBy("_family").agg(F.max(F.struct("count", "part")).alias("most"))
    part = part.where("own > 0").join(most, F.col("family") == F.col("_family")).select("set_id", "_id", "_tag", "family", "n", (F.col("part") != F.col("most.part")).alias("open"))
    part = save(part)
    if not part.where("open").isEmpty():
        count = part.groupBy(F.col("family").alias("_family"), "open").agg(blocks().alias("b")).groupBy("_family").agg(F.max(F.when(F.col("open"), F.col("b"))).alias("n_open"), F.coalesce(F.max(F.when(~F.col("open"), F.col("b"))), F.lit(0)).alias("n_rest"))
        part = part.join(count.where("n_open > 0"), F.col("family") == F.col("_family"))
        part = part.withColumn("own", F.when(F.col("open"), dealt_by(part, "n_open")).otherwise(F.col("n_open") + dealt_by(part, "n_rest")))
        with_all = F.sequence(F.lit(0).cast("long"), F.col("n_open") + F.col("n_rest") - 1)
        with_open = F.sequence(F.lit(0).cast("long"), F.col("n_open") - 1)
        second = part.withColumn("other", F.explode(F.when(F.col("open"), with_all).otherwise(with_open)))
        second = second.select("set_id", "_id", "_tag", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), F.lit(True).alias("large"))
        links = links.unionByName(solved(docs, second, k, percent).select("a", "b"))
    return save(small.unionByName(components(links)))


def only_members(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """``docs`` without most of those that are not in ``parts``, so that a join shuffles few other texts; a filter that is full only saves less."""
    size = min(max(MEMBER_BITS * parts.count(), 1 << 10), MOST_BITS) // 64 * 64
    slot = F.pmod(F.xxhash64("_id", "_tag"), F.lit(size))
    found = parts.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy().view(np.uint64)
            hit = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.select(["doc_id", "tag", "text"]).filter(pa.array(hit.astype(bool)))

    rows = docs.select("doc_id", "tag", "text", F.pmod(F.xxhash64("doc_id", "tag"), F.lit(size)).alias("slot"))
    return rows.mapInArrow(lean(run), "doc_id long, tag long, text string")


def solved(docs: DataFrame, dealt: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among the sets that are dealt to the same pair of blocks, within one block (i = j) or across two: a, b, large.

    The sets that links connect there all have the least of them as a.
    """
    parts = save(dealt.groupBy("set_id", "_id", "_tag", "family", "large").agg(F.collect_list(F.struct("i", "j", "right")).alias("pairs")), free=False)
    # a merge join at every size: the members grow with the documents
    texts = only_members(docs, parts).join(parts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("family", "large", "set_id", "pairs", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, limit=AT_ONCE):
                part = batch.slice(a, z - a)
                hashes, offsets = shingle_sets(part, k)
                body = hashes.tobytes()
                data = [body[8 * x : 8 * y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("family", "large", "set_id", "pairs")), pa.array(data, pa.binary())], ["family", "large", "set_id", "pairs", "hashes"])

    rows = texts.mapInArrow(lean(sets), "family long, large boolean, set_id long, pairs array<struct<i:long,j:long,right:boolean>>, hashes binary")
    rows = rows.select("family", "large", F.explode("pairs").alias("p"), "set_id", "hashes").select("family", "large", "p.i", "p.j", "p.right", "set_id", "hashes")
    # in a pair of blocks the first block's sets come first
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "right", "set_id")

    def links(group: dict[str, list], left: int) -> list[tuple]:
        ids, large = group["set_id"], group["large"][0]
        return [(ids[x], ids[y], large) for x, y in linked([np.frombuffer(h, np.uint64) for h in group["hashes"]], left, percent)]

    return rows.mapInArrow(by_blocks(["family", "i", "j"], "set_id", links, [("a", pa.int64()), ("b", pa.int64()), ("large", pa.bool_())]), "a long, b long, large boolean")
