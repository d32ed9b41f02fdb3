"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size says how often each of its documents is taken: a whole number of times, and
once more with the fraction as inclusion probability.  The flight moves the fractions of
a stratum along the null space of its constraints (documents and words), so that
totals stay and one fraction after another becomes 0 or 1.  It runs in buckets; a few units of each bucket
stay out of it and fly with the leftovers again, until a single bucket a source is left.  There
the landing rounds the last two fractions, and exchanges units until the words that this put in or out are made up for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

WEIGHTS = (1, 2, 3)
MOST = 3
#: Units that fly together, about, and those of them that are left for the next level.
BUCKET, RESERVE = 2_000, 30
#: Units that the landing chooses anew together.
SETTLED = 16
EPS = 1e-9


def with_targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to rows (source, size): shares by weight in the order of the sources, none above ``MOST`` times its size.

    What the capped sources leave over raises the level of all others, until no more of them is above its cap; only the
    level and two sums reach the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weighted = save(sources.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), (place - 1) % len(WEIGHTS))))
    total = weighted.agg(F.sum("size")).first()[0] or 0
    capped = F.lit(False)
    n_capped = -1
    while True:
        r = weighted.agg(F.sum(F.when(capped, F.col("size")).otherwise(0)).alias("size"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weight"), F.sum(capped.cast("long")).alias("n")).first()
        rest, weight = total - MOST * (r["size"] or 0), r["weight"] or 0
        if not weight or r["n"] == n_capped:
            break
        n_capped = r["n"]
        # in 64 bits: a product of integers fails from 2**31 on
        capped = F.lit(rest).cast("long") * F.col("weight") > F.lit(MOST) * F.col("size") * F.lit(weight)
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))
    return weighted.withColumn("target", F.when(capped, (MOST * F.col("size")).cast("double")).otherwise(share)).drop("weight")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fractions after the flight: all but two at most are 0 or 1, and both totals are as before."""
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    draw = iter(rng.random(2 * len(p) + 8).tolist())
    active: list[int] = []
    for k in range(len(p)):
        if EPS < p[k] < 1 - EPS:
            active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for i, x in zip(active, u, strict=True):
                if x > 0:
                    up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
                elif x < 0:
                    up, down = min(up, -p[i] / x), min(down, (p[i] - 1) / x)
            step = up if next(draw) * (up + down) < down else -down
            for i, x in zip(active, u, strict=True):
                p[i] += step * x
            left = [i for i in active if EPS < p[i] < 1 - EPS]
            if len(left) == 3:  # rounding kept the one at the border from it
                left.remove(min(left, key=lambda i: min(p[i], 1 - p[i])))
            for i in active:
                if i not in left:
                    p[i] = float(round(p[i]))
            active = left
    return np.array(p)


def subsets(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of members of all subsets; bit i of a subset's number says whether it has unit i."""
    sums, counts = np.zeros(1), np.zeros(1)
    for x in size:
        sums, counts = np.concatenate([sums, sums + x]), np.concatenate([counts, counts + 1])
    return sums, counts


def settle(p: np.ndarray, chosen: np.ndarray, size: np.ndarray, over: float, more: float) -> float:
    """Choose anew which of a few units are taken, so that the words (``over``: how many too many now) come out best; gives what is over then.

    Of choices within half a word of the best, the one with the better number of documents (``more``: how many too many now), then
    the one that changes the fewest.
    """
    sums, counts = subsets(size[chosen])
    now = int((p[chosen].astype(np.int64) << np.arange(len(chosen))).sum())
    miss = np.abs(over + sums - sums[now])
    near = np.flatnonzero(miss <= miss.min() + 0.5)
    changed = sum(((near ^ now) >> i) & 1 for i in range(len(chosen)))
    best = near[np.lexsort((near, miss[near], changed, np.abs(more + counts[near] - counts[now])))[0]]
    p[chosen] = best >> np.arange(len(chosen)) & 1
    return over + sums[best] - sums[now]


def exchange(p: np.ndarray, size: np.ndarray, over: float, up: Callable[[np.ndarray], np.ndarray], down: Callable[[np.ndarray], np.ndarray], alone: bool) -> float:
    """Take a unit more and another less (``alone``: or only one of the two) as long as that makes up for words; ``up`` and ``down`` say which may be."""
    while abs(over) > 0.5:
        add, cut = np.flatnonzero(up(p)), np.flatnonzero(down(p))
        moves = []
        if alone:
            moves += [(abs(over + size[i]), i, -1) for i in add[np.argsort(np.abs(over + size[add]), kind="stable")[:1]]]
            moves += [(abs(over - size[i]), -1, i) for i in cut[np.argsort(np.abs(over - size[cut]), kind="stable")[:1]]]
        if len(add) and len(cut):
            add = add[np.argsort(size[add], kind="stable")]
            at = np.searchsorted(size[add], size[cut] - over)
            at = np.stack([np.maximum(at - 1, 0), np.minimum(at, len(add) - 1)])
            after = np.abs(over + size[add][at] - size[cut])
            side, i = np.unravel_index(int(np.argmin(after)), after.shape)
            # of moves that come out alike, the one that keeps the number of documents
            moves.insert(0, (after[side, i], add[at[side, i]], cut[i]))
        if not moves or (best := min(moves, key=lambda m: m[0]))[0] >= abs(over) - 0.5:
            return over
        _, i, j = best
        if i >= 0:
            p[i] += 1
            over += float(size[i])
        if j >= 0:
            p[j] -= 1
            over -= float(size[j])
    return over


def landing(p: np.ndarray, size: np.ndarray, wanted: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Rounds the last fractions (two at most) and makes up for the words that this puts in or out.

    First units change places that are taken or not, then a few of them are chosen anew together (all, if there are no more than
    ``SETTLED``).  Only where words are still missing, units are taken once more or less than their share (never below none or
    above ``MOST`` times, with ``whole`` times besides), as few as do.
    """
    p = p.copy()
    size = size.astype(float)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    best = None
    for m in range(1 << len(open_)):
        x = np.array([m >> j & 1 for j in range(len(open_))], dtype=float)
        cost = (abs(float(((x - p[open_]) * size[open_]).sum())), abs(float((x - p[open_]).sum())), m)
        if best is None or cost < best[0]:
            best = (cost, x)
    p[open_] = best[1] if best else p[open_]
    p = np.round(p)
    free = (wanted > EPS) & (wanted < 1 - EPS)
    over = float(((p - wanted) * size).sum())
    if free.sum() > SETTLED:
        over = exchange(p, size, over, lambda p: free & (p == 0), lambda p: free & (p == 1), alone=False)
    if abs(over) > 0.5 and free.any():
        units = np.flatnonzero(free)
        units = units[np.argsort(size[units], kind="stable")][np.unique(np.linspace(0, len(units) - 1, min(SETTLED, len(units))).astype(int))]
        over = settle(p, units, size, over, float((p - wanted).sum()))
    if abs(over) > 0.5:
        whole = np.zeros(len(p)) if whole is None else whole
        some = size > 0
        exchange(p, size, over, lambda p: some & (whole + p < MOST), lambda p: some & (whole + p > 0), alone=True)
    return p


def mix_sources(docs: DataFrame, seed: int = 0) -> DataFrame:
    """How often to take each document: doc_id, tag (of the text), size, source_size, target, copies, taken.

    Size: words of the text (null or empty: 0; of a very long text all).  Sources are ordered by code point, null last.  One row for each row of
    ``docs``, none for an empty table; repeated rows are units of their own and interchangeable; a source without words gets the target 0
    and is not taken; no document is taken more than three times; other columns are ignored.  Runs agree: order and draws are hashes of the
    rows, ties are broken by them, and buckets follow from the number of rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    units = save(docs.select("doc_id", "source", F.shiftrightunsigned(F.xxhash64("text"), 33).alias("tag"), size.alias("size")))
    found = units.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = with_targets(found).select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("p"), F.ceil(F.col("n") / BUCKET).cast("long").alias("buckets"))
    plan = save(plan)
    most = plan.agg(F.max("buckets")).first()[0] or 1
    units = units.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rank", F.xxhash64(F.lit(seed), "doc_id", "tag", "size"))
    schema = units.schema
    settled: list[DataFrame] = []
    level = 0
    while True:
        bucket = F.pmod(F.xxhash64(F.lit(level), "rank"), F.greatest(F.col("buckets"), F.lit(1)))
        flown = save(units.groupBy("source", bucket.alias("bucket")).applyInPandas(_fly(seed, level), schema))
        last = most <= 1
        open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        settled.append(flown if last else flown.where(~open_))
        if last:
            break
        # each bucket leaves its reserve and two units at most
        units = flown.where(open_).withColumn("buckets", F.ceil((RESERVE + 2) * F.col("buckets") / BUCKET).cast("long"))
        most = -(-(RESERVE + 2) * most // BUCKET)
        level += 1
    out = settled[0]
    for df in settled[1:]:
        out = out.unionByName(df)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "tag", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _fly(seed: int, level: int):
    def run(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        last = int(units["buckets"].iloc[0]) <= 1
        units = units.sort_values(["rank", "size", "doc_id"], kind="stable", na_position="first")
        kept, units = (units[:0], units) if last else (units[:RESERVE], units[RESERVE:])
        # long documents first, so that short ones follow to settle them
        units = units.sort_values(["size", "rank", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first")
        rng = np.random.Generator(np.random.PCG64([seed, level, int(key[1]), len(units)]))
        wanted, size = units["p"].to_numpy(), units["size"].to_numpy()
        p = flight(wanted, size, rng)
        if last:
            p = landing(p, size, wanted, units["whole"].to_numpy())
        return pd.concat([kept, units.assign(p=p)]) if len(kept) else units.assign(p=p)

    return run


def take(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    copies = mix_sources(docs, seed).where("copies > 0").groupBy(F.col("doc_id").alias("taken_id"), F.col("tag").alias("taken_tag")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.shiftrightunsigned(F.xxhash64("text"), 33).alias("key"))
    joined = keyed.join(copies, F.col("id").eqNullSafe(F.col("taken_id")) & (F.col("key") == F.col("taken_tag")))
    # rows that repeat share their copies: one of them takes all
    single, repeated = joined.where("rows = 1"), joined.where("rows > 1").dropDuplicates(["id", "key"])
    return single.unionByName(repeated).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
