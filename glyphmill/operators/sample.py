"""Exact splits, subsets, shards, strides; all by hashes, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform


def subset_size(n: int, size: float | int) -> int:
    """Fractions round half to even; whole numbers are clamped to what is there."""
    return max(0, min(n, int(round(n * size)) if isinstance(size, float) else size))


def order(seed: int, salt: str, key: str) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col(key))), F.col(key)]


def subset(df: DataFrame, key: str, size: float | int, seed: int = 0, salt: str = "split") -> DataFrame:
    """Exactly so many rows, those with the least hashes of their keys.

    Rows are counted by the first 16 bits of the hash; all below the range that the border falls into are taken, and only that
    range is sorted, so no task holds more than a small part of what is taken.
    """
    n = subset_size(df.count(), size)
    digest = order(seed, salt, key)[0]
    rows = df.withColumn("_hash", digest)
    head = F.substring("_hash", 1, 4)
    counts = sorted(map(tuple, rows.groupBy(head.alias("head")).count().collect()))  # 65,536 rows at most
    below, edge = 0, None
    for name, many in counts:
        if below + many > n:
            edge = name
            break
        below += many
    if edge is None:
        return df
    sure = rows.where(head < edge).drop("_hash")
    return sure.unionByName(rows.where(head == edge).orderBy("_hash", key).limit(n - below).drop("_hash"))


def split(df: DataFrame, key: str, test: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test), exact and disjoint; keys are unique."""
    held = subset(df.select(key), key, float(test), seed)
    return df.join(held, key, "left_anti"), df.join(held, key, "left_semi")


def epoch_order(df: DataFrame, key: str, seed: int, epoch: Column) -> DataFrame:
    """position of each row in the shuffled order of an epoch, by a hash that needs no global numbering."""
    return df.withColumn("position", F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.col(key))))


def numbered(df: DataFrame, split_on: str, *more: str, name: str = "row", buckets: int = 64) -> DataFrame:
    """Row numbers from 0 in the order of a numeric column, then ``more``.

    Rows are dealt into value ranges, numbered in each, and the sizes of the ranges before are added: no
    partition sorts everything.  The ranges only balance the work, any others give the same numbers.
    """
    cuts = sorted(set(df.approxQuantile(split_on, [i / buckets for i in range(1, buckets)], 0.005)))
    below = F.array(*map(F.lit, cuts)).cast("array<double>")
    spread = df.withColumn("_part", F.size(F.filter(below, lambda x: x < F.col(split_on))))
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most ``buckets`` rows
    before = F.broadcast(sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(split_on, *more))
    return spread.join(before, "_part").withColumn(name, (F.col("_before") + at - 1).cast("long")).drop("_part", "_before")


def contiguous_shards(df: DataFrame, shards: int, split_on: str, *more: str) -> DataFrame:
    """shard 0..shards-1 of contiguous rows in order, the first ones a row longer if need be."""
    small, longer = divmod(df.count(), shards)
    at = F.col("_row")
    shard = F.when(at < longer * (small + 1), F.floor(at / (small + 1))).otherwise(longer + F.floor((at - longer * (small + 1)) / F.lit(max(small, 1))))
    return numbered(df, split_on, *more, name="_row").withColumn("shard", shard.cast("int")).drop("_row")


def bernoulli(p: float, seed: int, salt: str, *key: Column | str) -> Column:
    return uniform(seed, salt, *key) < p
