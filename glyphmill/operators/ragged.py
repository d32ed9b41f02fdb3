"""Ragged sequences as arrays: positions, offsets, two-phase rows, batches; rotary positions and attention within a sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import running


def offsets(lengths: Column) -> Column:
    """[0] and the running sums."""
    return running(lengths.cast("array<bigint>"))


def indices(n: Column, start: Column | int = 0) -> Column:
    first = F.lit(start) if isinstance(start, int) else start
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: (i + first).cast("int"))).otherwise(F.array().cast("array<int>"))


def interleave(prefix: Column, suffix: Column) -> Column:
    return F.concat(prefix, suffix)


def query_positions(prefix: Column, suffix: Column) -> Column:
    return indices(suffix, prefix)


def key_positions(prefix: Column, suffix: Column) -> Column:
    return indices(suffix, prefix + 1)


def suffix_positions(prefix: Column, suffix: Column) -> Column:
    """Positions of a suffix after its prefix."""
    return indices(suffix, prefix)


def logical_prefix(start: Column, prefix: Column) -> Column:
    """Places of a row's prefix in the flat prefixes, where an empty one takes up a place but has none."""
    return indices(prefix, start)


def two_phase(prefix_ids: Column, suffix_ids: Column, aligned: Column, begin: int) -> dict[str, Column]:
    """Ids of both passes: prefix up to its last id, suffix from that one on without its own last; an empty prefix is the begin id, ignored.

    ``prefix_lengths`` is the prefix's length in characters, which are as many as its aligned ids.
    """
    full = F.concat(F.array(F.lit(begin)), prefix_ids)
    n = F.size(full)
    empty = F.size(prefix_ids) == 0
    return {
        "full_prefix_ids": full,
        "prefix_ids": F.when(empty, full).otherwise(F.slice(full, F.lit(1), n - 1)),
        "suffix_ids": F.concat(F.slice(full, n, F.lit(1)), F.slice(suffix_ids, F.lit(1), F.greatest(F.size(suffix_ids) - 1, F.lit(0)))),
        "uncond_target_ids": F.when(empty, F.array(F.lit(-100))).otherwise(aligned),
        "prefix_lengths": F.size(aligned),
    }


def batches(df: DataFrame, order: str, size: int, *columns: str) -> DataFrame:
    """Rows collated into batches of ``size`` in order: of each list column its flat values and offsets, of any other its values."""
    from .sample import numbered

    lists = {c for c, t in df.dtypes if t.startswith("array")}
    df = numbered(df, order, name="_row").withColumn("batch", F.floor(F.col("_row") / size))
    out = df.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("_row", *columns))).alias("r"))

    def made(c: str) -> list[Column]:
        values = F.transform("r", lambda x: x[c])
        name = "" if len(columns) == 1 else f"{c}_"
        if c not in lists:
            return [values.alias(c)]
        return [F.flatten(values).alias(f"{name}values"), offsets(F.transform(values, F.size)).alias(f"{name}offsets")]

    flat = [x for c in columns for x in made(c)]
    return out.select("batch", *flat)


def rotary(dim: int, theta: float = 10000.0) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Cosines and sines of a position: ``dim`` values each, the frequencies twice one after the other."""
    freq = [theta ** (-2 * i / dim) for i in range(dim // 2)] * 2
    angles = lambda position, f: F.transform(F.array(*map(F.lit, freq)), lambda w: f(position * w))
    return lambda p: angles(p, F.cos), lambda p: angles(p, F.sin)


def rotate(x: Column, position: Column, dim: int, theta: float = 10000.0) -> Column:
    """A vector of ``dim`` values turned by its position: pairs are (i, i + dim / 2)."""
    cos, sin = (f(position) for f in rotary(dim, theta))
    half = F.concat(F.transform(F.slice(x, dim // 2 + 1, dim - dim // 2), lambda v: -v), F.slice(x, 1, dim // 2))
    return F.zip_with(F.zip_with(x, cos, lambda a, c: a * c), F.zip_with(half, sin, lambda a, c: a * c), lambda a, b: a + b)


#: Vectors of a sequence whose attention is worked out together, and keys that they meet at once.
QUERIES, KEYS = 4096, 1024


def attend(df: DataFrame, key: str, at: str, q: str, k: str, v: str, causal: bool = True, queries: int = QUERIES, keys: int = KEYS) -> DataFrame:
    """key, at, out: scaled dot-product attention within each sequence of rows (key, at, q, k, v); ``at`` counts from 0 without gaps.

    Blocks of queries meet one tile of keys after the other, with running maxima and sums, so a task holds one block and one
    tile of a sequence of any length.  A sequence's tiles are copied once for each of its blocks that looks at them.
    """
    kinds = dict(df.dtypes)
    pack = lambda *c: F.sort_array(F.collect_list(F.struct(F.col(at).cast("long").alias("at"), *[F.col(x).cast("array<double>").alias(n) for x, n in c]))).alias("r")
    part = lambda n: F.floor(F.col(at) / n).alias("part")
    blocks = df.groupBy(key, part(queries)).agg(pack((q, "x"), (q, "y")))
    tiles = df.groupBy(key, part(keys)).agg(pack((k, "x"), (v, "y")))
    lengths = df.groupBy(key).agg(F.floor(F.max(at) / queries).alias("last"))
    first = F.floor(F.col("part") * keys / queries) if causal else F.lit(0).cast("long")
    copies = tiles.join(lengths, key).select(key, F.explode(F.sequence(first, "last")).alias("block"), "part", "r")
    rows = blocks.select(key, F.col("part").alias("block"), F.lit(-1).cast("long").alias("part"), "r").unionByName(copies)
    rows = rows.repartition(key, "block").sortWithinPartitions(key, "block", "part")

    def vectors(r: pa.Scalar, name: str) -> np.ndarray:
        x = r.values.field(name)
        return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done() -> pa.RecordBatch:
            name, places, _, total, mixed, _ = held
            out = mixed / total[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(places), batch.schema.field(0).type), pa.array(places), lists], [key, at, "out"])

        for batch in batches:
            for i in range(batch.num_rows):
                name, tile, r = batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i]
                places = r.values.field("at").to_numpy(zero_copy_only=False)
                x = vectors(r, "x")
                if tile < 0:
                    if held:
                        yield done()
                    held = (name, places, x / np.sqrt(x.shape[1]), np.zeros(len(x)), None, np.full(len(x), -np.inf))
                    continue
                name, own, scaled, total, mixed, top = held
                y = vectors(r, "y")
                score = scaled @ x.T
                if causal:
                    score[own[:, None] < places[None, :]] = -np.inf
                now = np.maximum(top, score.max(axis=1))
                safe = np.where(np.isfinite(now), now, 0)
                weight = np.exp(score - safe[:, None])
                fade = np.exp(top - safe)
                mixed = (0 if mixed is None else mixed * fade[:, None]) + weight @ y
                held = (name, own, scaled, total * fade + weight.sum(axis=1), mixed, now)
        if held:
            yield done()

    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{at}` long, out array<double>")
