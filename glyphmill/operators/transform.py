"""Rows for training and validation: the span, its readings with what augments them, and ids of all parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lattice import SLICE, Texts, ranges
from ..functions.profile import IGNORE
from ..sources.mds import read_epoch
from . import augment, vocab

#: What a worker makes of a list column before it gives it back: a string for each list.
Told = Callable[[pa.ListArray], pa.Array]


@dataclass(frozen=True)
class Ids:
    """Vocabularies: characters of targets and of context (single characters each, in one string), readings, and the begin id."""

    target: str
    context: str
    readings: tuple[str, ...]

    @property
    def begin(self) -> int:
        return len(self.context)


def encoded(rows: DataFrame, ids: Ids, *keep: str, told: Told | None = None) -> DataFrame:
    """Six lists of ids and prefix_lengths of rows with prefix, suffix and readings; null has null.

    All lists of characters are made at once for a part of a batch, as in ``ragged.two_phase``.  With ``told`` these five columns are what it makes of
    the lists (a digest), which then never leave the worker.
    """
    lists = ["full_prefix_ids", "prefix_ids", "suffix_ids", "uncond_target_ids", "target_ids"]
    rows = rows.select(*keep, F.transform("readings", lambda r: vocab.known_or_nearest(r, list(ids.readings))).alias("postfix_ids"), "prefix", "suffix")
    kind = T.StringType() if told else T.ArrayType(T.IntegerType())
    passed = rows.schema.fields[:-2]
    fields = [*passed, *(T.StructField(c, kind) for c in lists), T.StructField("prefix_lengths", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, target = vocab.id_table(ids.context), vocab.id_table(ids.target)
        for batch in batches:
            sizes = sum(pa.compute.fill_null(pa.compute.utf8_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("prefix", "suffix"))
            for a, z in ranges(sizes, SLICE):
                part = batch.slice(a, z - a)
                *made, n = id_lists(part.column("prefix"), part.column("suffix"), context, target, ids.begin)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *((told(x) if told else x) for x in made), n], [f.name for f in fields])

    out = rows.mapInArrow(run, T.StructType(fields))
    return out.select(*keep, *lists[:4], "prefix_lengths", "postfix_ids", "target_ids")


def id_lists(prefix: pa.Array, suffix: pa.Array, context: np.ndarray, target: np.ndarray, begin: int) -> list[pa.Array]:
    """full_prefix_ids, prefix_ids, suffix_ids, uncond_target_ids, target_ids and prefix_lengths of texts, by tables of ids over code points."""
    before, after = (Texts(pa.compute.fill_null(x, "")) for x in (prefix, suffix))
    rows = len(prefix)

    def known(t: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = table[np.minimum(t.points, len(table) - 1)]
        here = found >= 0
        return found[here], np.bincount(t.text[here], minlength=rows)

    def led(first: np.ndarray, rest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists with one value more, in front."""
        return np.insert(rest, np.cumsum(n) - n, first).astype(np.int32), n + 1

    def shorter(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists without their last value, if they have one."""
        return np.delete(values, np.cumsum(n)[n > 0] - 1), np.maximum(n - 1, 0)

    def listed(made: tuple[np.ndarray, np.ndarray], *of: pa.Array) -> pa.ListArray:
        null = np.logical_or.reduce([x.is_null().to_numpy(zero_copy_only=False) for x in of])
        offsets = pa.array(np.concatenate([[0], np.cumsum(made[1])]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(made[0].astype(np.int32, copy=False)), mask=pa.array(null) if null.any() else None)

    start = np.full(rows, begin, np.int32)
    own, n = known(before, context)
    full = led(start, own, n)
    none = n == 0
    last = full[0][np.cumsum(full[1]) - 1]
    size = before.ends - before.begins
    aligned = target[np.minimum(before.points, len(target) - 1)]
    aligned[aligned < 0] = IGNORE
    aligned = aligned[~none[before.text]]
    told = np.where(none, 0, size)
    uncond = np.insert(aligned, (np.cumsum(told) - told)[none], IGNORE), np.where(none, 1, size)
    lengths = pa.array(size.astype(np.int32), mask=prefix.is_null().to_numpy(zero_copy_only=False))
    return [
        listed(full, prefix),
        listed(led(start, *shorter(own, n)), prefix),
        listed(led(last, *shorter(*known(after, context))), prefix, suffix),
        listed(uncond, prefix),
        listed(known(after, target), suffix),
        lengths,
    ]


def train(samples: DataFrame, key: str, ids: Ids, frequency: Column, epoch: int = 0, confusion: float = 0.0, strategy: str = "golden", no_context: float = 0.0, forward: float = 0.5, seed: int = 0, firsts: Callable[[Column], Column] | None = None, told: Told | None = None) -> DataFrame:
    """Encoded training rows of samples (key, text_list, labels, and pinyin_list or ``firsts`` of ``augment.suffixes``), a new span and new readings each epoch."""
    rows = augment.suffixes(samples, key, strategy, epoch, no_context, forward, seed, firsts)
    return encoded(augment.confused(rows, key, frequency, confusion, f"{seed}:{epoch}"), ids, key, told=told)


def validation(rows: DataFrame, ids: Ids, *keep: str, told: Told | None = None) -> DataFrame:
    """Encoded rows of what ``augment.prepared`` made."""
    return encoded(rows, ids, *keep, told=told)


def epoch_rows(spark: SparkSession, path: str, key: str, ids: Ids, frequency: Column, epoch: int, skip: int = 0, seed: int = 0, block: int = 1 << 12, tasks: int = 0, **more) -> DataFrame:
    """Training rows of a store of samples in the order of an epoch (``position``), from sample ``skip`` of it on, encoded as they are read."""
    rows = read_epoch(spark, path, epoch, seed, block, skip, tasks)
    lists = {"text_list": "array<string>", "labels": "array<int>", "pinyin_list": "array<string>"}
    samples = rows.select(F.concat_ws("#", key, "position").alias("_key"), *[F.from_json(c, t).alias(c) for c, t in lists.items()])
    made = train(samples, "_key", ids, frequency, epoch, seed=seed, **more)
    named = made.withColumn(key, F.regexp_extract("_key", "(?s)^(.*)#", 1)).withColumn("position", F.regexp_extract("_key", "#([0-9]+)$", 1).cast("long"))
    return named.drop("_key")
