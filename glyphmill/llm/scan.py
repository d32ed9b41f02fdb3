"""Running totals inside groups of any size: a group may span any number of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save

#: Both have an inverse, so that a running total inside a batch gives those of its groups.
STEPS = {"sum": (np.add, np.subtract), "xor": (np.bitwise_xor, np.bitwise_xor)}


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, keys: list[Column], then: list[Column] | None = None) -> DataFrame:
    """Rows in one total order over all tasks, with the task's number (``_part``): by ``keys``, and where those are equal by ``then``.

    Tasks get ranges of ``keys``, so one hot group makes many of them.  Rows that are equal in ``keys`` share a task.
    """
    n = parts_of(rows)
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, *(then or [])).withColumn("_part", F.spark_partition_id())


def running(ordered: DataFrame, group: str, totals: dict[str, str], drop: list[DataFrame] | None = None) -> DataFrame:
    """The rows of ``dealt`` with ``run_<column>``: its total ("sum" or "xor") over the rows of the same group up to this one.

    Each task adds up its own rows and the result is saved; what a task's first group has in the tasks before it
    is worked out from one row for each task, and added.  ``group`` and the columns are of type long, without nulls.
    """
    fields = list(ordered.schema.fields) + [T.StructField(f"run_{c}", T.LongType()) for c in totals] + [T.StructField("_row", T.LongType()), T.StructField("_lead", T.BooleanType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, first, last = 0, None, None
        carried = dict.fromkeys(totals, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group).to_numpy(zero_copy_only=False)
            first = g[0] if first is None else first
            new = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
            since = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            more = []
            for c, kind in totals.items():
                step, back = STEPS[kind]
                total = step.accumulate(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
                out = back(total, np.where(since > 0, total[since - 1], 0))
                out = np.where(since < 0, step(out, np.int64(carried[c])), out)
                carried[c] = int(out[-1])
                more.append(pa.array(out))
            last = g[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(np.arange(row, row + n)), pa.array(g == first)], names)
            row += n

    local = save(ordered.mapInArrow(run, T.StructType(fields)), drop=drop, free=False)
    ends = F.struct("_row", group, *[f"run_{c}" for c in totals])
    tasks = sorted(local.groupBy("_part").agg(F.min(F.struct("_row", group))[group].alias("first"), F.max(ends).alias("last")).collect(), key=lambda r: r["_part"])
    offsets, held, at = [], dict.fromkeys(totals, 0), None
    for r in tasks:
        before = held if r["first"] == at else dict.fromkeys(totals, 0)
        offsets.append((r["_part"], *before.values()))
        own = {c: r["last"][f"run_{c}"] for c in totals}
        held = {c: int(STEPS[kind][0](np.int64(own[c]), np.int64(before[c]))) if r["first"] == r["last"][group] else own[c] for c, kind in totals.items()}
        at = r["last"][group]
    carried = local.sparkSession.createDataFrame(offsets, T.StructType([T.StructField("_part", T.IntegerType()), *[T.StructField(f"_before_{c}", T.LongType()) for c in totals]]))
    out = local.join(F.broadcast(carried), "_part", "left")  # a row for each task
    for c, kind in totals.items():
        before = F.when(F.col("_lead"), F.col(f"_before_{c}")).otherwise(F.lit(0))
        out = out.withColumn(f"run_{c}", F.col(f"run_{c}") + before if kind == "sum" else F.col(f"run_{c}").bitwiseXOR(before))
    out = out.drop("_part", "_row", "_lead", *[f"_before_{c}" for c in totals])
    out._scratch_path = local._scratch_path
    return out
