"""Shards of near equal size: groups that must stay together, the largest first, each to the least-loaded shard."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, scratch_root
from .scan import dealt

SHARDS = 24
#: A group of at least this part of a shard's mean size is a unit of its own, so there are at most SHARDS * UNITS of them.
UNITS = 1000
#: Smaller groups are put together by hash to this many units for each shard.
BUNDLES = 250
#: Bytes that each document counts besides its text.
OVERHEAD = 8


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus the overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def group_of(text: str = "text") -> Column:
    """Equal texts have equal groups (null: as empty).  Should two texts share a hash, they stay together too, which breaks nothing."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def longest_first(units: list[tuple[int, int, bool]], shards: int) -> list[int]:
    """The shard of each (bytes, key, whole): the largest first, to the least-loaded shard; ties to the smallest key and shard."""
    load = [(0, s) for s in range(shards)]
    out = [0] * len(units)
    for i in sorted(range(len(units)), key=lambda i: (-units[i][0], units[i][2], units[i][1])):
        total, shard = heapq.heappop(load)
        out[i] = shard
        heapq.heappush(load, (total + units[i][0], shard))
    return out


def schedule(rows: DataFrame, shards: int = SHARDS, units: int = UNITS, bundles: int = BUNDLES) -> DataFrame:
    """key, whole, shard: where each unit of rows (grp, size) goes.

    A unit is a whole group or, of groups below 1/units of a shard's mean, all that share a hash.  So the driver
    schedules at most shards * (units + bundles) of them, whatever the input, and the fullest shard exceeds the
    emptiest by one unit at most (unless one group alone exceeds the mean).
    """
    groups = save(rows.groupBy("grp").agg(F.sum("size").alias("bytes")), free=False)
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    whole = F.col("bytes") * shards * units >= total
    key = F.when(whole, F.col("grp")).otherwise(bundle_of(shards * bundles))
    found = groups.select(whole.alias("whole"), key.alias("key"), "bytes").groupBy("key", "whole").agg(F.sum("bytes").alias("bytes")).collect()
    found = [(r["bytes"], r["key"], r["whole"]) for r in found]
    placed = [(k, w, s) for (_, k, w), s in zip(found, longest_first(found, shards))]
    return rows.sparkSession.createDataFrame(placed, "key long, whole boolean, shard int")


def bundle_of(n: int) -> Column:
    return F.pmod(F.xxhash64("grp", F.lit(n)), F.lit(n))


def with_shard(rows: DataFrame, placed: DataFrame, shards: int, bundles: int) -> DataFrame:
    """rows (grp, ...) with shard: that of the group itself, or that of its bundle.  ``placed`` has a bounded number of rows."""
    own = placed.where("whole").select(F.col("key").alias("grp"), F.col("shard").alias("_own"))
    shared = placed.where("NOT whole").select(F.col("key").alias("_bundle"), F.col("shard").alias("_shared"))
    out = rows.join(F.broadcast(own), "grp", "left").withColumn("_bundle", bundle_of(shards * bundles)).join(F.broadcast(shared), "_bundle", "left")
    return out.withColumn("shard", F.coalesce("_own", "_shared")).drop("_own", "_shared", "_bundle")


def write_shards(docs: DataFrame, shards: int = SHARDS, path: str | None = None, units: int = UNITS, bundles: int = BUNDLES) -> str:
    """Write documents (doc_id, text, ...) as Parquet, a folder for each shard; gives the path.

    Sizes of shards (``size_of``) are near equal, and equal texts are in one shard.  A file's rows have all columns
    of docs in ``doc``, with grp, size, part and place: rows of a shard are ordered by part, then place, which is the
    order of (doc_id, null first, then the text's hash).  ``manifest`` beside the folders has where each part begins.

    Null texts are as empty ones, repeated rows are rows of their own, a text of any length is one row, and the
    columns of docs can't clash with the writer's own.  No documents, no shards.  A shard is written by as many tasks as its
    bytes need, so a group that holds a third of all rows is no hot spot, but it is whole in its shard.
    """
    spark = docs.sparkSession
    path = path or f"{scratch_root(spark)}/glyphmill-{uuid.uuid4().hex}"
    sized = docs.select(group_of().alias("grp"), size_of().alias("size"))
    placed = save(schedule(sized, shards, units, bundles), free=False)
    rows = docs.select(group_of().alias("grp"), size_of().alias("size"), F.struct("*").alias("doc"))
    tie = F.monotonically_increasing_id()  # between equal rows, so that many copies of one row are many tasks
    rows = with_shard(rows, placed, shards, bundles).withColumn("_tie", tie)
    rows = dealt(rows, [F.col("shard"), F.asc_nulls_first("doc.doc_id"), F.col("grp"), F.col("_tie")])
    numbered(rows.select("shard", F.col("_part").alias("part"), "grp", "size", "doc")).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/data")
    parts = spark.read.parquet(f"{path}/data").groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes")) if has_data(spark, path) else spark.createDataFrame([], "shard int, part int, n_rows long, n_bytes long")
    first, found = {}, []
    for r in sorted(parts.collect(), key=lambda r: (r["shard"], r["part"])):  # a row for each task and shard
        found.append((*r, first.get(r["shard"], 0)))
        first[r["shard"]] = found[-1][-1] + r["n_rows"]
    spark.createDataFrame(found, "shard int, part int, n_rows long, n_bytes long, first_slot long").coalesce(1).write.parquet(f"{path}/manifest")
    return path


def numbered(rows: DataFrame) -> DataFrame:
    """Adds place: the row's number among those of its shard in this task.  The rows come in order of shard."""
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, n = None, 0
        for batch in batches:
            places = []
            for s in batch.column("shard").to_pylist():
                shard, n = s, n + 1 if s == shard else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"])

    return rows.mapInArrow(run, schema)


def has_data(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/shard=*")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc (all columns of the document), size, shard, and slot: the row's number in its shard, from 0 without gaps."""
    if not has_data(spark, path):
        return spark.createDataFrame([], "doc struct<doc_id: long, text: string>, size long, shard int, slot long")
    rows = spark.read.parquet(f"{path}/data").withColumn("shard", F.col("shard").cast("int"))
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "part", "first_slot")
    return rows.join(manifest, ["shard", "part"]).select("doc", "size", "shard", (F.col("first_slot") + F.col("place")).alias("slot"))
