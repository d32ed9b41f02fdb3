"""Shards of samples in the MDS layout (format version 2): zstd files and an ``index.json`` that lists them.

It is a Spark data source, ``mds``: shards appear when a write commits, and reading goes by epochs that can be resumed.

A shard is the number of samples, the offsets of all samples, a JSON header, and the samples; a sample is the
sizes of its columns, then their bytes.  Workers write through Arrow's file systems, so the path can be a store.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# The layout's limit of a shard, version and index name.
SIZE_LIMIT = 268_435_456
VERSION = 2
INDEX = "index.json"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(columns: list[str], limit: int) -> dict:
    return {"column_encodings": ["str"] * len(columns), "column_names": columns, "column_sizes": [None] * len(columns), "compression": "zstd", "format": "mds", "hashes": [], "size_limit": limit, "version": VERSION}


def pack(samples: list[bytes], head: dict) -> bytes:
    text = json.dumps(head, sort_keys=True).encode()
    sizes = np.array([0, *map(len, samples)], dtype=np.uint64)
    offsets = (np.cumsum(sizes) + 4 + 4 * len(sizes) + len(text)).astype("<u4")
    return np.array([len(samples)], "<u4").tobytes() + offsets.tobytes() + text + b"".join(samples)


def unpack(raw: bytes, n_columns: int, numbers: list[int]) -> list[list[str]]:
    """The samples of these numbers."""
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    offsets = np.frombuffer(raw, "<u4", n + 1, 4)
    out = []
    for a in offsets[numbers].tolist():
        sizes = np.frombuffer(raw, "<u4", n_columns, a).tolist()
        a += 4 * n_columns
        row = []
        for size in sizes:
            row.append(raw[a : a + size].decode())
            a += size
        out.append(row)
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """A path as all machines know it: one without a scheme is on Spark's default file system, not on each worker's disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def read_index(path: str) -> dict:
    store, root = open_store(path)
    with store.open_input_stream(f"{root}/{INDEX}") as f:
        index = json.loads(f.read())
    if index.get("version") != VERSION:
        raise ValueError(f"unknown version: {index.get('version')}")
    if not index["shards"]:
        raise ValueError(f"no shard in {path}")
    return index


@dataclass
class Written(WriterCommitMessage):
    """The shards of one task: name, samples, bytes, compressed bytes."""

    shards: list[tuple[str, int, int, int]]


class MdsWriter(DataSourceArrowWriter):
    """Tasks write shards into a folder of the job beside the target; commit moves them and writes the index, abort removes the folder.

    A task that fails or runs twice leaves nothing, as only shards that are told of at the end are moved.
    """

    def __init__(self, path: str, columns: list[str], limit: int, overwrite: bool) -> None:
        self.path, self.columns, self.limit, self.overwrite = path, columns, limit, overwrite
        self.part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.part)
        store.create_dir(root, recursive=True)
        head = header(self.columns, self.limit)
        context = TaskContext.get()
        task = f"{context.partitionId():05}-{context.attemptNumber()}"
        made: list[tuple[str, int, int, int]] = []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            raw = pack(held, head)
            packed = pa.compress(raw, codec="zstd", asbytes=True)
            name = f"{task}-{len(made):05}"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(packed)
            made.append((name, len(held), len(raw), len(packed)))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in self.columns), strict=True):
                data = [(x or "").encode() for x in row]
                sample = np.array([len(x) for x in data], "<u4").tobytes() + b"".join(data)
                if held and size + len(sample) > self.limit:
                    flush()
                    size = 0
                held.append(sample)
                size += len(sample) + 4
        if held:
            flush()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        _, part = open_store(self.part)
        there = store.get_file_info(f"{root}/{INDEX}").type != fs.FileType.NotFound
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        if there:
            store.delete_dir_contents(root)
        store.create_dir(root, recursive=True)
        shards = []
        head = header(self.columns, self.limit)
        for number, (name, n, size, zipped) in enumerate(sorted(x for m in messages if m for x in m.shards)):
            own = f"shard.{number:05}.mds"
            store.move(f"{part}/{name}", f"{root}/{own}.zstd")
            shards.append(head | {"raw_data": {"basename": own, "bytes": size, "hashes": {}}, "samples": n, "zip_data": {"basename": f"{own}.zstd", "bytes": zipped, "hashes": {}}})
        with store.open_output_stream(f"{root}/{INDEX}") as f:
            f.write(json.dumps({"shards": shards, "version": VERSION}, sort_keys=True).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove the job's folder, with what failed tasks have left in it."""
        store, part = open_store(self.part)
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_dir(part)


@dataclass
class Blocks(InputPartition):
    """Blocks in the order in which they are read: shard, its size, its first sample's number, the block's first and last sample in it, its place in the epoch, and samples of it to leave out."""

    blocks: list[tuple[str, int, int, int, int, int, int]]


def draw(*words: object) -> int:
    return int(hashlib.md5(":".join(map(str, words)).encode()).hexdigest()[:15], 16)


def epoch_plan(shards: list[dict], seed: int, epoch: int | None, block: int, skip: int) -> list[tuple[str, int, int, int, int, int, int]]:
    """The blocks of an epoch in order, without those of the first ``skip`` samples.  Without an epoch: in the order of the index."""
    blocks, first = [], 0
    for s in shards:
        name, size = s["zip_data"]["basename"], s["raw_data"]["bytes"]
        blocks += [(name, size, first, a, min(a + block, s["samples"])) for a in range(0, s["samples"], block)]
        first += s["samples"]
    if epoch is not None:
        blocks.sort(key=lambda b: (draw(seed, epoch, "block", b[2] + b[3]), b[2] + b[3]))
    out, place = [], 0
    for b in blocks:
        n = b[4] - b[3]
        if place + n > skip:
            out.append((*b, place, max(0, skip - place)))
        place += n
    return out


class MdsReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], seed: int, epoch: int | None, block: int, skip: int, tasks: int) -> None:
        self.path, self.columns, self.seed, self.epoch, self.block, self.skip, self.tasks = path, columns, seed, epoch, block, skip, tasks

    def partitions(self) -> list[Blocks]:
        """As many tasks as are asked for, or one for each shard; a task has blocks that follow each other in the epoch."""
        shards = read_index(self.path)["shards"]
        plan = epoch_plan(shards, self.seed, self.epoch, self.block, self.skip)
        n = max(1, min(len(plan), self.tasks or len(shards)))
        cuts = [len(plan) * i // n for i in range(n + 1)]
        return [Blocks(plan[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        last, rows = None, []
        for name, size, first, a, z, place, gone in partition.blocks:
            if name != last:
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    raw = pa.decompress(f.read(), size, codec="zstd", asbytes=True)
                last = name
            order = list(range(a, z))
            if self.epoch is not None:
                order.sort(key=lambda i: (draw(self.seed, self.epoch, "sample", first + i), i))
            rows = unpack(raw, len(self.columns), order[gone:])
            numbers = [pa.array([place + gone + i for i in range(len(rows))], pa.int64()), pa.array([first + i for i in order[gone:]], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.string()) for i in range(len(self.columns))), *numbers], [*self.columns, "position", "sample"])


class MdsSource(DataSource):
    """``spark.read.format("mds")`` and ``df.write.format("mds")``.

    Reading: all columns, and position (in the epoch) and sample (number in the store).  Options: path; epoch and seed (shuffled: blocks
    of ``block`` samples in an order of the epoch's own, samples shuffled in each), skip (samples that have been read
    already), tasks.  Writing: string columns; limit is the largest shard.
    """

    @classmethod
    def name(cls) -> str:
        return "mds"

    def schema(self) -> str:
        columns = read_index(self.options["path"])["shards"][0]["column_names"]
        return ", ".join([*(f"`{c}` string" for c in columns), "position long", "sample long"])

    def reader(self, schema: StructType) -> MdsReader:
        o = self.options
        columns = [f.name for f in schema.fields if f.name not in ("position", "sample")]
        epoch = int(o["epoch"]) if "epoch" in o else None
        return MdsReader(o["path"], columns, int(o.get("seed", 0)), epoch, int(o.get("block", 1 << 12)), int(o.get("skip", 0)), int(o.get("tasks", 0)))

    def writer(self, schema: StructType, overwrite: bool) -> MdsWriter:
        return MdsWriter(self.options["path"], sorted(schema.names), int(self.options.get("limit", SIZE_LIMIT)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MdsSource)


def write_mds(df: DataFrame, path: str, limit: int = SIZE_LIMIT) -> int:
    """Write string columns (others as JSON are the caller's choice) and the index; returns the number of shards.  Never over a store that is there."""
    spark = df.sparkSession
    register(spark)
    path = qualified(spark, path)
    store, root = open_store(path)
    if store.get_file_info(f"{root}/{INDEX}").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    df.write.format("mds").mode("append").option("path", path).option("limit", limit).save()
    with store.open_input_stream(f"{root}/{INDEX}") as f:
        return len(json.loads(f.read())["shards"])


def read_epoch(spark: SparkSession, path: str, epoch: int | None = None, seed: int = 0, block: int = 1 << 12, skip: int = 0, tasks: int = 0) -> DataFrame:
    """The samples of a store from number ``skip`` of an epoch on, with position and sample; without an epoch, in the order of the index."""
    register(spark)
    rows = spark.read.format("mds").option("path", qualified(spark, path)).option("seed", seed).option("block", block).option("skip", skip).option("tasks", tasks)
    return (rows if epoch is None else rows.option("epoch", epoch)).load()


def read_mds(spark: SparkSession, path: str) -> DataFrame:
    """The samples of all shards of the index."""
    return read_epoch(spark, path).drop("position", "sample")
