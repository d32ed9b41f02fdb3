"""Helpers shared by the training-data operators: scratch tables, documents, hashing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of all word-based operators: a maximal run of bytes outside ASCII white space.
SPACE_CLASS = r"[ \t-\r]+"
#: Bytes that a worker turns into numpy arrays at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of rows that a task holds to send them to its Python worker; ten thousand long texts can be many times that.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(scratch_root, "own", None) or tempfile.mkdtemp(prefix="glyphmill-")
        scratch_root.own = root
    return root


def save(df: DataFrame, *, drop: list[DataFrame] | None = None, free: bool = True) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there.

    Frames of ``drop`` are earlier results of this function that are needed no longer.  ``free``: shuffle files of
    frames that are gone are removed too, which takes a garbage collection; not worth it for small frames.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/glyphmill-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for old in drop or []:
        discard(old)
    if free:
        release(spark)
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it batches for Python workers hold ``BATCH_BYTES`` at most (one longer row is a batch of its own), or what the session has set if that is less."""
    before = spark.conf.get(BATCH)
    keep_small_batches(spark)
    try:
        yield
    finally:
        if spark.conf.get(BATCH) != before:
            spark.conf.set(BATCH, before)


def keep_small_batches(spark: SparkSession) -> None:
    """As ``small_batches``, from now on in this session: for frames that another writes."""
    before = spark.conf.get(BATCH).lower().removesuffix("b")
    if not (before.isdigit() and 0 < int(before) <= BATCH_BYTES):
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


#: What this worker made for tasks of one operator and has for the next of its tasks.
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once for a worker; a worker keeps one such thing, that of the operator it last ran a task of."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go what was kept for other operators."""
    _KEPT.clear()


_LIBC = ctypes.CDLL(None)


def let_go() -> None:
    """Give memory back that is free: Arrow and the C library hold what a batch took, and an executor has several workers, idle ones too."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc
        _LIBC.malloc_trim(0)


#: A function for mapInArrow.
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Run, keeps: bool = False) -> Run:
    """``run`` in a worker that holds what this operator needs and no more: nothing of other operators (unless it ``keeps`` its own), and after each batch of rows no free memory."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        yield from run(leaving(batches))
        let_go()

    return lean_run


def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, free memory is given back."""
    for batch in batches:
        yield batch
        del batch
        let_go()


def discard(df: DataFrame) -> None:
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of frames that are gone."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batch: pa.RecordBatch | pa.Table, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about ``limit`` bytes together."""
    sizes = batch.column(column).cast(pa.large_binary())
    lens = np.asarray(pa.compute.fill_null(pa.compute.binary_length(sizes), 0), dtype=np.int64)
    at = total = 0
    for i, n in enumerate(lens):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lens):
        yield at, len(lens)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random odd multiplier and a random 64-bit value for each byte.
BASE = np.uint64(int(_RNG.integers(1 << 62)) * 4 + 1)
BYTE_VALUES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """The first n powers of BASE ("up") or of its inverse modulo 2**64 ("down")."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            p = np.full(size, BASE if kind == "up" else INVERSE, dtype=np.uint64)
            p[0] = 1
            have = np.multiply.accumulate(p)
        if size <= 1 << 22:
            _POWERS[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any range of a sequence of 64-bit values, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers("up", n), out=self.sums[1:])
        self.down = powers("down", n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Hash of each run of k values."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1] + np.uint64(k))


#: ASCII white space.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all words of joined texts, and for each text its first word's number (one more than texts)."""
    n = len(raw)
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = ~space[raw]
    first = inside[:n].copy()
    first[1:] &= ~inside[: n - 1] if n else first[1:]
    cuts = offsets[:-1][(offsets[:-1] < n)]
    first[cuts] = inside[cuts]
    last = inside[:n].copy()
    last &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[raw]).ranges(start, end)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", "text", *more)


def lead_key(column: str = "doc_id"):
    """A total order in which null comes first."""
    return F.col(column).asc_nulls_first()
