"""Phrases whose words occur together more often than apart, from exact counts of all runs of up to four words."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Rolling, joined, mix, save, slices
from .scan import parts_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 4
LEAST = 30


@dataclass(frozen=True)
class Limits:
    """What a task holds at once; no result depends on it.

    slice: bytes of pieces whose runs are counted before they are dealt; chunk: words of them whose runs are made at once; memory: of one
    bucket's count, beyond which DuckDB uses the task's own disk; bits: the filter of frequent pairs has 2**bits, 8 MB whatever the input.
    """

    slice: int = 4 << 20
    chunk: int = 1 << 18
    memory: str = "256MB"
    bits: int = 26


LIMITS = Limits()
RUNS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int8()), ("w", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """lang (null: ``und``), piece, w: each distinct piece, its words joined by single spaces, and how often it occurs."""
    text = F.regexp_replace(F.translate("text", UPPER, LOWER), "[ \t]+", " ")
    found = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(text, "[ ]?[.,;:!?\n\x0b\f\r][ ]?")).alias("piece"))
    return found.select("lang", F.trim("piece").alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("w"))


def word_ranges(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words of joined pieces, how many words of its piece follow each (itself included), and its piece."""
    gap = raw == 0x20
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1] | np.concatenate([[False], gap[:-1]]))
    end = np.flatnonzero(edge[1:] | np.concatenate([gap[1:], [False]])) + 1
    piece = np.searchsorted(offsets, start, side="right") - 1
    after = np.searchsorted(piece, piece, side="right") - np.arange(len(piece))
    return start, end, after, piece


def pair_slots(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray, bits: int) -> np.ndarray:
    """For each word, the slot in the filter of the pair that it begins (of the last words: of no meaning)."""
    words = Rolling(BYTE_VALUES[raw]).ranges(start, end)
    with np.errstate(over="ignore"):
        return (mix(words[:-1] * np.uint64(3) + np.roll(words, -1)[:-1] + mix(lang[:-1])) >> np.uint64(64 - bits)).astype(np.int64) if len(words) else np.zeros(0, np.int64)


def lang_hashes(langs: pa.Array) -> np.ndarray:
    raw, offsets = joined(langs)
    return Rolling(BYTE_VALUES[raw]).ranges(offsets[:-1], offsets[1:])


def texts_at(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as an array of strings."""
    n = end - start
    offsets = np.concatenate([[0], np.cumsum(n)])
    taken = raw[np.repeat(start - offsets[:-1], n) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.string())


def run_counts(batch: pa.RecordBatch, lengths: tuple[int, ...], frequent: np.ndarray | None, limits: Limits = LIMITS) -> Iterator[pa.Table]:
    """lang, phrase, k, w of the runs of the given lengths in pieces, added up within chunks.

    With ``frequent`` only of runs all of whose pairs have their bit set in it.
    """
    for a, z in slices(batch, "piece", limits.slice):
        part = batch.slice(a, z - a)
        raw, offsets = joined(part.column("piece"))
        start, end, after, piece = word_ranges(raw, offsets)
        weight = part.column("w").to_numpy(zero_copy_only=False)
        lang = part.column("lang")
        last = after
        if frequent is not None and len(start):
            slot = pair_slots(raw, start, end, lang_hashes(lang)[piece], limits.bits)
            good = np.concatenate([(frequent[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1, [False]]) & (after > 1)
            stop = np.flatnonzero(~good)  # the last word of each run of frequent pairs
            last = np.minimum(after, stop[np.searchsorted(stop, np.arange(len(good)))] - np.arange(len(good)) + 1)
        for at in range(0, len(start), limits.chunk):
            tables = []
            for k in lengths:
                i = at + np.flatnonzero(last[at : at + limits.chunk] >= k)
                owner = pa.array(piece[i])
                tables.append(pa.table([lang.take(owner), texts_at(raw, start[i], end[i + k - 1]), pa.array(np.full(len(i), k, np.int8)), pa.array(weight[piece[i]])], schema=RUNS))
            yield pa.concat_tables(tables).group_by(["lang", "phrase", "k"]).aggregate([("w", "sum")]).rename_columns(["lang", "phrase", "k", "w"]).cast(RUNS)


def counted(rows: DataFrame, lengths: tuple[int, ...], least: int, frequent: Broadcast | None = None, limits: Limits = LIMITS) -> DataFrame:
    """lang, phrase, k, f of all runs of the given lengths that occur at least ``least`` times.

    Runs are dealt to buckets by hash, in compressed blocks; DuckDB adds up one bucket at a time, and spills
    beyond its memory to a folder of the task that goes with it.
    """
    n = parts_of(rows)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in run_counts(batch, lengths, frequent and frequent.value, limits):
                raw, offsets = joined(table.column("phrase").combine_chunks())
                bucket = (Rolling(BYTE_VALUES[raw]).ranges(offsets[:-1], offsets[1:]) % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                table = table.take(pa.array(order)).combine_chunks()
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
                packed = []
                for a, z in zip(cuts[:-1], cuts[1:]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, RUNS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(table.slice(a, z - a))
                    packed.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts[:-1]]), pa.array(packed, pa.binary())], ["bucket", "block"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = (b for batch in batches for block in batch.column("block") for b in pa.ipc.open_stream(block.as_buffer()))
        with tempfile.TemporaryDirectory(dir=SparkFiles.getRootDirectory()) as spill, duckdb.connect(config={"threads": 1, "memory_limit": limits.memory, "temp_directory": spill, "preserve_insertion_order": False}) as db:
            runs = pa.RecordBatchReader.from_batches(RUNS, unpacked)  # noqa: F841  read by its name
            found = db.sql(f"SELECT lang, phrase, k::INTEGER AS k, sum(w)::BIGINT AS f FROM runs GROUP BY ALL HAVING sum(w) >= {least}")
            yield from found.to_arrow_reader(100_000)

    dealt = rows.mapInArrow(blocks, "bucket long, block binary").repartition(n, "bucket")
    return save(dealt.mapInArrow(added, "lang string, phrase string, k int, f long"), free=False)


def pair_filter(pairs: DataFrame, bits: int) -> np.ndarray:
    """Bits of the frequent pairs (lang, phrase): 2**bits of them, whatever their number.  Pairs that share a bit only cost work."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = joined(batch.column("phrase"))
            start, end, after, piece = word_ranges(raw, offsets)
            slot = np.unique(pair_slots(raw, start, end, lang_hashes(batch.column("lang"))[piece], bits)[::2])
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.int64(1), slot & 63))], ["word", "bits"])

    words = pairs.select("lang", "phrase").mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def frequent_runs(rows: DataFrame, least: int = LEAST, limits: Limits = LIMITS) -> DataFrame:
    """lang, phrase, k, f of all runs of one to four words that occur at least ``least`` times in ``pieces``.

    A run is no more frequent than any pair in it, so longer runs are counted only where all pairs may be frequent.
    """
    short = counted(rows, (1, 2), least, limits=limits)
    frequent = rows.sparkSession.sparkContext.broadcast(pair_filter(short.where("k = 2"), limits.bits))
    return short.unionByName(counted(rows, tuple(range(3, LONGEST + 1)), least, frequent, limits))


def words_from(start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice("ws", start, n), " ")


def scored(runs: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates: the cut with the lowest score, and of equal ones the first.

    Each cut asks for the counts of its two parts; requests and counts meet by (lang, part) in one shuffle.
    """
    asked = runs.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("ws"))
    asked = asked.select("lang", "phrase", "a", "k", "ws", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), words_from(1, F.col("cut")).alias("part")), F.struct(F.lit("r").alias("side"), words_from(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part"))))
    asked = asked.select("lang", "phrase", "a", "cut", sides.alias("x")).select("lang", "phrase", "a", "cut", "x.side", "x.part")
    told = asked.join(runs.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    values = [F.max(F.when((F.col("cut") == c) & (F.col("side") == side), F.col("f"))).alias(f"{side}{c}") for c in range(1, LONGEST) for side in "lr"]
    found = told.groupBy("lang", "phrase", "a").agg(*values)
    cuts = [F.when(F.col(f"l{c}").isNotNull(), F.struct(F.expr(f"CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l{c} AS DECIMAL(19,0)) + r{c})").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, LONGEST)]
    return found.select("lang", "phrase", "a", F.array_min(F.array(*cuts)).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def outer_counts(runs: DataFrame) -> DataFrame:
    """lang, phrase, longer: the count of the most frequent candidate that holds a phrase and is longer."""
    long = runs.where("k >= 3").select("lang", "f", "k", F.split("phrase", " ").alias("ws"))
    sized = long.select("lang", "f", "k", "ws", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = sized.select("lang", "f", "m", "ws", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("at"))
    return inner.groupBy("lang", words_from(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = 2000, limits: Limits = LIMITS) -> DataFrame:
    """The best phrases of each lang: lang, rank (from 1), phrase, a, l, r, n, score.

    Phrases have two to four words inside a piece and occur a >= ``least`` times; n counts all words of the lang.  The
    score is floor(2,000,000 a / (l + r)) at the worst cut into parts that occur l and r times, in exact decimals.
    Phrases that a longer one with at least 80 % of their occurrences holds are left out.  Ties go by a, then phrase.
    Null text is empty, null lang ``und``; repeated rows count again, a text of any length is cut into runs by chunks,
    other columns are not looked at, and where there is no candidate there is no row.
    """
    rows = save(pieces(docs))
    words = F.length("piece") - F.length(F.translate("piece", " ", "")) + 1
    totals = rows.groupBy("lang").agg(F.sum(F.col("w") * words).alias("n"))
    runs = frequent_runs(rows, least, limits)
    kept = scored(runs).join(outer_counts(runs), ["lang", "phrase"], "left")
    kept = kept.where("longer IS NULL OR 100 * CAST(longer AS DECIMAL(19,0)) < 80 * CAST(a AS DECIMAL(19,0))")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
