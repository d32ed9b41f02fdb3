"""Segments of texts: runs of one class, long runs dropped, windows, spans."""

from __future__ import annotations

import hashlib
import re
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lattice import SLICE, Phrases, Texts, ranges, read, text_slices, word_starts
from ..functions.lexicon import DROPPED, flat, nested_of
from ..functions.profile import LATIN, OTHER, PAUSE, TARGET, Profile
from ..functions.text import ratio


def runs(text: Column, p: Profile = LATIN) -> Column:
    """Maximal runs of target, pause and other characters; nothing is lost, nothing is shuffled."""
    return F.regexp_extract_all(text, F.lit(runs_pattern(p)), F.lit(1))


def runs_pattern(p: Profile) -> str:
    """Other characters are those at which neither class matches: a negated class is matched several times slower."""
    return f"([{p.target}]+|[{p.pause}]+|(?s:(?![{p.target}{p.pause}]).)+)"


SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.IntegerType())]))


#: Segments of rows that a worker takes up at once.
SEGMENTS_AT_ONCE = 1 << 18
#: Bytes of distinct runs that a worker holds.
RUN_BYTES = 1 << 25


def class_pattern(chars: str) -> re.Pattern:
    """A regex class of a profile, as Python writes it."""
    plain = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", chars)
    return re.compile(f"[{plain}]")


def eligible_rows(t: Texts, p: Profile, least_ratio: float) -> np.ndarray:
    """Which texts ``eligible`` keeps."""
    here = np.flatnonzero(np.bincount(t.points))
    counted = np.zeros(int(here.max(initial=0)) + 1, dtype=bool)
    pattern = class_pattern(p.ratio)
    counted[here] = [bool(pattern.match(chr(c))) for c in here.tolist()]
    size = t.ends - t.begins
    found = np.bincount(t.text[counted[t.points]], minlength=len(size))
    return (size > 1) & (found / np.maximum(size, 1) >= least_ratio)


def char_labels(points: np.ndarray, p: Profile) -> np.ndarray:
    """The label of each code point; pause wins over target.  Classes are asked once for each distinct one."""
    here = np.flatnonzero(np.bincount(points))
    pause, target = class_pattern(p.pause), class_pattern(p.target)
    kind = np.full(int(here.max(initial=0)) + 1, OTHER, dtype=np.int32)
    kind[here] = [PAUSE if pause.match(chr(c)) else TARGET if target.match(chr(c)) else OTHER for c in here.tolist()]
    return kind[points]


def letters(p: Profile = LATIN) -> list[str]:
    """All target characters of a script."""
    return [chr(c) for c in np.flatnonzero(char_labels(np.arange(sys.maxunicode + 1), p) == TARGET).tolist()]


def target_runs(texts: pa.Array, p: Profile) -> pa.Array:
    """The distinct target runs of texts."""
    t = Texts(texts)
    target = char_labels(t.points, p) == TARGET
    first = np.ones(len(target), dtype=bool)
    first[1:] = target[1:] != target[:-1]
    first[t.begins[t.begins < t.ends]] = True
    starts = np.flatnonzero(first)
    return t.pieces(starts).filter(pa.array(target[starts])).unique()


def distinct_runs(texts: DataFrame, text: str, run: str = "run", p: Profile = LATIN) -> DataFrame:
    """The distinct target runs of a table's texts.

    A task gives a run once, or once for each ``RUN_BYTES`` of distinct ones, so that neither a row nor a hash entry is made for each
    occurrence, and a worker holds no more than that and a part.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            filled = pa.compute.fill_null(batch.column(0), "")
            for a, z in text_slices(filled, SLICE):
                held.append(target_runs(filled.slice(a, z - a), p))
                size += held[-1].nbytes
                if size > RUN_BYTES:
                    held = [pa.concat_arrays(held).unique()]
                    size = held[0].nbytes
                if size > RUN_BYTES // 2 and len(held) == 1:
                    yield pa.RecordBatch.from_arrays(held, [run])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(held).unique()], [run])

    return texts.select(text).mapInArrow(cut, T.StructType([T.StructField(run, T.StringType())])).distinct()


def cut_texts(texts: pa.Array, p: Profile, by_char: bool, longest_other: int, words: Phrases | None, least_ratio: float | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How many segments each text has, and their texts and labels; with ``least_ratio`` those that are not eligible have none."""
    t = Texts(texts)
    n = len(t.points)
    label = char_labels(t.points, p)
    first = np.ones(n, dtype=bool)
    first[1:] = label[1:] != label[:-1]
    first[t.begins[t.begins < t.ends]] = True
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, n))
    if by_char:
        first |= label == TARGET
    elif words is not None:
        target = label[starts] == TARGET
        runs_ = t.within(starts[target], (starts + size)[target], np.repeat(starts + size, size))
        first[word_starts(runs_, words)] = True
    dropped = np.repeat((label[starts] == OTHER) & (size > longest_other), size)
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], n)
    ends = np.where(label[starts] == PAUSE, starts + 1, ends)
    kept = ~dropped[starts]
    if least_ratio is not None:
        kept &= eligible_rows(t, p, least_ratio)[t.text[starts]]
    starts, ends = starts[kept], ends[kept]
    return np.bincount(t.text[starts], minlength=len(texts)), t.ranges(starts, ends), label[starts]


def segments(text: Column, p: Profile = LATIN, mode: str = "word", longest_other: int = 16, words: Phrases | None = None) -> Column:
    """array<struct<text,label>>: pause runs as their first mark, other runs above ``longest_other`` dropped, words or characters.

    Words are whole target runs (mode char: their characters), or with a lexicon (``lattice.word_book``) those of each run's likeliest cut.
    Parts of Arrow batches are cut at once, and given back part by part, so that a worker holds the segments of one part: the built-in
    functions on lists ask each run's class by itself.
    """
    if mode not in ("word", "char"):
        raise ValueError(f"unknown mode: {mode}")

    @F.arrow_udf(SEGMENTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            filled = pa.compute.fill_null(texts, "")
            for a, z in text_slices(filled, SLICE):
                part = texts.slice(a, z - a)
                n, piece, label = cut_texts(filled.slice(a, z - a), p, mode == "char", longest_other, words)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                made = pa.StructArray.from_arrays([piece, pa.array(label)], ["text", "label"])
                yield pa.ListArray.from_arrays(offsets, made, mask=pa.compute.is_null(part) if part.null_count else None)

    return run(text)


def with_readings(segs: Column, reader: Callable[[Column], Column]) -> Column:
    """Segments with a list of readings for each character of target ones; other segments have none."""
    none = F.array().cast("array<array<string>>")
    return F.transform(segs, lambda s: F.struct(s["text"].alias("text"), s["label"].alias("label"), F.when(s["label"] == TARGET, reader(s["text"])).otherwise(none).alias("readings")))


def with_read_words(segs: Column, table: Phrases) -> Column:
    """Segments with readings from a table of phrases and characters (``lattice.phrase_book``), each word read as a whole.

    Characters without any reading go, and target segments of which nothing is left.
    """
    empty = F.array().cast("array<string>")
    told = read(F.transform(segs, lambda s: F.when(s["label"] == TARGET, s["text"]).otherwise("")), table)
    both = F.arrays_zip(segs.alias("s"), told.alias("r"))

    def one(x: Column) -> Column:
        own = F.transform(x["r"]["own"], lambda r: F.array_remove(F.coalesce(r, empty), DROPPED))
        left = F.filter(F.arrays_zip(F.filter(F.split(x["s"]["text"], ""), lambda c: c != "").alias("c"), own.alias("o")), lambda z: F.size(z["o"]) > 0)
        shown = F.when(x["s"]["label"] == TARGET, F.array_join(F.transform(left, lambda z: z["c"]), "")).otherwise(x["s"]["text"])
        return F.struct(shown.alias("text"), x["s"]["label"].alias("label"), nested_of(F.filter(x["r"]["best"], lambda b: b.isNotNull()), own).alias("readings"))

    return F.filter(F.transform(both, one), lambda s: s["text"] != "")


def by_letter(segs: Column) -> Column:
    """Segments with readings, target ones cut into characters that keep the readings they have in their word."""
    none = F.array().cast("array<string>")

    def letters(s: Column) -> Column:
        pairs = F.arrays_zip(F.filter(F.split(s["text"], ""), lambda c: c != "").alias("c"), s["readings"].alias("r"))
        return F.transform(pairs, lambda z: F.struct(z["c"].alias("text"), s["label"].alias("label"), F.array(F.coalesce(z["r"], none)).alias("readings")))

    return F.flatten(F.transform(segs, lambda s: F.when(s["label"] == TARGET, letters(s)).otherwise(F.array(s))))


def eligible(df: DataFrame, p: Profile = LATIN, least_ratio: float = 0.5) -> DataFrame:
    """Texts of two characters or more with enough characters of the ratio class."""
    return df.where(F.length("text") > 1).where(ratio(F.col("text"), p) >= least_ratio)


@dataclass(frozen=True)
class Cut:
    """How long windows are: at least a drawn number of characters from ``shortest`` to ``longest``, then on to a boundary.

    Up to ``soft`` characters a boundary is a pause after a target segment, beyond it any segment but a target after one.
    Windows that would grow beyond ``hard`` are dropped.
    """

    seed: int = 0
    shortest: int = 16
    longest: int = 64
    soft: int = 72
    hard: int = 96

    def draw(self, key: object, i: int) -> int:
        """The same as ``rng.integer`` of the salt "trunc" and the key ``key:i``."""
        u = int(hashlib.md5(f"{self.seed}:trunc:{key}:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        return self.shortest + int(u * (self.longest - self.shortest + 1))


def following(mask: np.ndarray) -> np.ndarray:
    """For each place the first true one from it on, the length if there is none; one entry more than places."""
    n = len(mask)
    at = np.append(np.where(mask, np.arange(n), n), n)
    return np.minimum.accumulate(at[::-1])[::-1]


def window_bounds(lengths: np.ndarray, labels: np.ndarray, draw: Callable[[int], int], cut: Cut) -> list[tuple[int, int]]:
    """Windows [i, j) of the segments of one text; lengths are 1 at least.

    Where a window from i ends follows from prefix sums alone: ``reach(x)`` is the first segment with x characters from i before
    it.  The window may stop at pauses from reach(drawn) to reach(soft + 1) - 1, at all boundaries from there
    to reach(hard + 1) - 1, and no later.
    """
    n = len(lengths)
    upto = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    after_target = np.zeros(n, dtype=bool)
    after_target[1:] = labels[:-1] == TARGET
    pause, other = (following(after_target & m).tolist() for m in (labels == PAUSE, labels != TARGET))
    out, i = [], 0
    while i < n:
        reach = lambda x, i=i: bisect_left(upto, upto[i] + x, i)
        first = min(reach(draw(i)), n)
        if upto[first] - upto[i] > cut.hard:
            i = first
            continue
        longer, dropped = (max(first, reach(x + 1) - 1) for x in (cut.soft, max(cut.soft, cut.hard)))
        end = pause[first]
        if end >= longer:
            end = other[min(longer, n)]
        if end < min(dropped, n):
            out.append((i, end))
            i = end + 1 if labels[end] == PAUSE else end
        elif dropped < n:
            i = dropped
        else:
            out.append((i, n))
            i = n
    return out


def list_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose lists hold about ``SEGMENTS_AT_ONCE`` entries together."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, z in ranges(sizes, SEGMENTS_AT_ONCE):
        yield batch.slice(a, z - a)


def cut_windows(keys: pa.Array, lists: pa.ListArray, fields: list[str], cut: Cut) -> tuple[np.ndarray, pa.Array, list[pa.Array]]:
    """Windows with a target segment of each row's segments: the row, the first segment, and of each field the list of the window's values."""
    bounds = np.asarray(lists.offsets)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    lengths = np.asarray(pa.compute.utf8_length(flat.field("text")))
    labels = np.asarray(flat.field("label"))
    targets = np.concatenate([[0], np.cumsum(labels == TARGET)])
    row, begin, end = [], [], []
    for r, k in enumerate(keys.to_pylist()):
        a, z = int(bounds[r]), int(bounds[r + 1])
        for i, j in window_bounds(lengths[a:z], labels[a:z], lambda i, k=k: cut.draw(k, i), cut):
            if targets[a + j] > targets[a + i]:
                row.append(r)
                begin.append(a + i)
                end.append(a + j)
    begin, size = np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64) - np.array(begin, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = pa.array(np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begin, size))
    offsets = pa.array(offsets.astype(np.int32))
    row = np.array(row, dtype=np.int64)
    return row, pa.array((begin - bounds[row]).astype(np.int32)), [pa.ListArray.from_arrays(offsets, flat.field(f).take(at)) for f in fields]


def window_lists(cut: Cut) -> Callable[[Column, Column], Column]:
    """A function of (key, segments): array<struct<start,text_list,labels>>, the windows of ``windows``; null has none."""
    names = ["start", "text_list", "labels"]

    @F.arrow_udf("array<struct<start:int,text_list:array<string>,labels:array<int>>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in list_parts(pa.RecordBatch.from_arrays(list(columns), ["key", "segs"]), 1):
                row, start, made = cut_windows(part.column(0), part.column(1), ["text", "label"], cut)
                counts = np.bincount(row, minlength=len(part))
                yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays([start, *made], names))

    return run


def windows(df: DataFrame, key: str, segs: str, cut: Cut = Cut(), least_ratio: float = 0.0, p: Profile = LATIN) -> DataFrame:
    """key, start, and the window's segments (text_list, labels, and all other fields of the segments) for each row's segments.

    Windows need a target segment and ``least_ratio`` of characters of the ratio class.  Sequential in a text, parallel over texts.
    """
    fields = [f for f in df.schema[segs].dataType.elementType.fields]
    names = {"text": "text_list", "label": "labels"}
    out = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("start", T.IntegerType()), *(T.StructField(names.get(f.name, f.name), T.ArrayType(f.dataType)) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in list_parts(whole, 1)):
            row, start, made = cut_windows(batch.column(0), batch.column(1), [f.name for f in fields], cut)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), start, *made], out.names)

    made = df.select(key, segs).mapInArrow(run, out)
    return made.where(ratio(F.array_join("text_list", ""), p) >= least_ratio) if least_ratio else made


def samples(df: DataFrame, key: str, segs: str, cut: Cut = Cut(), least_ratio: float = 0.5, p: Profile = LATIN, firsts: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, start, text_list, labels, pinyin_list (the first reading of each target character) of the windows of segments.

    Segments have readings, or else ``firsts`` gives the first ones of a list of words (``text.first_readings``); with neither there is no pinyin_list.
    """
    rows = windows(df, key, segs, cut, least_ratio, p)
    if firsts:
        targets = F.filter(F.col("text_list"), lambda t, i: F.get(F.col("labels"), i) == TARGET)
        return rows.select(key, "start", "text_list", "labels", firsts(targets).alias("pinyin_list"))
    told = [F.flatten(F.transform("readings", flat)).alias("pinyin_list")] if "readings" in rows.columns else []
    return rows.select(key, "start", "text_list", "labels", *told)


def text_samples(texts: DataFrame, key: str, reader: Callable[[Column], Column] | Phrases | None, cut: Cut = Cut(), least_ratio: float = 0.5, p: Profile = LATIN, mode: str = "word", words: Phrases | None = None, firsts: Callable[[Column], Column] | None = None) -> DataFrame:
    """Samples of texts (key, text): the ratio filter, segments with readings, windows.  Mode char: readings are looked up by word, then words are cut.

    ``reader`` is a function of a word's column, or a table of phrases and characters; ``words`` a lexicon that runs are cut by.  Without a
    reader (mode word) ``firsts`` reads the words of each window at once, which is far less work than a list for each letter.
    """
    if mode not in ("word", "char"):
        raise ValueError(f"unknown mode: {mode}")
    if reader is None and mode == "char":
        raise ValueError("mode char needs a reader of words")
    rows = eligible(texts, p, least_ratio).select(key, segments(F.col("text"), p, words=words).alias("s"))
    if reader is None:
        return samples(rows, key, "s", cut, least_ratio, p, firsts)
    segs = with_read_words(F.col("s"), reader) if isinstance(reader, Phrases) else with_readings(F.col("s"), reader)
    segs = by_letter(segs) if mode == "char" else segs
    return samples(rows.select(key, segs.alias("s")), key, "s", cut, least_ratio, p)


def sentence_samples(lists: DataFrame, key: str, reader: Callable[[Column], Column] | None, **more) -> DataFrame:
    """Samples of rows (key, sentences): each sentence is a text of its own, ``key-place``."""
    texts = lists.select(F.posexplode("sentences").alias("_at", "text"), key).select(F.concat_ws("-", key, "_at").alias(key), "text")
    return text_samples(texts, key, reader, **more)


def column_samples(df: DataFrame, key: str, columns: list[str], reader: Callable[[Column], Column] | None, **more) -> DataFrame:
    """Samples of all text columns that are there, ``key-column``; null and empty texts are skipped."""
    from ..sources import unpivot_texts

    texts = unpivot_texts(df, columns, key).select(F.concat_ws("-", key, "column").alias(key), "text")
    return text_samples(texts, key, reader, **more)
