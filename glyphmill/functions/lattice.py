"""Phrases of a lexicon in texts: all matches by a trie, then the cheapest path through them or the leftmost longest ones."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of all phrases of a lexicon that every worker gets; a larger lexicon is joined instead.
MOST_CHARS = 1 << 24
#: Characters that are looked up at once.
SLICE = 1 << 20
#: What a natural logarithm is multiplied by; costs are whole numbers, so that sums are exact in any order.
SCALE = 1_000_000
#: Characters of a block of a lexicon that is joined.
BLOCK_CHARS = 1 << 23


class Texts:
    """Texts one after the other: code points, and for each of them where its text ends."""

    def __init__(self, texts: pa.Array) -> None:
        whole = "".join(texts.to_pylist())
        self.raw = whole.encode()
        self.points = np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.int64)
        self.ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.ends - self.begins)
        self.stop = self.ends[self.text] if len(self.points) else np.zeros(0, np.int64)

    def within(self, begins: np.ndarray, ends: np.ndarray, stop: np.ndarray) -> Texts:
        """The same characters, walked from ``begins`` to ``ends`` only; ``stop``: where the part that each is in ends."""
        out = copy.copy(self)
        out.begins, out.ends, out.stop = begins, ends, stop
        return out

    def bytes_before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(1 + (self.points > 0x7F) + (self.points > 0x7FF) + (self.points > 0xFFFF))])

    def pieces(self, starts: np.ndarray) -> pa.Array:
        """The strings between starts, which share the texts' bytes."""
        at = self.bytes_before()
        offsets = np.append(at[starts], at[-1])
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.raw)]).cast(pa.string())

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The strings from starts to ends."""
        at = self.bytes_before()
        a, n = at[starts], at[ends] - at[starts]
        offsets = np.concatenate([[0], np.cumsum(n)])
        taken = np.frombuffer(self.raw, np.uint8)[np.repeat(a - offsets[:-1], n) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.string())


class Book:
    """A trie of phrases as sorted arrays: level n has the keys (node above, code point) of all beginnings of n + 1 characters, and which phrase ends there."""

    def __init__(self, phrases: list[str]) -> None:
        points = [np.frombuffer(p.encode("utf-32-le"), "<u4").astype(np.int64) for p in phrases]
        size = np.array([len(p) for p in points], dtype=np.int64)
        flat = np.concatenate(points) if points else np.zeros(0, np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        node, self.levels = np.zeros(len(points), np.int64), []
        for n in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > n)
            keys, own = np.unique(node[live] << 21 | flat[begin[live] + n], return_inverse=True)
            node[live] = own
            entry = np.full(len(keys), -1, np.int64)
            last = size[live] == n + 1
            entry[own[last]] = live[last]
            self.levels.append((keys, entry))

    def matches(self, t: Texts, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each match begins (``at``: at these places only), its length and its phrase; all places go down the trie together."""
        at = np.arange(len(t.points)) if at is None else at
        node = np.zeros(len(at), np.int64)
        found = []
        for n, (keys, entry) in enumerate(self.levels):
            inside = at + n < t.stop[at]
            at, node = at[inside], node[inside]
            key = node << 21 | t.points[at + n]
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            at, node = at[hit], i[hit]
            ends = entry[node] >= 0
            found.append((at[ends], np.full(int(ends.sum()), n + 1), entry[node[ends]]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def walk(t: Texts, step: np.ndarray) -> np.ndarray:
    """Places that are reached from the texts' first ones by ``step``, in order; the texts walk together."""
    reached = np.zeros(len(t.points), dtype=bool)
    at = t.begins[t.begins < t.ends]
    while len(at):
        reached[at] = True
        then = at + step[at]
        at = then[then < t.stop[at]]
    return np.flatnonzero(reached)


def longest_steps(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """From each place the longest match, or one character."""
    step = np.ones(n, np.int64)
    np.maximum.at(step, at, length)
    return step


def cheapest_steps(t: Texts, at: np.ndarray, length: np.ndarray, cost: np.ndarray, unknown: int) -> np.ndarray:
    """From each place the first word of the cheapest way to its text's end; of ways that cost the same, the one with the longer first word.

    A character that is no match by itself costs ``unknown``.  Places that are as far from their ends are worked out together.
    """
    n = len(t.points)
    single = np.ones(n, dtype=bool)
    single[at[length == 1]] = False
    alone = np.flatnonzero(single)
    at, length = np.concatenate([at, alone]), np.concatenate([length, np.ones(len(alone), np.int64)])
    cost = np.concatenate([cost, np.full(len(alone), unknown, np.int64)])
    left = t.stop[at] - at
    order = np.lexsort((-length, at, left))
    at, length, cost, left = at[order], length[order], cost[order], left[order]
    best, step = np.zeros(n + 1, np.int64), np.ones(n, np.int64)
    cuts = np.flatnonzero(np.diff(left, prepend=-1, append=-1))
    for a, z in zip(cuts[:-1], cuts[1:]):
        here = at[a:z]
        then = here + length[a:z]
        value = cost[a:z] + np.where(then < t.stop[here], best[then], 0)
        first = np.flatnonzero(np.diff(here, prepend=-1))
        least = np.minimum.reduceat(value, first)
        size = np.diff(np.append(first, z - a))
        good = np.flatnonzero(value == np.repeat(least, size))
        chosen = good[np.searchsorted(good, first)]  # the first of each place is the longest
        best[here[first]] = least
        step[here[first]] = length[a:z][chosen]
    return step


def text_slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` characters together."""
    yield from ranges(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), limit)


def ranges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes are about ``limit`` together; a larger row is one by itself."""
    upto = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right")))
        yield a, z
        a = z


def grouped(pieces: pa.Array, text: np.ndarray, n: int) -> pa.Array:
    """Pieces as one list for each of n texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pieces)


@dataclass(frozen=True)
class Held:
    """A small lexicon that goes with the function that uses it."""

    value: tuple


class Phrases:
    """A lexicon on the workers: a trie, and for each phrase its cost or what it stands for."""

    def __init__(self, book: Broadcast | Held, total: int = 0) -> None:
        self.book, self.unknown = book, round(SCALE * float(np.log(total))) if total else 0


def small(lexicon: DataFrame, phrase: str) -> bool:
    """Whether a lexicon may go to every worker."""
    return (lexicon.agg(F.sum(F.length(phrase))).first()[0] or 0) <= MOST_CHARS


def costs(lexicon: DataFrame, word: str = "word", freq: str = "freq") -> tuple[DataFrame, int]:
    """word, cost (negative logarithm of its share, as a whole number) and the sum of all frequencies.  Rows of one word add up."""
    each = lexicon.where(F.length(word) > 0).groupBy(F.col(word).alias("word")).agg(F.sum(freq).alias("f")).where("f > 0")
    total = each.agg(F.sum("f")).first()[0] or 1
    return each.select("word", F.round(SCALE * (F.log(F.lit(float(total))) - F.log("f"))).cast("long").alias("cost")), int(total)


def word_book(lexicon: DataFrame, word: str = "word", freq: str = "freq") -> Phrases:
    """A lexicon (word, freq) for ``cut`` and ``segment.segments``; ValueError if it is too large to be sent to workers: then ``cut_runs`` joins it."""
    priced, total = costs(lexicon, word, freq)
    if not small(priced, "word"):
        raise ValueError(f"the lexicon has more than {MOST_CHARS} characters")
    rows = priced.toArrow()
    held = (Book(rows.column("word").to_pylist()), rows.column("cost").to_numpy().astype(np.int64))
    return Phrases(lexicon.sparkSession.sparkContext.broadcast(held), total)


def word_starts(t: Texts, words: Phrases) -> np.ndarray:
    book, cost = words.book.value
    at, length, entry = book.matches(t)
    return walk(t, cheapest_steps(t, at, length, cost[entry], words.unknown))


def cut(texts: Column, words: Phrases) -> Column:
    """Each text (no null) as the list of the words of its likeliest segmentation."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for a, z in text_slices(texts, SLICE):
            t = Texts(texts.slice(a, z - a))
            starts = word_starts(t, words)
            out.append(grouped(t.pieces(starts), t.text[starts], z - a))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return run(texts)


def cut_runs(rows: DataFrame, run: str, lexicon: DataFrame, word: str = "word", freq: str = "freq") -> DataFrame:
    """rows with ``words``: each distinct run cut into the words of a lexicon of any size.

    A lexicon of up to ``MOST_CHARS`` characters goes to the workers.  A larger one is dealt into blocks by the first two characters of a
    word.  A run goes to the blocks of its own pairs of characters, each of which finds the words that begin there, so that
    what is shuffled of a run is a copy for each block that it meets and a list of hits, and no task holds more than a block.
    """
    priced, total = costs(lexicon, word, freq)
    chars = priced.agg(F.sum(F.length("word"))).first()[0] or 0
    if chars <= MOST_CHARS:
        return rows.withColumn("words", cut(F.col(run), word_book(lexicon, word, freq)))
    blocks = -(-chars // BLOCK_CHARS)
    distinct = rows.select(F.col(run).alias("text")).where("length(text) > 0").distinct()
    shape = "block long, text string, cost long, places array<int>"
    dealt = priced.select("word", "cost").mapInArrow(dealt_words(blocks), shape).unionByName(distinct.mapInArrow(dealt_runs(blocks), shape))
    dealt = dealt.repartition("block").sortWithinPartitions("block", F.col("cost").isNull())
    hits = dealt.mapInArrow(block_hits, "_run string, at array<int>, n array<int>, cost array<long>")
    hits = hits.groupBy("_run").agg(F.collect_list(F.struct("at", "n", "cost")).alias("hits"))
    unknown = round(SCALE * float(np.log(total)))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def path(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for a, z in text_slices(columns[0], SLICE):
                texts, at, n, cost = (c.slice(a, z - a) for c in columns)
                t = Texts(texts)
                sizes = pc.list_value_length(at).to_numpy(zero_copy_only=False).astype(np.int64)
                at, n, cost = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (at, n, cost))
                starts = walk(t, cheapest_steps(t, at + np.repeat(t.begins, sizes), n, cost, unknown))
                yield grouped(t.pieces(starts), t.text[starts], z - a)

    found = hits.select("_run", path("_run", *[F.flatten(F.col(f"hits.{c}")) for c in ("at", "n", "cost")]).alias("words"))
    out = rows.where(F.col(run).isNotNull()).join(found, F.col(run) == F.col("_run"), "left").drop("_run")
    return out.withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def pair_blocks(first: np.ndarray, second: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each pair of characters (second 0: the text ends)."""
    key = (first << 21 | second).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def next_points(t: Texts) -> np.ndarray:
    """The character after each one in its text, 0 at the end."""
    after = np.zeros(len(t.points), np.int64)
    after[:-1] = np.where(t.text[1:] == t.text[:-1], t.points[1:], 0)
    return after


def dealt_words(blocks: int):
    """Words (word, cost) with their block; a single character is in all of them, as it may be before any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(0), SLICE):
                part = batch.slice(a, z - a)
                t = Texts(part.column(0))
                block = pair_blocks(t.points[t.begins], next_points(t)[t.begins], blocks)
                single = np.flatnonzero(t.ends - t.begins == 1)
                longer = np.flatnonzero(t.ends - t.begins > 1)
                of = pa.array(np.concatenate([longer, np.repeat(single, blocks)]))
                block = np.concatenate([block[longer], np.tile(np.arange(blocks), len(single))])
                yield pa.RecordBatch.from_arrays([pa.array(block), part.column(0).take(of), part.column(1).take(of), pa.nulls(len(of), pa.list_(pa.int32()))], ["block", "text", "cost", "places"])

    return run


def dealt_runs(blocks: int):
    """A row for each block that a run meets, with the places whose pair of characters is of that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(0), SLICE):
                texts = batch.column(0).slice(a, z - a)
                t = Texts(texts)
                block = pair_blocks(t.points, next_points(t), blocks)
                order = np.lexsort((block, t.text))
                block, text = block[order], t.text[order]
                first = np.ones(len(order), dtype=bool)
                first[1:] = (block[1:] != block[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(first)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array((order - t.begins[text]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(block[first]), texts.take(pa.array(text[first])), pa.nulls(len(first), pa.int64()), places], ["block", "text", "cost", "places"])

    return run


def block_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where words of a block begin in its runs, which come after the words."""
    at: int | None = None
    words: list[pa.RecordBatch] = []
    book = cost = None
    for batch in batches:
        block = batch.column(0).to_numpy()
        is_run = pc.is_null(batch.column(2)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(block) | np.diff(is_run)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            if a == z:
                continue
            part = batch.slice(a, z - a)
            if block[a] != at:
                at, words, book = int(block[a]), [], None
            if not is_run[a]:
                words.append(part.select([1, 2]))
                continue
            if book is None:
                known = pa.Table.from_batches(words) if words else None
                book = Book(known.column(0).to_pylist() if words else [])
                cost = known.column(1).to_numpy() if words else np.zeros(0, np.int64)
                words = []
            for i, j in text_slices(part.column(1), SLICE):
                t, places = Texts(part.column(1).slice(i, j - i)), part.column(3).slice(i, j - i)
                size = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.repeat(t.begins, size)
                start, length, entry = book.matches(t, begin + places.flatten().to_numpy())
                order = np.argsort(start, kind="stable")
                start, length, entry = start[order], length[order], entry[order]
                upto = pa.array(np.searchsorted(start, np.append(t.begins, len(t.points))).astype(np.int32))
                lists = (start - t.begins[t.text[start]]).astype(np.int32), length.astype(np.int32), cost[entry]
                yield pa.RecordBatch.from_arrays([part.column(1).slice(i, j - i), *(pa.ListArray.from_arrays(upto, pa.array(x)) for x in lists)], ["_run", "at", "n", "cost"])


def phrase_book(table: DataFrame, phrase: str = "phrase", value: str = "value") -> Phrases:
    """A table (phrase, value: a string or a list of strings) for ``replaced`` and ``read``; of several rows of a phrase the least value counts."""
    rows = table.where(F.length(phrase) > 0).groupBy(F.col(phrase).alias("phrase")).agg(F.min(value).alias("value"))
    if not small(rows, "phrase"):
        raise ValueError(f"the table has more than {MOST_CHARS} characters")
    rows = rows.toArrow()
    held = (Book(rows.column("phrase").to_pylist()), rows.column("value").combine_chunks())
    return Phrases(table.sparkSession.sparkContext.broadcast(held))


def phrases_of(table: dict[str, str]) -> Phrases:
    """A small table as it is written down."""
    known = {k: v for k, v in table.items() if k}
    return Phrases(Held((Book(list(known)), pa.array(list(known.values()), pa.string()))))


def longest(t: Texts, at: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the leftmost longest of a text's matches and of the characters between them, and their phrases (-1: none)."""
    step = longest_steps(len(t.points), at, length)
    starts = walk(t, step)
    of = np.full(len(t.points), -1, np.int64)
    best = length == step[at]
    of[at[best]] = entry[best]
    return starts, of[starts]


def replaced(texts: Column, table: Phrases) -> Column:
    """Texts (null stays) with the leftmost longest phrases replaced, once: nothing matches inside what has been put in."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.string())]
        book, values = table.book.value
        for a, z in text_slices(pc.fill_null(texts, ""), SLICE):
            part = texts.slice(a, z - a)
            t = Texts(pc.fill_null(part, ""))
            starts, entry = longest(t, *book.matches(t))
            pieces = t.pieces(starts)
            if len(values):
                pieces = pc.if_else(pa.array(entry >= 0), values.take(pa.array(np.maximum(entry, 0))), pieces)
            made = pc.binary_join(grouped(pieces, t.text[starts], z - a), "")
            out.append(pc.if_else(pc.is_valid(part), made, pa.scalar(None, pa.string())))
        return pa.concat_arrays(out)

    return run(texts)


def in_context(t: Texts, book: Book, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each character the place of its reading in context, in the values whose lists begin at ``first``, and the phrase that it is alone (-1: none)."""
    n = len(t.points)
    at, length, entry = book.matches(t)
    alone = np.full(n, -1, np.int64)
    alone[at[length == 1]] = entry[length == 1]
    starts, phrase = longest(t, at, length, entry)
    size = np.diff(np.append(starts, n))
    owner = np.repeat(np.arange(len(starts)), size)
    many = size[owner] > 1
    place = np.where(many, np.arange(n) - starts[owner], 0)
    of = np.where(many, phrase[owner], alone)
    there = (of >= 0) & (first[of] + place < first[of + 1])
    return np.where(there, first[of] + place, -1), alone


def read(words: Column, table: Phrases) -> Column:
    """For a list of words: of each its readings, struct(best: one for each character in its context, own: all of each character).

    A phrase of the table has a reading for each of its characters, a single character all of its readings, the usual one
    first.  In a word the leftmost longest phrases count; a character in none of them has its own first reading, or null.
    """
    one = T.StructType([T.StructField("best", T.ArrayType(T.StringType())), T.StructField("own", T.ArrayType(T.ArrayType(T.StringType())))])

    @F.arrow_udf(T.ArrayType(one))
    def run(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        best, own, counts = [pa.array([], pa.string())], [pa.array([], pa.list_(pa.string()))], [np.zeros(0, np.int64)]
        book, values = table.book.value
        for a, z in text_slices(flat, SLICE):
            t = Texts(flat.slice(a, z - a))
            place, alone = in_context(t, book, values.offsets.to_numpy())
            best.append(values.values.take(pa.array(np.maximum(place, 0), mask=place < 0)))
            lists = values.take(pa.array(np.maximum(alone, 0), mask=alone < 0)) if len(values) else pa.nulls(len(alone), pa.list_(pa.string()))
            own.append(lists.cast(pa.list_(pa.string())))
            counts.append(t.ends - t.begins)
        upto = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
        made = pa.StructArray.from_arrays([pa.ListArray.from_arrays(upto, pa.concat_arrays(best)), pa.ListArray.from_arrays(upto, pa.concat_arrays(own))], ["best", "own"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), made)

    return run(words)


def ordered(words: Column, table: Phrases, dropped: str, joined: str | None = None) -> Column:
    """Of each word (no null) the readings of its characters, the one in context first: what ``lexicon.nested_of`` makes of ``read``.

    A list is made once for each pair of a front reading and a character that a part of a batch has, instead of one for each character of each
    word.  ``joined``: each character's readings are one string, with this between them.
    """
    inner = pa.string() if joined is not None else pa.list_(pa.string())

    @F.arrow_udf(T.ArrayType(T.StringType() if joined is not None else T.ArrayType(T.StringType())))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        book, values = table.book.value
        first = values.offsets.to_numpy()
        coded = values.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        left = np.concatenate([[0], np.cumsum(pc.fill_null(pc.not_equal(values.values, dropped), True).to_numpy(zero_copy_only=False))])
        has = (left[first[1:]] > left[first[:-1]]) & pc.is_valid(values).to_numpy(zero_copy_only=False)
        has = np.append(has, False)  # of characters without an entry
        for words in batches:
            for a, z in text_slices(words, SLICE):
                t = Texts(words.slice(a, z - a))
                place, alone = in_context(t, book, first)
                front = np.append(code, -1)[place]
                kept, told = np.flatnonzero(has[alone]), np.flatnonzero(front >= 0)
                # the readings of a word in order go to the characters that are left of it
                at = np.searchsorted(told, t.begins)[t.text[kept]] + np.arange(len(kept)) - np.searchsorted(kept, t.begins)[t.text[kept]]
                given = at < np.searchsorted(told, t.ends)[t.text[kept]]
                given = np.where(given, front[np.append(told, 0)[np.where(given, at, 0)]], -1)
                pairs, which = np.unique(alone[kept] * (len(names) + 1) + given + 1, return_inverse=True)
                lists = []
                for entry, i in zip(*(x.tolist() for x in np.divmod(pairs, len(names) + 1))):
                    own = [r for r in values[entry].as_py() if r != dropped]
                    own = list(dict.fromkeys([names[i - 1], *own] if i and names[i - 1] in own else own))
                    lists.append(own if joined is None else joined.join(r for r in own if r is not None))
                yield grouped(pa.array(lists, inner).take(pa.array(which)), t.text[kept], z - a)

    return run(words)


def numbered_words(words: DataFrame, word: str) -> DataFrame:
    """Distinct words with how often they occur: a lexicon from a corpus."""
    return words.groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("freq"))
