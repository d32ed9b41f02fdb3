"""Vocabularies, encoding and decoding, nearest tokens, possibility maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.lattice import SLICE, Texts, text_slices
from ..functions.profile import IGNORE
from ..functions.text import shorthands


class Tokenizer:
    """Three vocabularies in order, the context one with the special tokens at its end; duplicates keep their first id."""

    def __init__(self, chinese: list[str], context: list[str], pinyin: list[str], special: list[str] | None = None) -> None:
        self.chinese, self.context, self.pinyin = (list(dict.fromkeys(x)) for x in (chinese, context, pinyin))
        self.special = {name: len(self.context) + i for i, name in enumerate(special or [])}

    @classmethod
    def from_config(cls, spark: SparkSession, config: dict, base: str = "") -> Tokenizer:
        """From a configuration that names the three files (relative to ``base``) and the special tokens."""
        from ..sources import read_vocabulary

        at = lambda name: config[name] if "/" == config[name][:1] or "://" in config[name] or not base else f"{base}/{config[name]}"
        missing = [k for k in ("chinese_vocab", "context_vocab", "pinyin_vocab") if not config.get(k)]
        if missing:
            raise ValueError(f"no path of {missing}")
        return cls(*(read_vocabulary(spark, at(k)) for k in ("chinese_vocab", "context_vocab", "pinyin_vocab")), config.get("special_tokens"))

    @property
    def sizes(self) -> dict[str, int]:
        return {"chinese": len(self.chinese), "pinyin": len(self.pinyin), "context_base": len(self.context), "context": len(self.context) + len(self.special)}

    def ids(self, name: str) -> Column:
        """token -> id as a literal map; specials are in the context one."""
        tokens = getattr(self, name)
        return as_map([*tokens, *(self.special if name == "context" else [])])

    def encode(self, text: Column, name: str = "context", ignore: bool = False) -> Column:
        """Ids of a text's characters: unknown ones dropped, or the ignored target."""
        table = self.ids(name)
        found = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(table, c))
        return F.transform(found, lambda x: F.coalesce(x, F.lit(IGNORE))) if ignore else F.filter(found, lambda x: x.isNotNull())

    def decode(self, ids: Column, name: str = "chinese") -> Column:
        """Text of ids; unknown ones and special tokens are skipped."""
        tokens = F.array(*map(F.lit, getattr(self, name))).cast("array<string>")
        return F.array_join(F.filter(F.transform(ids, lambda i: F.get(tokens, i)), lambda c: c.isNotNull()), "")

    def encode_pinyin(self, readings: Column) -> Column:
        return F.transform(readings, lambda r: known_or_nearest(r, self.pinyin))


def build(tokens: DataFrame, order: str) -> DataFrame:
    """token, id: in the order of first occurrence.  The ids are numbered in one partition: a vocabulary is small."""
    first = tokens.groupBy("token").agg(F.min(order).alias("first"))
    return first.select("token", (F.row_number().over(Window.orderBy("first", "token")) - 1).alias("id"))


def as_map(vocab: list[str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, vocab)), F.sequence(F.lit(0), F.lit(len(vocab) - 1)))


def positions(text: Column, vocab: str) -> Column:
    """Ids of characters under a vocabulary of single characters given as one string; -1 if unknown."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(vocab)) - 1)


def encode(text: Column, vocab: str) -> Column:
    """Ids of the known characters."""
    return looked_up(vocab, None)(text)


def encode_aligned(text: Column, vocab: str) -> Column:
    """An id for every character, the ignored target where it is unknown."""
    return looked_up(vocab, IGNORE)(text)


def id_table(vocab: str) -> np.ndarray:
    """Ids by code point, -1 if unknown; its last entry is that of all greater ones."""
    table = np.full(max(map(ord, vocab), default=0) + 2, -1, dtype=np.int32)
    table[[ord(c) for c in reversed(vocab)]] = np.arange(len(vocab))[::-1]  # of duplicates the first one counts
    return table


def looked_up(vocab: str, unknown: int | None) -> Callable[[Column], Column]:
    """``positions``, where unknown characters are left out or have an id of their own.  Characters are looked up by code point, a part of a batch at once."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = id_table(vocab)
        for texts in batches:
            filled = pa.compute.fill_null(texts, "")
            for a, z in text_slices(filled, SLICE):
                t, part = Texts(filled.slice(a, z - a)), texts.slice(a, z - a)
                ids = table[np.minimum(t.points, len(table) - 1)]
                known = ids >= 0 if unknown is None else np.ones(len(ids), dtype=bool)
                if unknown is not None:
                    ids[ids < 0] = unknown
                upto = np.concatenate([[0], np.cumsum(np.bincount(t.text[known], minlength=z - a))])
                yield pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids[known]), mask=pa.compute.is_null(part) if part.null_count else None)

    return run


def decode(ids: Column, vocab: str, size: int | None = None) -> Column:
    """Text of ids; ids outside the vocabulary (or from ``size`` on) are skipped."""
    known = F.filter(ids, lambda x: (x >= 0) & (x < (len(vocab) if size is None else size)))
    return F.array_join(F.transform(known, lambda x: F.substr(F.lit(vocab), x + 1, F.lit(1))), "")


def nearest(token: Column, vocab: list[str]) -> Column:
    """Id of the token, or of the one with the least edit distance; ties to the lowest id; empty: the shortest token."""
    items = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(vocab)])
    return F.array_min(F.transform(items, lambda x: F.struct(F.levenshtein(x["t"], token).alias("d"), x["i"].alias("i"))))["i"]


def known_or_nearest(token: Column, vocab: list[str]) -> Column:
    """Id of the token if it is one, else ``nearest``, which compares it with the whole vocabulary."""
    return F.coalesce(F.try_element_at(as_map(vocab), token), nearest(token, vocab))


def possibilities(lexicon: DataFrame, vocab: DataFrame) -> DataFrame:
    """Edges (token id, ch): each reading of a character and its short forms, as far as they are in the vocabulary."""
    forms = F.array_union(F.array("reading"), shorthands(F.col("reading")))
    return lexicon.select("ch", F.explode(forms).alias("token")).join(vocab, "token").select("id", "ch").distinct()


def candidate_table(edges: DataFrame, tokens: DataFrame, characters: DataFrame) -> DataFrame:
    """For every token (id) its candidates as rows of one width: ids (of characters, ascending, then zeros), mask, width.

    ``edges``: id, ch (``possibilities``); ``tokens``: id; ``characters``: ch, char_id.  The width is the largest number of candidates of
    any token, 1 at least; a token without candidates has a row of zeros.
    """
    own = edges.join(characters, "ch").groupBy("id").agg(F.array_sort(F.collect_set(F.col("char_id").cast("int"))).alias("own"))
    rows = tokens.select("id").distinct().join(own, "id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    width = rows.agg(F.greatest(F.max(F.size("own")), F.lit(1)).alias("width"))
    rows = rows.crossJoin(F.broadcast(width))  # one row
    rest = F.col("width") - F.size("own")
    ids = F.concat("own", F.array_repeat(F.lit(0), rest))
    mask = F.concat(F.transform("own", lambda _: F.lit(True)), F.array_repeat(F.lit(False), rest))
    return rows.select("id", ids.alias("ids"), mask.alias("mask"), "width")


def gathered(sequences: DataFrame, key: str, tokens: str, table: DataFrame) -> DataFrame:
    """key, ids, mask: of each token of a sequence its row of a candidate table, in order; an id that the table has not is an error.

    Keys are unique.  Tokens are joined by id, so a table of any size will do, and come together again by key.
    """
    rows = sequences.select(key, F.posexplode_outer(tokens).alias("_at", "id")).join(table.select("id", "ids", "mask"), "id", "left")
    known = F.when(F.col("id").isNull() | F.col("ids").isNotNull(), F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("no candidates of id "), F.col("id").cast("string"))).cast("array<int>"))
    grouped = rows.select(key, F.when(F.col("id").isNotNull(), F.struct("_at", known.alias("ids"), "mask")).alias("r")).groupBy(key).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return grouped.select(key, F.transform("r", lambda x: x["ids"]).alias("ids"), F.transform("r", lambda x: x["mask"]).alias("mask"))


def candidate_logits(logits: Column, ids: Column, mask: Column) -> Column:
    """Logits of a token's candidates, minus infinity in the padding."""
    return F.transform(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x: F.when(x["m"], F.get(logits, x["i"])).otherwise(F.lit(float("-inf"))))
