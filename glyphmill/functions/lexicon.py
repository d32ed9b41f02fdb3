"""Words and readings from a lexicon: segmentation of runs into words, and all readings of a word's characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a reading that is never kept.
DROPPED = "ê"


def words(run: Column, lexicon: list[str]) -> Column:
    """Words of a run, longest match first from the left; what is in no word stays a character of its own.

    The lexicon becomes one pattern, so it is for some thousand words.
    """
    longest_first = "|".join(map(re.escape, sorted({w for w in lexicon if w}, key=lambda w: (-len(w), w))))
    pattern = f"({longest_first}|(?s:.))" if longest_first else "((?s:.))"
    return F.regexp_extract_all(run, F.lit(pattern), F.lit(1))


def lookup(table: dict[str, list[str]]) -> Column:
    """A lexicon as a literal map."""
    if not table:
        return F.create_map().cast("map<string,array<string>>")
    keys, values = zip(*sorted(table.items()), strict=True)
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[F.array(*map(F.lit, v)).cast("array<string>") for v in values]))


def nested(word: Column, best: Column, single: Column) -> Column:
    """For each character of a word its readings, the best first: array<array<string>>.

    ``best`` has the readings of the word as a whole, ``single`` maps a character to all of its own.  A character without readings is left out,
    and a best reading that is none of the character's own is not used; best readings go to the characters that are left, in order.
    """
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return nested_of(best, F.transform(chars, lambda c: F.coalesce(F.try_element_at(single, c), F.array().cast("array<string>"))))


def nested_of(best: Column, own: Column) -> Column:
    """``nested`` of the readings of a word and those of each of its characters."""
    kept = F.filter(F.transform(own, lambda r: F.array_remove(r, DROPPED)), lambda r: F.size(r) > 0)

    def first(readings: Column, i: Column) -> Column:
        front = F.get(best, i)
        return F.when(F.coalesce(F.array_contains(readings, front), F.lit(False)), F.array_distinct(F.concat(F.array(front), readings))).otherwise(F.array_distinct(readings))

    return F.transform(kept, first)


def flat(readings: Column) -> Column:
    """The first reading of each character, empty if it has none."""
    return F.transform(readings, lambda r: F.coalesce(F.get(r, F.lit(0)), F.lit("")))
