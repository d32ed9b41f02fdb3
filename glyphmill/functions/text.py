"""String to string: normalisation; and predicates on characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lattice import phrases_of, replaced
from .profile import LATIN, OTHER, PAUSE, TARGET, Profile


def strip_brackets(text: Column) -> Column:
    """Delete ``[...]`` with at least one character inside."""
    return F.regexp_replace(text, r"\[[^\]]+\]", "")


def join_spaced(text: Column, p: Profile = LATIN) -> Column:
    """Drop white space between two target characters; matches don't overlap, so every other gap of single characters stays."""
    return F.regexp_replace(text, rf"(?U)([{p.target}])\s+([{p.target}])", "$1$2")


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC; there is no built-in function for it."""
    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).replace("｡", "。"))


def simplify(text: Column, pairs: dict[str, str]) -> Column:
    """Replace characters one by one (the 1:1 part of a conversion between character sets)."""
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def keep_vocabulary(text: Column, vocabularies: dict[str, list[str]], name: str, allow: str = "") -> Column:
    """Keep the characters of a named vocabulary and of ``allow`` only; for any size of vocabulary."""
    if name not in vocabularies:
        raise ValueError(f"unknown vocabulary: {name}")
    known = F.array(*map(F.lit, sorted({c for c in vocabularies[name] if len(c) == 1} | set(allow)))).cast("array<string>")
    known = F.map_from_arrays(known, F.transform(known, lambda c: F.lit(True)))
    return F.array_join(F.filter(F.split(text, ""), lambda c: F.map_contains_key(known, c)), "")


def convert(text: Column, pairs: dict[str, str], phrases: dict[str, str] | None = None) -> Column:
    """Conversion between character sets: the leftmost longest phrases, single characters where there are none; what is put in is not read again."""
    return replaced(text, phrases_of(pairs | (phrases or {}))) if phrases else simplify(text, pairs) if pairs else text


def keep_classes(text: Column, classes: str) -> Column:
    """Keep the characters of a regex class only."""
    return F.regexp_replace(text, f"[^{classes}]", "")


def normalise(text: Column, p: Profile = LATIN, allow: str = "", pairs: dict[str, str] | None = None, unicode: bool = True) -> Column:
    """Brackets, spaces, character conversion, NFKC, then the filter, in that order; null is empty."""
    text = join_spaced(strip_brackets(F.coalesce(text, F.lit(""))), p)
    if pairs:
        text = simplify(text, pairs)
    if unicode:
        text = nfkc(text)
    return keep_classes(text, p.target + p.pause + allow)


def ratio(text: Column, p: Profile = LATIN) -> Column:
    """Share of characters in the ratio class; 0 for empty text.  Runs of the class are taken out: a negated class is matched several times slower."""
    rest = F.length(F.regexp_replace(text, f"[{p.ratio}]+", ""))
    return F.when(F.length(text) > 0, (F.length(text) - rest) / F.length(text)).otherwise(F.lit(0.0))


def category(ch: Column, p: Profile = LATIN) -> Column:
    """Label of a character or of a run of one class; pause wins over target."""
    return F.when(ch.rlike(f"^[{p.pause}]"), PAUSE).when(ch.rlike(f"^[{p.target}]"), TARGET).otherwise(OTHER)


def all_readings_in(readings: Column, vocabulary: list[str]) -> Column:
    return F.forall(readings, lambda r: r.isin(*vocabulary))


def all_in(text: Column, classes: str) -> Column:
    return ~text.rlike(f"[^{classes}]")


def initial(syllable: Column) -> Column:
    return F.regexp_extract(syllable, INITIAL, 1)


def final(syllable: Column) -> Column:
    return F.regexp_replace(syllable, INITIAL, "")


# Initials, longest first.
INITIAL = "^(zh|ch|sh|[bpmfdtnlgkhjqxrywzcs])"


def shorthands(syllable: Column) -> Column:
    """Short forms of a syllable: its initial, the first letter of a two-letter one, or its own first letter."""
    i = initial(syllable)
    return F.when(syllable == "", F.array().cast("array<string>")).when(F.length(i) == 2, F.array(i, F.left(i, F.lit(1)))).when(F.length(i) == 1, F.array(i)).otherwise(F.array(F.left(syllable, F.lit(1))))


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")


def readings(word: Column) -> Column:
    """Latin stand-in for pronunciation: plain lower-case letters; c and g depend on the letter after."""
    return characters(spoken(word))


def spoken(text: Column, dropped: str = "") -> Column:
    """``readings`` of all letters as one string, a character each; what stands between words separates them, and ``dropped`` goes afterwards."""
    plain = F.translate(F.lower(text), *ACCENTS)
    return F.translate(F.regexp_replace(F.regexp_replace(plain, "c(?=[eiy])", "s"), "g(?=[eiy])", "j"), "c" + dropped, "k")


def characters(text: Column) -> Column:
    """The characters of a text as a list; null has none."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def first_readings(words: Column) -> Column:
    """The first one of ``letter_readings`` of each letter of a list of words, all of them at once.  Words hold no pause marks, so a line break keeps them apart."""
    return characters(spoken(F.array_join(words, "\n"), "\n"))


def letter_readings(word: Column) -> Column:
    """Readings of each letter of a word, the one it has in the word first; letters without readings keep a list of their own."""
    plain = F.translate(F.lower(word), *ACCENTS)
    best = readings(word)
    letters = F.filter(F.split(plain, ""), lambda c: c != "")
    other = lambda c: F.when(c == "c", F.array(F.lit("k"), F.lit("s"))).when(c == "g", F.array(F.lit("g"), F.lit("j"))).otherwise(F.array(c))
    return F.transform(F.arrays_zip(letters.alias("c"), best.alias("b")), lambda x: F.array_distinct(F.concat(F.array(x["b"]), other(x["c"]))))
