"""Random numbers from hashes of (seed, salt, key): the same in every run, on any partitioning, and in SQL."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = float(1 << 52)
#: Fixed value: the step of the golden-ratio sequence.
PHI = 0.6180339887498949


def uniform(seed: int | str, salt: str, *key: Column | str) -> Column:
    """In [0, 1): 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *key)), 1, 13), 16, 10).cast("long") / SCALE


def integer(seed: int, salt: str, low: int | Column, high: int | Column, *key: Column | str) -> Column:
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + F.floor(uniform(seed, salt, *key) * (high - low + 1))).cast("int")


def drawn(seed: int | str, salt: str, key: object) -> float:
    """``uniform`` of one key, as a worker computes it."""
    return int(hashlib.md5(f"{seed}:{salt}:{key}".encode()).hexdigest()[:13], 16) / SCALE


def golden_place(text: bytes, epoch: int, n: int) -> int:
    """``golden`` of one text."""
    moved = float(int(hashlib.md5(text).hexdigest()[:16], 16)) / float(1 << 64) + epoch * PHI
    return 1 if n <= 1 else min(int((moved - math.floor(moved)) * n), n - 1) + 1


def golden(text: Column, epoch: Column, n: Column) -> Column:
    """k in 1..n that walks evenly over n as epochs go by, from a start that the text fixes."""
    base = F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))
    moved = base + epoch * F.lit(PHI)
    moved = moved - F.floor(moved)
    return F.when(n <= 1, F.lit(1)).otherwise(F.least(F.floor(moved * n).cast("int"), n - 1) + 1).cast("int")
