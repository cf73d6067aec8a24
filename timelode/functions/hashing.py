"""Stable pseudo-random numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_num(seed: int | Column, a: Column, b: Column | int) -> Column:
    """SHA-256 of three big-endian 64-bit integers, as one big number, modulo 100."""
    wide = lambda x: F.unhex(F.lpad(F.hex((x if isinstance(x, Column) else F.lit(x)).cast("long")), 16, "0"))
    digest = F.sha2(F.concat(wide(seed), wide(a), wide(b)), 256)
    byte = lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0), lambda acc, i: (acc * 256 + byte(i)) % 100)


def split_of(h: Column, train: int = 70, val: int = 85) -> Column:
    """train, val or test by where a number from 0 to 99 falls."""
    return F.when(h < train, "train").when(h < val, "val").otherwise("test")
