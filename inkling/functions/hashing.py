"""Reproducible randomness: md5 of a text key, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts) -> Column:
    """Unsigned 32-bit hash of the parts joined by "|"."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number in (0, 1)."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def pid(nparts: int, *key, seed: int = 0) -> Column:
    """Sampling partition of a row: ``pid < k`` is a k/nparts sample."""
    return (hash32(F.lit(seed), *key) % nparts).cast("int")
