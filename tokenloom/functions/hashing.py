"""Deterministic, partition-independent randomness.

Every random choice is a pure function of (seed, parts...):
``h48 = first 12 hex digits of md5(seed:part1:part2...)`` read as a 48-bit
integer.  The same expression is easy to state in DuckDB, so sampled results
can be checked against an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO48 = float(2 ** 48)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def h48(seed, *parts) -> Column:
    key = F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")


def u01(seed, *parts) -> Column:
    """Uniform in (0, 1) from h48."""
    return (h48(seed, *parts).cast("double") + F.lit(0.5)) / F.lit(TWO48)
