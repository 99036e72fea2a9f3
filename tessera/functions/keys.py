"""Deterministic randomness: keys and uniforms from md5, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, stream: str, *row: Column | str) -> Column:
    """md5 of seed, stream and the row's identifier; rows in order of it are shuffled."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in row)).cast("binary"))


def uniform(seed: int, stream: str, *row: Column | str) -> Column:
    """A double in [0, 1) from the first 32 bits of the key."""
    return F.conv(F.substring(key(seed, stream, *row), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
