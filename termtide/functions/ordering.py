"""Reproducible random order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every seeded order sorts by the hex digits of a hash; its first four digits
# split the keys evenly into this many ranges that follow the same order.
SEED_BUCKETS = 16**4


def seeded_key(key: Column, seed: int = 0) -> Column:
    """A value that orders rows at random, the same way on each run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def seed_bucket(seeded: Column) -> Column:
    """Which of the ``SEED_BUCKETS`` ranges of the seeded order a key is in."""
    return F.conv(F.substring(seeded, 1, 4), 16, 10).cast("int")
