"""Joins of a large table with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HASH = "_key_hash"


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left`` joined with ``right`` by ``keys``, safe for keys most left rows share.

    A right side of small measured size is broadcast by the optimizer. Otherwise
    both sides are shuffled, and adaptive execution splits a key that fills a
    partition on the left. It can do so only in a shuffle made for the join, with
    no operator relying on its outcome. The keys are therefore joined together
    with their hash: a side that is already partitioned by the key is shuffled
    anew, and what follows the join combines before a shuffle of its own.
    """
    key_hash = F.xxhash64(*keys)
    return (
        left.withColumn(_HASH, key_hash)
        .join(right.withColumn(_HASH, key_hash), [*keys, _HASH], how)
        .drop(_HASH)
    )
