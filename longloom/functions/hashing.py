"""Seeded, engine-independent hashing.

All random choices (splits, sampling, synthetic rows) are pure functions of the row id and a seed, so a retried task
makes the same choice again and another SQL engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 32
HASH_RANGE = 1 << HASH_BITS


def hash32(key: Column | str, salt: object) -> Column:
    """First 32 bits of ``md5(key || ':' || salt)`` as a BIGINT."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(key.cast("string"), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def known_id(id_col: Column | str) -> Column:
    """The id; a row without one is an error, because it would have no place in a hash order."""
    name = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.when(name.isNull(), F.raise_error(F.lit("row without an id"))).otherwise(name)


def uniform(key: Column | str, salt: object) -> Column:
    """A number in [0, 1) that depends only on the key and the salt."""
    return hash32(key, salt) / F.lit(float(HASH_RANGE))


def hash_sample(df: DataFrame, key: str, rate: float, salt: object = "sample") -> DataFrame:
    """Keep each key with probability ``rate``, the same keys every time."""
    return df.filter(uniform(key, salt) < F.lit(float(rate)))
