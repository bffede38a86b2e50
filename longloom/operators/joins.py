"""Joins whose strategy follows measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize_measured

# A lookup of short strings and numbers with this many rows takes about 100 MB in an executor.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, computed and stored once, with a broadcast hint only if it has at most ``max_rows`` rows.

    A bigger frame is left unhinted: it is joined by shuffle, where adaptive execution splits skewed partitions.
    """
    stored, seen = materialize_measured(df)
    return F.broadcast(stored) if seen["rows"] <= max_rows else stored


def multiplicity(df: DataFrame, *keys: str, out: str = "copies") -> DataFrame:
    """Distinct keys with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


COPIES = 1024  # that an array stands for


def fan_out(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Repeat each row ``copies`` times: what joining a non-unique lookup would have done.

    A row of very many copies is repeated in two steps, so that no array is as long as its number of copies.
    """
    n, size = F.col(copies).cast("bigint"), F.lit(COPIES).cast("bigint")
    block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / size))).alias("_block")
    inside = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(size, n - F.col("_block") * size))).alias("_copy")
    return df.filter(n > 0).select("*", block).select("*", inside).drop("_block", "_copy", copies)
