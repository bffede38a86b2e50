"""Parts of moments, and flags of ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment_parts(moment: Column) -> dict[str, Column]:
    """``month``, ``hour``, ``day_of_week`` (1 is Sunday) and ``epoch_seconds`` of a moment, in the session's time zone; NULL of
    NULL. Part seconds are cut off."""
    at = moment.cast("timestamp")
    return {"month": F.month(at).cast("bigint"), "hour": F.hour(at).cast("bigint"), "day_of_week": F.dayofweek(at).cast("bigint"),
            "epoch_seconds": F.unix_seconds(at)}


def exceeds_share(value: Column, whole: Column, share: float) -> Column:
    """1 if a value is more than a share of another, else 0; 0 if either is NULL."""
    return F.coalesce(value > whole * F.lit(float(share)), F.lit(False)).cast("bigint")
