"""Standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import derived_name
from .matrix import column_stats, stats_array


def standardize(train: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Shift and scale every position to mean 0 and population deviation 1 on the training rows.

    The training statistics serve the other frames too. A constant column is only shifted.
    """
    stats = column_stats(train)
    deviation = F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))
    params = stats_array(stats, F.struct(F.col("mean").alias("m"), deviation.alias("s")))

    def scaled(m: DataFrame) -> DataFrame:
        out = m.withColumn("_params", params)
        return out.withColumn(
            "features", F.zip_with("features", "_params", lambda x, p: (x - p["m"]) / p["s"])).drop("_params")

    return [scaled(m) for m in (train, *others)]


def fill_missing(df: DataFrame, keys: list[str]) -> DataFrame:
    """Missing text becomes '', missing numbers become 0."""
    kinds = dict(df.dtypes)
    fills = {k: F.coalesce(F.col(k), F.lit("") if kinds[k] == "string" else F.lit(0)) for k in keys}
    return df.withColumns(fills)


def zscore_features(df: DataFrame, keys: list[str], label: str | None = None) -> DataFrame:
    """Fill and z-score numeric columns into new ``_xf`` columns; the label is passed through under its new name.

    A constant column gives 0.
    """
    filled = fill_missing(df, keys)
    stats = filled.agg(F.struct(*[
        F.struct(F.avg(k).alias("m"), F.stddev_pop(k).alias("s")).alias(k) for k in keys])).scalar()
    out = filled.withColumn("_stats", stats)
    scores = {}
    for k in keys:
        s = F.col(f"_stats.{k}.s")
        scores[derived_name(k)] = (F.col(k) - F.col(f"_stats.{k}.m")) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    out = out.withColumns(scores).drop("_stats")
    return out.withColumn(derived_name(label), F.col(label)) if label else out
