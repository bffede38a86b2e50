"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def one_minus_ratio(a: Column, b: Column) -> Column:
    """``1 - a / b``; NULL when b is 0."""
    return F.lit(1.0) - ratio(a, b)


def event_indicator(event: Column, name: str) -> Column:
    """1 when the event has this name, else 0; a NULL event counts as 0."""
    return F.coalesce(event == F.lit(name), F.lit(False)).cast("bigint")


def null_skipping_sum(value: Column) -> Column:
    """Sum that ignores NULLs and is 0 for a group with nothing but NULLs."""
    return F.coalesce(F.sum(value), F.lit(0))


def nan_to_null(value: Column) -> Column:
    """NaN is how matrix files spell a missing value; tables spell it NULL."""
    return F.when(~F.isnan(value), value)


def clean_value(df: DataFrame, column: str) -> DataFrame:
    """The frame with NaN as NULL in a number column; a column of another type cannot hold NaN."""
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return df.withColumn(column, nan_to_null(F.col(column)))
    return df


def clean_features(m: DataFrame, features: str = "features") -> DataFrame:
    """The matrix with NaN as NULL."""
    return m.withColumn(features, F.transform(features, nan_to_null))


def derived_name(name: str) -> str:
    """Name of the transformed version of a feature."""
    return f"{name}_xf"


def derived_names(names: list[str]) -> list[str]:
    return [derived_name(name) for name in names]
