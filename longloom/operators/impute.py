"""Filling missing matrix values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean_features
from ..session import materialize
from .matrix import column_stats, stats_array
from .neighbours import SPLIT_ROWS, block_rows_for, nearest
from .pivot import cells_to_vectors
from .probing import nearest_probed


def _fill(m: DataFrame, values: Column) -> DataFrame:
    """Replace missing values by those at the same position of an array."""
    filled = m.withColumn("_fill", values)
    return filled.withColumn(
        "features", F.zip_with("features", "_fill", lambda x, v: F.coalesce(x, v))).drop("_fill")


def impute_mean(m: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Column means, of this matrix or of ``fit_on``. A column without any value stays missing."""
    m = clean_features(m)
    return _fill(m, stats_array(column_stats(m if fit_on is None else clean_features(fit_on)), F.col("mean")))


def impute_zero(m: DataFrame) -> DataFrame:
    return clean_features(m).withColumn("features", F.transform("features", lambda x: F.coalesce(x, F.lit(0.0))))


def _has_gap(features: Column) -> Column:
    return F.exists(features, lambda x: x.isNull())


def knn_cells(m: DataFrame, k: int = 5, fit_on: DataFrame | None = None, block_rows: int | None = None,
              split_rows: int = SPLIT_ROWS, recall: float | None = None) -> DataFrame:
    """``(id, idx, x)`` for every missing cell that has a donor: the mean over its k nearest donors.

    A donor has a value at the position and shares another with the row. Equal distances go to the lower id. With ``recall``
    donors are looked for near pivots only, so that this share of the nearest is found (see ``probing``).
    """
    donors = m if fit_on is None else fit_on
    asking = m.filter(_has_gap(F.col("features")))
    known = donors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("features")).alias("width")).first()
    block_rows = block_rows or block_rows_for(known["width"] or 0)
    if recall is not None:
        best, _ = nearest_probed(asking, donors, k, True, block_rows, split_rows, recall)
    else:
        sizes = {None: (asking.count(), known["rows"])}
        best = nearest(asking, donors, sizes, k, per_gap=True, block_rows=block_rows, split_rows=split_rows)
    total = F.aggregate("best", F.lit(0.0), lambda acc, b: acc + b["value"])
    return best.select("id", "idx", (total / F.size("best")).alias("x"))


def impute_knn(m: DataFrame, k: int = 5, fit_on: DataFrame | None = None, stored: bool = False, block_rows: int | None = None,
               split_rows: int = SPLIT_ROWS, recall: float | None = None) -> DataFrame:
    """Fill each missing cell from the k nearest rows that have it, else by the column mean.

    The matrix is read several times (questions, candidates, means, filling), so it is written out first unless it is
    ``stored`` already, without NaN. NaN is a missing value for all ways of filling.
    """
    m = m if stored else materialize(clean_features(m))
    donors = m if fit_on is None else clean_features(fit_on)
    cells = knn_cells(m, k, fit_on, block_rows, split_rows, recall)
    length = donors.agg(F.max(F.size("features"))).scalar()
    fills = cells_to_vectors(cells, "id", length).withColumnRenamed("features", "_near")
    out = m.join(fills, "id", "left")
    near = F.when(F.col("_near").isNull(), F.col("features")).otherwise(
        F.zip_with("features", "_near", lambda x, v: F.coalesce(x, v)))
    return impute_mean(out.withColumn("features", near).select(*m.columns), fit_on=donors)


def impute(m: DataFrame, strategy: str = "knn", **options) -> DataFrame:
    """``knn``, ``mean`` (also called ``simple``) or ``zero``."""
    how = {"knn": impute_knn, "mean": impute_mean, "simple": impute_mean, "zero": impute_zero}
    return how[strategy](m, **options)
