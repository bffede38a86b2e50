"""Cleaning a feature matrix of ``(id, label, features)`` rows, features an array with NULL for a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pivot import vectors_to_cells


def column_stats(m: DataFrame) -> DataFrame:
    """Per position: rows, missing share, mean and population standard deviation of the present values.

    One pass; a task sends one partial result per position, whatever its number of rows.
    """
    x = F.col("x")
    return vectors_to_cells(m).groupBy("idx").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(x.isNull().cast("int")).alias("missing_rate"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
    )


def stats_array(stats: DataFrame, value: Column) -> Column:
    """One value per position as an array, in position order: a scalar subquery, D values long."""
    cells = F.array_sort(F.collect_list(F.struct(F.col("idx"), value.alias("v"))))
    return stats.agg(F.transform(cells, lambda c: c["v"])).scalar()


def missing_rate(features: Column) -> Column:
    missing = F.size(F.filter(features, lambda x: x.isNull()))
    return F.try_divide(missing.cast("double"), F.size(features).cast("double"))


def null_rate_columns(m: DataFrame) -> DataFrame:
    return column_stats(m).select("idx", "missing_rate")


def null_rate_rows(m: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """Missing share of every row beside its label, so that classes can be compared."""
    return m.select(id_col, label, missing_rate(F.col("features")).alias("missing_rate"))


def drop_unlabelled(m: DataFrame, label: str = "label") -> DataFrame:
    return m.filter(F.col(label).isNotNull())


def drop_sparse_columns(m: DataFrame, index: DataFrame | None = None,
                        threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Drop positions whose missing share exceeds the threshold.

    Returns the matrix and its new index: ``idx``, ``old_idx`` and the columns of the given index.
    """
    stats = column_stats(m)
    sparse_enough = F.col("missing_rate") <= F.lit(float(threshold))
    out = m.withColumn("_keep", stats_array(stats, sparse_enough))
    # the arrays are paired position by position; indexing one inside a lambda may evaluate it once per position
    pairs = F.zip_with("features", "_keep", lambda x, keep: F.struct(x.alias("x"), keep.alias("keep")))
    kept_pairs = F.filter(pairs, lambda p: p["keep"])
    out = out.withColumn("features", F.transform(kept_pairs, lambda p: p["x"])).drop("_keep")
    kept = stats.filter(sparse_enough).select("idx")
    order = kept.agg(F.posexplode(F.array_sort(F.collect_list("idx"))).alias("idx", "old_idx"))
    if index is not None:
        order = order.join(index.withColumnRenamed("idx", "old_idx"), "old_idx")
    return out, order


def drop_sparse_rows(m: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Drop rows whose missing share, over the number of columns, exceeds the threshold."""
    return m.filter(missing_rate(F.col("features")) <= F.lit(float(threshold)))


def to_labelled_frame(m: DataFrame, id_col: str = "id", label: str = "label") -> DataFrame:
    """The matrix with an integer label, rows without a label dropped."""
    return drop_unlabelled(m, label).select(id_col, F.col(label).cast("int").alias(label), "features")


def class_counts(m: DataFrame, label: str = "label") -> DataFrame:
    return m.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def majority_class(counts: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent class; the lowest of several."""
    return counts.orderBy(F.col("rows").desc(), F.col(label)).limit(1)
