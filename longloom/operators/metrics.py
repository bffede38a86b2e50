"""Model quality from (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def confusion(df: DataFrame, classes: list[int], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction) pair of the listed classes, pairs that never occur as 0.

    Other values are not listed classes and are not counted.
    """
    cells = [(a, b) for a in classes for b in classes]
    counts = df.agg(*[
        F.count_if((F.col(label) == a) & (F.col(prediction) == b)).alias(f"c{i}") for i, (a, b) in enumerate(cells)])
    rows = F.array(*[
        F.struct(F.lit(a).alias(label), F.lit(b).alias(prediction), F.col(f"c{i}").alias("rows"))
        for i, (a, b) in enumerate(cells)])
    return counts.select(F.inline(rows))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def f1_binary(df: DataFrame, label: str = "label", prediction: str = "prediction", positive: int = 1) -> DataFrame:
    """One row: F1 of the positive class; 0 when it neither occurs nor is predicted. A missing prediction is not positive, nor
    is a missing label."""
    is_true, is_said = (F.coalesce(F.col(c) == positive, F.lit(False)) for c in (label, prediction))
    counts = df.agg(
        F.count_if(is_true & is_said).alias("tp"),
        F.count_if(~is_true & is_said).alias("fp"),
        F.count_if(is_true & ~is_said).alias("fn"))
    return counts.select("tp", "fp", "fn", _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def f1_weighted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: F1 of every true class, weighted by its number of rows."""
    pairs = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    # each pair counts once for its label and once for its prediction; equal ones are the hits
    sides = pairs.select("n", F.inline(F.array(
        F.struct(F.col(label).alias("c"), F.lit(True).alias("is_label"), (F.col(label) == F.col(prediction)).alias("hit")),
        F.struct(F.col(prediction).alias("c"), F.lit(False).alias("is_label"), F.lit(False).alias("hit")))))
    n = F.col("n")
    by_class = sides.groupBy("c").agg(
        F.coalesce(F.sum(F.when(F.col("is_label"), n)), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("is_label"), n)), F.lit(0)).alias("said"),
        F.coalesce(F.sum(F.when(F.col("hit"), n)), F.lit(0)).alias("tp"))
    score = _f1(F.col("tp"), F.col("said") - F.col("tp"), F.col("support") - F.col("tp"))
    return by_class.agg(ratio(F.sum(score * F.col("support")), F.sum("support")).alias("f1_weighted"))


def accuracy(df: DataFrame, by: list[str] | None = None, label: str = "label",
             prediction: str = "prediction") -> DataFrame:
    """Share of right predictions, overall or per slice; a row without a prediction or label is not right."""
    right = F.avg(F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("int")).alias("accuracy")
    rows = F.count(F.lit(1)).alias("rows")
    return df.groupBy(*by).agg(rows, right) if by else df.agg(rows, right)


def accuracy_slices(df: DataFrame, slicings: list[list[str]], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``slicing``, the slicing columns, ``rows, accuracy`` of several slicings in one pass over the rows; ``[]`` is all rows.

    ``slicing`` names the columns of a row's slicing, joined by commas, ``overall`` without any; other columns are NULL. Rows
    where a slicing column is NULL are a slice of their own.
    """
    names = list(dict.fromkeys(c for s in slicings for c in s))
    right = F.coalesce(F.col(label) == F.col(prediction), F.lit(False)).cast("int")
    measures = [F.count(F.lit(1)).alias("rows"), F.avg("_right").alias("accuracy")]
    rows = df.select(*names, right.alias("_right"))
    if not names:
        return rows.agg(*measures).select(F.lit("overall").alias("slicing"), "rows", "accuracy")
    own = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in names])
    sets = [[F.col(c) for c in names if c in s] for s in slicings]
    found = rows.groupingSets(sets, *names).agg(F.when(own == "", "overall").otherwise(own).alias("slicing"), *measures)
    return found.select("slicing", *names, "rows", "accuracy")


# A model passes at this accuracy, and when it is not this much worse than the one before.
MIN_ACCURACY = 0.6
MIN_CHANGE = -1e-10


def bless(candidate: DataFrame, baseline: DataFrame | None = None, min_accuracy: float = MIN_ACCURACY,
          min_change: float = MIN_CHANGE) -> DataFrame:
    """One row saying whether a candidate model may replace the baseline.

    Both frames are ``accuracy`` results. It takes an accuracy of at least ``min_accuracy`` and, when there is a
    baseline, a change greater than ``min_change``.
    """
    before = baseline.select("accuracy").scalar() if baseline is not None else F.lit(None).cast("double")
    out = candidate.select("accuracy").withColumn("baseline_accuracy", before)
    change = F.col("accuracy") - F.col("baseline_accuracy")
    good = (F.col("accuracy") >= F.lit(min_accuracy)) & F.coalesce(change > F.lit(min_change), F.lit(True))
    return out.withColumn("change", change).withColumn("blessed", F.coalesce(good, F.lit(False)))
