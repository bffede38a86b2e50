"""Profiles that merge: sketches of every column, stored for each slice of a table.

One pass over a slice gives a row for each column: counts, moments, extremes, a KLL sketch of its numbers, an HLL sketch of its
values, and a summary of its most frequent values. Rows of any slices merge into those of all of them together, from which
quantiles, distinct counts, frequent values and a schema come without the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profile import _as_number, _kinds

KLL_K = 400  # ranks are off by about 0.7 % of the rows
HLL_BITS = 14  # distinct counts are off by about 0.8 %
ITEMS = 1000  # values that a summary follows; with fewer distinct ones it is exact


def sketch_columns(df: DataFrame, kll_k: int = KLL_K, hll_bits: int = HLL_BITS, items: int = ITEMS) -> DataFrame:
    """One row per column: ``column, type, rows, missing, zeros, n, mean, m2, min, max, kll, hll, top``.

    Numbers, dates and times (in seconds since 1970) have ``n`` to ``kll``, where NaN is a missing value; all columns of plain
    types have ``hll`` and ``top``, columns of other types their rows and missing values only.
    """
    measures, kinds = [], _kinds(df)
    for i, (name, kind) in enumerate(kinds.items()):
        col = F.col(f"`{name}`")
        x, plain = _as_number(col, kind), kind not in ("ARRAY", "MAP", "STRUCT", "BINARY", "VARIANT")
        if x is not None:
            x = F.when(~F.isnan(x), x)
        missing = F.count_if(col.isNull() if x is None else x.isNull())
        none, blob = F.lit(None).cast("double"), F.lit(None).cast("binary")
        value = col.cast("string") if plain else F.lit(None).cast("string")
        if x is not None:
            value = F.when(x.isNotNull(), value)
        # a sum of squares about the mean, as a variance times its rows
        numbers = [F.count(x), F.avg(x), F.var_pop(x) * F.count(x), F.min(x), F.max(x), F.kll_sketch_agg_double(x, kll_k), F.count_if(x == 0)] \
            if x is not None else [F.lit(0).cast("bigint"), none, none, none, none, blob, F.lit(0).cast("bigint")]
        top = F.call_function("approx_top_k_accumulate", value, F.lit(items))
        measures.append(F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("type"), F.count(F.lit(1)).alias("rows"), missing.alias("missing"),
            numbers[6].alias("zeros"), numbers[0].alias("n"), numbers[1].alias("mean"), numbers[2].alias("m2"), numbers[3].alias("min"),
            numbers[4].alias("max"), numbers[5].alias("kll"), F.hll_sketch_agg(value, hll_bits).alias("hll"), top.alias("top")).alias(f"c{i}"))
    one = df.agg(*measures)
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(measures))])))


def merge_sketches(parts: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows that ``sketch_columns`` would have made of all slices together, up to the sketches' own errors.

    Slices that disagree about a column's type have the types joined by ``|``.
    """
    whole = W.partitionBy("column")
    mean = F.try_divide(F.sum(F.col("mean") * F.col("n")).over(whole), F.sum("n").over(whole))
    parts = parts.withColumn("_mean", mean)
    spread = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0)))
    return parts.groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"), *[F.sum(c).alias(c) for c in ("rows", "missing", "zeros", "n")],
        F.max("_mean").alias("mean"), spread.alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.when(F.sum("n") > 0, F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("kll")))).alias("kll"),
        F.hll_union_agg("hll").alias("hll"), F.call_function("approx_top_k_combine", "top", F.lit(items)).alias("top"))


def sketched_profile(merged: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """``column, type, rows, missing, zeros, mean, std, min, max, distinct_values, quantiles, top_values``.

    Distinct values and quantiles are estimates; the counts of the frequent values are exact for columns of fewer distinct
    values than the summary follows. Without numbers there are no quantiles.
    """
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged.select(
        "column", "type", "rows", "missing", "zeros", "mean", F.sqrt(F.try_divide("m2", "n")).alias("std"), "min", "max",
        F.hll_sketch_estimate("hll").alias("distinct_values"),
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("kll", wanted)).alias("quantiles"),
        F.slice(_frequent(top), 1, top).alias("top_values"))


def _frequent(n: int) -> Column:
    """The ``n`` most frequent values, or one more; the summary counts NULL as a value, which is left out."""
    return F.filter(F.call_function("approx_top_k_estimate", "top", F.lit(n + 1)), lambda x: x["item"].isNotNull())


def rank_of(merged: DataFrame, column: str, value: float) -> DataFrame:
    """One row: the share of a column's numbers up to a value, from the sketch."""
    own = merged.filter((F.col("column") == column) & (F.col("n") > 0))
    return own.select(F.kll_sketch_get_rank_double("kll", F.lit(float(value))).alias("rank"))


def sketched_schema(merged: DataFrame, max_domain: int = 20) -> DataFrame:
    """The schema that ``infer_schema`` suggests, from sketches: type, whether always there, and the values of a text column
    of at most ``max_domain``, fewer than the summary follows."""
    items = _frequent(max_domain + 1)
    domain = F.array_sort(F.transform(items, lambda x: x["item"]))
    # a summary that has lost values knows frequent ones only, whose rows don't add up
    whole = F.aggregate(items, F.lit(0).cast("bigint"), lambda n, x: n + x["count"]) == F.col("rows") - F.col("missing")
    few = (F.col("type") == "STRING") & (F.size(domain) <= max_domain) & (F.hll_sketch_estimate("hll") <= 2 * max_domain) & whole
    few = few & (F.col("rows") > F.col("missing"))
    return merged.select("column", "type", (F.col("missing") == 0).alias("required"), F.when(few, domain).alias("domain"))
