"""How far two samples of a table are apart, column by column, against thresholds that the schema holds.

Texts are compared by the largest difference of a value's share (L-infinity), numbers by the Jensen-Shannon divergence, in
bits, of their histograms over common edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import _as_number, _kinds

BINS = 20
L_INFINITY, JENSEN_SHANNON = "l_infinity", "jensen_shannon"


def with_thresholds(schema: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """A schema with ``comparator`` and ``threshold`` of the named columns, by type; NULL for the others.

    A name that the schema does not have and a type that cannot be compared are errors.
    """
    kinds = {r["column"]: r["type"] for r in schema.select("column", "type").collect()}  # a row for each column
    comparators = {}
    for name in thresholds:
        if name not in kinds:
            raise ValueError(f"the schema has no column {name}")
        if kinds[name] not in ("STRING", "BOOL", "INT", "FLOAT", "DATE", "TIMESTAMP"):
            raise ValueError(f"{name}: {kinds[name]} columns cannot be compared")
        comparators[name] = L_INFINITY if kinds[name] in ("STRING", "BOOL") else JENSEN_SHANNON
    spec = schema.sparkSession.createDataFrame([(n, c, float(thresholds[n])) for n, c in comparators.items()],
                                               "column string, comparator string, threshold double")
    return schema.drop("comparator", "threshold").join(F.broadcast(spec), "column", "left")  # a row for each column


def _shares(counts: DataFrame) -> DataFrame:
    """``column, cell, p, q``: each side's share of every cell that either side has."""
    sides = counts.groupBy("column", "cell").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"),
                                                 F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b"))
    totals = sides.groupBy("column").agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    both = sides.join(totals, "column")
    return both.select("column", "cell", F.try_divide("a", "all_a").alias("p"), F.try_divide("b", "all_b").alias("q"))


def _entropy_part(x: Column, m: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / m)).otherwise(F.when(x.isNotNull(), 0.0))


def distances(left: DataFrame, right: DataFrame, comparators: dict[str, str], bins: int = BINS) -> DataFrame:
    """``column, comparator, distance``. Missing values and NaN count for neither side; a side without values has no distance.

    Values are counted inside tasks before they move: histogram cells of numbers, distinct values of texts.
    """
    texts = [n for n, c in comparators.items() if c == L_INFINITY]
    numbers = [n for n, c in comparators.items() if c == JENSEN_SHANNON]
    kinds = _kinds(left)

    def listed(df: DataFrame, side: int, names: list[str], value) -> DataFrame:
        pairs = F.inline(F.array(*[F.struct(F.lit(n).alias("column"), value(n).alias("value")) for n in names]))
        return df.select(pairs).filter(F.col("value").isNotNull()).withColumn("side", F.lit(side))

    out = []
    if texts:
        values = [listed(df, i, texts, lambda n: F.col(f"`{n}`").cast("string")) for i, df in enumerate((left, right))]
        counts = values[0].unionByName(values[1]).groupBy("column", "side", F.col("value").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        out.append(_shares(counts).groupBy("column").agg(F.max(F.abs(F.col("p") - F.col("q"))).alias("distance"))
                   .withColumn("comparator", F.lit(L_INFINITY)))
    if numbers:
        def number(n: str) -> Column:
            x = _as_number(F.col(f"`{n}`"), kinds[n])
            return F.when(~F.isnan(x), x)

        values = [listed(df, i, numbers, number) for i, df in enumerate((left, right))]
        both = values[0].unionByName(values[1])
        ends = both.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
        # a row for each column
        placed = both.join(F.broadcast(ends), "column").select(
            "column", "side", F.coalesce(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * bins)),
                                         F.lit(0)).alias("cell"))
        shares = _shares(placed.groupBy("column", "side", "cell").agg(F.count(F.lit(1)).alias("n")))
        m = (F.col("p") + F.col("q")) / 2
        js = F.sum((_entropy_part(F.col("p"), m) + _entropy_part(F.col("q"), m)) / 2)
        out.append(shares.groupBy("column").agg(js.alias("distance")).withColumn("comparator", F.lit(JENSEN_SHANNON)))
    if not out:
        return left.sparkSession.createDataFrame([], "column string, comparator string, distance double")
    found = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    return found.select("column", "comparator", "distance")


def drift(left: DataFrame, right: DataFrame, schema: DataFrame, bins: int = BINS) -> DataFrame:
    """``column, comparator, distance, threshold, drifted`` for each column with a threshold.

    A column that either side has no values in has a NULL distance, and has drifted; one that a side does not have is an error.
    """
    spec = schema.filter(F.col("threshold").isNotNull()).select("column", "comparator", "threshold")
    comparators = {r["column"]: r["comparator"] for r in spec.collect()}  # a row for each column
    for name in comparators:
        if name not in left.columns or name not in right.columns:
            raise ValueError(f"both sides need the column {name}")
    found = spec.join(distances(left, right, comparators, bins).drop("comparator"), "column", "left")
    return found.select("column", "comparator", "distance", "threshold",
                        F.coalesce(F.col("distance") > F.col("threshold"), F.lit(True)).alias("drifted"))
