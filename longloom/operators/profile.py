"""Statistics of a frame, the schema they suggest, and departures from a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "BOOL"
    if isinstance(dtype, T.IntegralType):
        return "INT"
    if isinstance(dtype, T.NumericType):
        return "FLOAT"
    for kind, name in _OTHER.items():
        if isinstance(dtype, kind):
            return name
    return "STRING" if isinstance(dtype, T.StringType) else dtype.typeName().upper()


_OTHER = {T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.ArrayType: "ARRAY",
          T.MapType: "MAP", T.StructType: "STRUCT", T.BinaryType: "BINARY"}


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: _kind(f.dataType) for f in df.schema}


def _as_number(col: Column, kind: str) -> Column | None:
    """A value as a number: dates and times are seconds since 1970."""
    if kind in ("INT", "FLOAT"):
        return col.cast("double")
    if kind == "BOOL":
        return col.cast("int").cast("double")
    if kind in ("DATE", "TIMESTAMP"):
        return F.unix_micros(col.cast("timestamp")) / F.lit(1e6)
    return None


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing, zeros, mean, deviation, least and greatest value, length.

    Dates and times are counted in seconds since 1970. The length is that of texts, binaries, arrays and maps. Columns
    of other types have their rows and missing values counted.

    All columns are aggregated in a single pass over the data, one partial row per task.
    """
    kinds = _kinds(df)
    none = F.lit(None).cast("double")
    measures: list[Column] = []
    for i, (name, kind) in enumerate(kinds.items()):
        col = F.col(f"`{name}`")
        numbers, text, x = [none] * 5, none, _as_number(col, kind)
        if x is not None:
            numbers = [F.avg(x), F.stddev_pop(x), F.min(x), F.max(x), F.count_if(x == 0).cast("double")]
        elif kind in ("STRING", "BINARY"):
            text = F.avg(F.length(col))
        elif kind in ("ARRAY", "MAP"):
            text = F.avg(F.when(col.isNotNull(), F.size(col)))
        row = F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("type"), F.count(F.lit(1)).alias("rows"),
            F.count_if(col.isNull()).alias("missing"), numbers[0].alias("mean"), numbers[1].alias("std"),
            numbers[2].alias("min"), numbers[3].alias("max"), numbers[4].cast("bigint").alias("zeros"),
            text.alias("avg_length"))
        measures.append(row.alias(f"c{i}"))
    one = df.agg(*measures)
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(measures))])))


def profile_quantiles(df: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
                      accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles of the number, date and time columns, off by at most ``rows / accuracy`` ranks; sketches merge, so one
    pass does and no column is sorted."""
    kinds = {n: kind for n, kind in _kinds(df).items() if kind in ("INT", "FLOAT", "DATE", "TIMESTAMP")}
    names = list(kinds)
    wanted = F.array(*[F.lit(p) for p in probabilities])
    one = df.agg(*[F.percentile_approx(_as_number(F.col(f"`{n}`"), kinds[n]), wanted, accuracy).alias(f"c{i}")
                   for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("q")) for i, n in enumerate(names)])
    out = one.select(F.inline(rows))
    labels = F.array(*[F.lit(p) for p in probabilities])
    pairs = F.explode(F.arrays_zip(labels.alias("probability"), F.col("q").alias("value")))
    return out.select("column", pairs.alias("p")).select("column", F.col("p.probability").alias("probability"),
                                                         F.col("p.value").alias("value"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, rows)`` for every distinct value of the columns, NULL left out."""
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(pairs).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("rows"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact number of distinct values per column."""
    return value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def top_values(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The n most frequent values per column, ties to the lower value.

    The rank limit is applied within tasks before the shuffle, so a column of many values sends n per task.
    """
    best_first = W.partitionBy("column").orderBy(F.col("rows").desc(), F.col("value"))
    ranked = value_counts(df, columns).withColumn("rank", F.row_number().over(best_first))
    return ranked.filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def infer_schema(df: DataFrame, max_domain: int = 20) -> DataFrame:
    """The schema a frame suggests: per column its type, whether it is always there, and for a text column of few
    values the sorted list of them."""
    stats = profile(df).select("column", "type", (F.col("missing") == 0).alias("required"))
    text = [n for n, kind in _kinds(df).items() if kind == "STRING"]
    if not text:
        return stats.withColumn("domain", F.lit(None).cast("array<string>"))
    # columns of clearly more values (all texts of a corpus, say) are left out before their values are shuffled
    rough = df.agg(*[F.approx_count_distinct(F.col(f"`{n}`")).alias(n) for n in text]).first()
    text = [n for n in text if rough[n] <= 2 * max_domain]
    if not text:
        return stats.withColumn("domain", F.lit(None).cast("array<string>"))
    # at most max_domain + 1 values per column reach the array
    some = W.partitionBy("column").orderBy("value")
    few = value_counts(df, text).withColumn("_n", F.row_number().over(some)).filter(F.col("_n") <= max_domain + 1)
    domains = few.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("domain"))
    domains = domains.filter(F.size("domain") <= max_domain)
    # one row per column of the frame
    return stats.join(F.broadcast(domains), "column", "left")


def anomalies(df: DataFrame, schema: DataFrame) -> DataFrame:
    """``(column, anomaly, rows)``: where a frame departs from an inferred schema.

    ``missing_column``, ``new_column``, ``type_change``, ``missing_values`` in a required column, and
    ``unexpected_value`` outside a text column's domain, with the number of rows concerned.
    """
    stats = profile(df).select("column", F.col("type").alias("new_type"), "missing", F.lit(True).alias("here"))
    both = schema.withColumn("known", F.lit(True)).join(stats, "column", "full")

    def found(name: str, condition: Column, rows: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("anomaly"), rows.cast("bigint").alias("rows")))

    nothing = F.lit(0)
    checks = F.array(
        found("missing_column", F.col("here").isNull(), nothing),
        found("new_column", F.col("known").isNull(), nothing),
        found("type_change", F.col("type") != F.col("new_type"), nothing),
        found("missing_values", F.col("required") & (F.col("missing") > 0), F.col("missing")))
    structural = both.select("column", F.inline(F.array_compact(checks)))
    text = [n for n, kind in _kinds(df).items() if kind == "STRING"]
    if not text:
        return structural
    domains = schema.filter(F.col("domain").isNotNull()).select("column", "domain")
    pairs = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in text]))
    outside = (
        df.select(pairs).join(F.broadcast(domains), "column")  # one row per column of the schema
        .filter(~F.array_contains("domain", F.col("value")))
        .groupBy("column").agg(F.count(F.lit(1)).alias("rows"))
        .select("column", F.lit("unexpected_value").alias("anomaly"), "rows"))
    return structural.unionByName(outside)


def compare_profiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """Statistics of two frames side by side, such as train and eval."""
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return profile(df).select("column", *[F.col(c).alias(f"{c}_{suffix}") for c in ("missing", "mean", "std")])

    return side(left, "left").join(side(right, "right"), "column", "full")
