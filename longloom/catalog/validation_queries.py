"""Queries on merged profiles, drift, and quality by slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import exceeds_share, moment_parts
from ..operators import drift, metrics, profile, sketches
from ..operators.neighbours import nearest
from ..operators.probing import nearest_probed
from ..operators.split import split_buckets
from ..session import materialize, shared_dir
from ..sources.fixtures import table
from . import inputs
from .registry import h32, query


def _stored_sketches(df, folder, n=3):
    """Sketches of slices by a hash, each written by itself, and read together."""
    slice_of = F.pmod(F.xxhash64(df.columns[0]), F.lit(n))
    for i in range(n):
        sketches.sketch_columns(df.filter(slice_of == i)).write.parquet(f"{folder}/slice={i}")
    return sketches.merge_sketches(df.sparkSession.read.parquet(folder).drop("slice"))


_ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("profile_merged", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, round(avg({x}), 2) AS mean, round(stddev_pop({x}), 2) AS std,
      min({x})::DOUBLE AS min, max({x})::DOUBLE AS max, true AS distinct_close FROM orders"""
    for c, x in (*[(c, c) for c in _ORDER_NUMBERS], ("o_orderdate", "epoch(o_orderdate)"))) + "".join(f"""
    UNION ALL SELECT '{c}', count(*), count(*) - count({c}), NULL, NULL, NULL, NULL, true FROM orders""" for c in ("o_orderstatus", "o_orderpriority")))
def profile_merged(spark, sf_dir):
    """The profile of a table from stored sketches of three slices; distinct counts within 5 percent of the exact ones."""
    orders = table(spark, sf_dir, "orders")
    found = sketches.sketched_profile(_stored_sketches(orders, f"{shared_dir(spark)}/sketches"))
    exact = profile.distinct_counts(orders, orders.columns).withColumnRenamed("distinct_values", "exact")
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.join(exact, "column").select("column", "rows", "missing", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"),
                                              "min", "max", close.alias("distinct_close"))


@query("profile_merged_quantiles", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS probability, count({c}) > 0 AS close FROM lineitem"""
    for c in ("l_orderkey", "l_quantity", "l_extendedprice")))
def profile_merged_quantiles(spark, sf_dir):
    """Whether quantiles of the merged sketches are within two percent of the rows of their ranks."""
    rows, wanted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), (0.05, 0.25, 0.5, 0.75, 0.95)
    found = sketches.sketched_profile(_stored_sketches(rows, f"{shared_dir(spark)}/sketches"), wanted)
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in wanted]).alias("probability"), F.col("quantiles").alias("value")))
    found = materialize(found.select("column", pairs.alias("p")).select("column", "p.probability", "p.value"))
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in rows.columns]))
    ranked = rows.select(values).join(F.broadcast(found), "column").groupBy("column", "probability").agg(  # 15 rows
        F.count("x").alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"), F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    rank, slack = F.col("probability") * F.col("n"), 0.02 * F.col("n") + 1
    return ranked.select("column", "probability", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("close"))


@query("profile_merged_top", """
    WITH vals AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents),
    counted AS (SELECT "column", value, count(*) AS rows FROM vals WHERE value IS NOT NULL GROUP BY ALL)
    SELECT "column", value, rows FROM counted""")
def profile_merged_top(spark, sf_dir):
    """All values of two columns with their rows, from merged summaries."""
    merged = _stored_sketches(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), f"{shared_dir(spark)}/sketches")
    return sketches.sketched_profile(merged, top=500).filter("column != 'doc_id'").select(
        "column", F.explode("top_values").alias("v")).select("column", F.col("v.item").alias("value"), F.col("v.count").alias("rows"))


@query("schema_merged", """
    SELECT "column", type, required, domain FROM (
      SELECT 'c_custkey' AS "column", 'INT' AS type, count(c_custkey) = count(*) AS required, NULL AS domain FROM customer
      UNION ALL SELECT 'c_name', 'STRING', count(c_name) = count(*), NULL FROM customer
      UNION ALL SELECT 'c_nationkey', 'INT', count(c_nationkey) = count(*), NULL FROM customer
      UNION ALL SELECT 'c_acctbal', 'FLOAT', count(c_acctbal) = count(*), NULL FROM customer
      UNION ALL SELECT 'c_mktsegment', 'STRING', count(c_mktsegment) = count(*),
        string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) FROM customer)""")
def schema_merged(spark, sf_dir):
    merged = _stored_sketches(table(spark, sf_dir, "customer"), f"{shared_dir(spark)}/sketches")
    return sketches.sketched_schema(merged).withColumn("domain", F.array_join("domain", "|"))


THRESHOLDS = {"o_orderkey": 0.05, "o_custkey": 0.05, "o_orderstatus": 0.05, "o_totalprice": 0.05, "o_orderdate": 0.05, "o_orderpriority": 0.1}

_SHIFTED = f"""
    WITH parts AS (SELECT *, CASE WHEN {h32("o_orderkey || ':split'")} % 3 < 2 THEN 0 ELSE 1 END AS side FROM orders),
    moved AS (
      SELECT side, o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderstatus,
        CASE WHEN side = 1 THEN o_totalprice * 1.5 ELSE o_totalprice END::DOUBLE AS o_totalprice, epoch(o_orderdate)::DOUBLE AS o_orderdate,
        CASE WHEN side = 1 AND o_orderkey % 4 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM parts)"""


def _js_sql(c: str) -> str:
    return f"""
      SELECT '{c}' AS "column", 'jensen_shannon' AS comparator, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
        + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS distance
      FROM (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM (
        SELECT coalesce(least({drift.BINS - 1}, floor(({c} - low) / nullif(high - low, 0) * {drift.BINS})), 0) AS cell,
          count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b
        FROM moved, (SELECT min({c}) AS low, max({c}) AS high FROM moved) WHERE {c} IS NOT NULL GROUP BY 1))"""


def _linf_sql(c: str) -> str:
    return f"""
      SELECT '{c}', 'l_infinity', max(abs(p - q)) FROM (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM (
        SELECT {c}, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM moved WHERE {c} IS NOT NULL GROUP BY 1))"""


@query("drift", _SHIFTED + """
    SELECT "column", comparator, round(distance, 6) AS distance, threshold, distance > threshold AS drifted FROM (
    """ + " UNION ALL ".join([*map(_js_sql, ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")), *map(_linf_sql, ("o_orderstatus", "o_orderpriority"))])
    + f""") JOIN (VALUES {", ".join(f"('{c}', {t}::DOUBLE)" for c, t in THRESHOLDS.items())}) v(c, threshold) ON c = "column" """)
def drift_query(spark, sf_dir):
    """Two parts of a table, one with higher prices and more urgent orders, against thresholds in the schema of the other."""
    orders = split_buckets(table(spark, sf_dir, "orders"), "o_orderkey")
    left, right = (orders.filter(F.col("split") == s).drop("split") for s in ("train", "eval"))
    right = right.withColumns({"o_totalprice": F.col("o_totalprice") * 1.5, "o_orderpriority": F.when(
        F.col("o_orderkey") % 4 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))})
    schema = drift.with_thresholds(profile.infer_schema(left), THRESHOLDS)
    return drift.drift(left, right, schema).withColumn("distance", F.round("distance", 6))


@query("accuracy_slices", """
    SELECT CASE WHEN grouping(lang) = 1 AND grouping(source) = 1 THEN 'overall' WHEN grouping(source) = 1 THEN 'lang'
        WHEN grouping(lang) = 1 THEN 'source' ELSE 'lang,source' END AS slicing, d.lang, d.source, count(*) AS rows,
      round(avg((label = prediction)::INT), 6) AS accuracy
    FROM preds p JOIN documents d ON d.doc_id = p.doc_id GROUP BY GROUPING SETS ((), (d.lang), (d.source), (d.lang, d.source))""", steps=("preds",))
def accuracy_slices(spark, sf_dir):
    """Overall and sliced accuracy in one pass."""
    rows = inputs.predictions(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return metrics.accuracy_slices(rows, [[], ["lang"], ["source"], ["lang", "source"]]).withColumn("accuracy", F.round("accuracy", 6))


@query("f1_missing", """
    , said AS (SELECT label, CASE WHEN doc_id % 5 <> 0 THEN prediction END AS prediction FROM preds)
    SELECT count(*) FILTER (WHERE label = 1 AND coalesce(prediction, 0) = 1) AS tp,
      count(*) FILTER (WHERE label = 0 AND coalesce(prediction, 0) = 1) AS fp,
      count(*) FILTER (WHERE label = 1 AND coalesce(prediction, 0) <> 1) AS fn FROM said""", steps=("preds",))
def f1_missing(spark, sf_dir):
    """Every fifth prediction is missing."""
    rows = inputs.predictions(spark, sf_dir).withColumn("prediction", F.when(F.col("doc_id") % 5 != 0, F.col("prediction")))
    return metrics.f1_binary(rows).select("tp", "fp", "fn")


@query("impute_knn_probed", """
    SELECT count(*) FILTER (WHERE x IS NULL) AS gaps, true AS measured_recall, true AS recall FROM fx_matrix""", views=("fx_matrix",))
def impute_knn_probed(spark, sf_dir):
    """The neighbours of every missing cell near pivots, against the exact ones: whether nine in ten are found, as measured on
    the sample and over all cells."""
    m = materialize(inputs.matrix(spark, sf_dir))
    asking = m.filter(F.exists("features", lambda x: x.isNull()))
    exact = materialize(nearest(asking, m, {None: (asking.count(), m.count())}, 5, per_gap=True))
    found, seen = nearest_probed(asking, m, 5, True, 2048, 32768, recall=0.95)
    both = exact.select("id", "idx", F.col("best.donor").alias("a")).join(found.select("id", "idx", F.col("best.donor").alias("b")), ["id", "idx"], "left")
    shared = F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<bigint>"))))
    return both.agg(F.count(F.lit(1)).alias("gaps"), F.lit(seen["recall"] >= 0.9).alias("measured_recall"),
                    (F.sum(shared) >= 0.9 * F.sum(F.size("a"))).alias("recall"))


@query("moment_parts", """
    SELECT event_id, month(ts) AS month, hour(ts) AS hour, dayofweek(ts) + 1 AS day_of_week, floor(epoch(ts))::BIGINT AS epoch_seconds,
      CASE WHEN value > user_id * 0.2::DOUBLE THEN 1 ELSE 0 END AS exceeds FROM events""")
def moment_parts_query(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", *[c.alias(n) for n, c in moment_parts(F.col("ts")).items()],
                         exceeds_share(F.col("value"), F.col("user_id"), 0.2).alias("exceeds"))
