"""Queries on gaps and odd inputs: NaN, broken lines, synthetic rows among others, and modes of sources and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import profile, ranking
from ..operators.balance import smote
from ..operators.impute import impute_mean
from ..operators.measurements import label_measurements
from ..operators.split import split_ordered, stratified_folds
from ..session import shared_dir
from ..sources import matrix_csv, tables
from ..sources.fixtures import table
from . import inputs
from .registry import query

_GROWN = """
    , sizes AS (SELECT label, count(*) AS n FROM rows_of GROUP BY label),
    grown AS (SELECT label, CASE WHEN label = 1 THEN n
      ELSE greatest(n, CAST(floor(0.5 * (SELECT n FROM sizes WHERE label = 1)) AS BIGINT)) END AS n FROM sizes)"""


@query("smote_folds", _GROWN + """
    SELECT label, f::INT AS fold, CAST(floor((n - f + 4) / 5) AS BIGINT) AS rows FROM grown, range(5) t(f)""",
       steps=("rows_of",))
def smote_folds(spark, sf_dir):
    """Folds over a balanced training set: every synthetic row is in one."""
    m = smote(impute_mean(inputs.matrix(spark, sf_dir)))
    return stratified_folds(m).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("rows"))


@query("split_ordered_augmented", _GROWN + """
    SELECT sum(n)::BIGINT AS rows, ceil(0.3 * sum(n))::BIGINT AS test_rows,
      least(ceil(0.3 * sum(n)), sum(n) - (SELECT sum(n) FROM sizes))::BIGINT AS synthetic_test_rows FROM grown""",
       steps=("rows_of",))
def split_ordered_augmented(spark, sf_dir):
    """The ordered hold-out of a balanced set begins with the rows that were appended."""
    marked = split_ordered(smote(impute_mean(inputs.matrix(spark, sf_dir))))
    return marked.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"),
        F.count_if(F.col("is_test") & F.col("synthetic").isNotNull()).alias("synthetic_test_rows"))


@query("site_rank_nan", """
    SELECT CpG_probe_id, score AS sum_squares_between_groups FROM scores WHERE cpg_count / samples >= 0.9
    ORDER BY score DESC, CpG_probe_id LIMIT 5000""", steps=("scores",))
def site_rank_nan(spark, sf_dir):
    """Measurements that spell a missing value NaN."""
    meth, *others = inputs.raw(spark, sf_dir)
    nan = meth.withColumn("beta_value", F.coalesce(F.col("beta_value").cast("double"), F.lit(float("nan"))))
    return ranking.rank_sites(label_measurements(nan, *others))


@query("impute_mean_nan", "SELECT id, idx, round(x, 6) AS x FROM filled", steps=("filled",))
def impute_mean_nan(spark, sf_dir):
    m = inputs.matrix(spark, sf_dir)
    nan = m.withColumn("features", F.transform("features", lambda x: F.coalesce(x, F.lit(float("nan")))))
    return inputs.cells(impute_mean(nan), "id")


_LINES = """
    , lines AS (SELECT DISTINCT id FROM fx_matrix)
    SELECT count(*) FILTER (WHERE id % 7 <> 0 AND id % 11 <> 0) AS kept,
      count(*) FILTER (WHERE id % 7 <> 0 AND id % 11 <> 0 AND id % 13 = 0) AS short,
      count(*) FILTER (WHERE id % 7 = 0 OR id % 11 = 0) AS rejected FROM lines"""


@query("csv_rejects", _LINES, views=("fx_matrix",))
def csv_rejects(spark, sf_dir):
    """Every 7th line has a field too many, every 11th text for a number, every 13th of the others ends early."""
    i, target = F.col("id"), f"{shared_dir(spark)}/lines"
    m = inputs.matrix(spark, sf_dir, binary=False).select("id", "label", F.col("features")[0].alias("x"))
    number = F.coalesce(F.col("x").cast("string"), F.lit(""))
    line = F.when(i % 7 == 0, F.concat_ws(",", i, number, F.lit("1"), "label", F.lit("more"))).when(
        i % 11 == 0, F.concat_ws(",", i, number, F.lit("oops"), "label")).when(
        i % 13 == 0, F.concat_ws(",", i, number)).otherwise(F.concat_ws(",", i, number, F.lit("1"), "label"))
    m.select(line.alias("id,f0,f1,label")).write.option("header", True).option("sep", "\u0001").option(
        "quote", "\u0000").option("escape", "\u0000").csv(target)
    good = matrix_csv.read_matrix_parts(spark, [target], "id", ("label",)).agg(
        F.count(F.lit(1)).alias("kept"), F.count_if(F.col("label").isNull()).alias("short"))
    bad = matrix_csv.rejected_lines(spark, [target], "id", ("label",)).agg(F.count(F.lit(1)).alias("rejected"))
    return good.withColumn("rejected", bad.scalar())


@query("csv_first_files", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label, idx, round(x, 6) AS x FROM fx_matrix
    WHERE id % 3 < 2""", views=("fx_matrix",))
def csv_first_files(spark, sf_dir):
    """Vectors written without a column each; of three part folders the first two are asked for."""
    folder, m = shared_dir(spark), inputs.matrix(spark, sf_dir, binary=False)
    width = m.agg(F.max(F.size("features"))).first()[0]
    for i in range(3):
        matrix_csv.write_vectors_csv(m.filter(F.col("id") % 3 == i), [f"f{j}" for j in range(width)], f"{folder}/part-{i}")
    rows = matrix_csv.read_matrix_parts(spark, [f"{folder}/part-{i}" for i in range(3)], "id", ("label",), max_files=2)
    return inputs.cells(matrix_csv.wide_to_vectors(rows, "id", ("label",))[0], "id", "label")


@query("write_new", "SELECT count(*) AS rows, true AS refused FROM nation")
def write_new(spark, sf_dir):
    """A second write to the same place is refused and changes nothing."""
    target, nation = f"{shared_dir(spark)}/nation", table(spark, sf_dir, "nation")
    tables.write_new(nation, target)
    try:
        tables.write_new(nation.limit(1), target)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("rows")).withColumn("refused", F.lit(refused))


@query("schema_infer_orders", """
    SELECT "column", type, required FROM (
      SELECT 'o_orderkey' AS "column", 'INT' AS type, count(o_orderkey) = count(*) AS required FROM orders
      UNION ALL SELECT 'o_custkey', 'INT', count(o_custkey) = count(*) FROM orders
      UNION ALL SELECT 'o_orderstatus', 'STRING', count(o_orderstatus) = count(*) FROM orders
      UNION ALL SELECT 'o_totalprice', 'FLOAT', count(o_totalprice) = count(*) FROM orders
      UNION ALL SELECT 'o_orderdate', any_value(CASE WHEN typeof(o_orderdate) = 'DATE' THEN 'DATE' ELSE 'TIMESTAMP' END),
        count(o_orderdate) = count(*) FROM orders
      UNION ALL SELECT 'o_orderpriority', 'STRING', count(o_orderpriority) = count(*) FROM orders)""")
def schema_infer_orders(spark, sf_dir):
    return profile.infer_schema(table(spark, sf_dir, "orders")).select("column", "type", "required")


@query("profile_embeddings", """
    SELECT 'vec_id' AS "column", 'INT' AS type, count(*) AS rows, count(*) - count(vec_id) AS missing, round(avg(vec_id), 4) AS mean,
      NULL::DOUBLE AS avg_length FROM embeddings
    UNION ALL SELECT 'embedding', 'ARRAY', count(*), count(*) - count(embedding), NULL, round(avg(len(embedding)), 4) FROM embeddings
    UNION ALL SELECT 'label', 'INT', count(*), count(*) - count(label), round(avg(label), 4), NULL FROM embeddings""")
def profile_embeddings(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "embeddings")).select(
        "column", "type", "rows", "missing", F.round("mean", 4).alias("mean"), F.round("avg_length", 4).alias("avg_length"))


@query("anomalies_lost_date", """SELECT 'o_orderdate' AS "column", 'missing_column' AS anomaly, 0::BIGINT AS rows
    FROM orders HAVING count(o_orderdate) > 0""")
def anomalies_lost_date(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return profile.anomalies(orders.drop("o_orderdate"), profile.infer_schema(orders))


@query("quantile_ranks", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", unnest([0.25, 0.5, 0.75])::DOUBLE AS probability, count({c}) > 0 AS close FROM lineitem"""
    for c in ("l_orderkey", "l_quantity", "l_extendedprice")))
def quantile_ranks(spark, sf_dir):
    """Whether the approximate quantiles are within a ten-thousandth of the rows of their rank, and two rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    found = profile.profile_quantiles(rows)
    values = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in rows.columns]))
    ranked = rows.select(values).join(F.broadcast(found), "column").groupBy("column", "probability").agg(  # 9 rows
        F.count("x").alias("n"), F.count_if(F.col("x") < F.col("value")).alias("below"),
        F.count_if(F.col("x") <= F.col("value")).alias("upto"))
    slack, rank = F.col("n") / 10_000 + 2, F.col("probability") * F.col("n")
    return ranked.select("column", "probability", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("close"))
