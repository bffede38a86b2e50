"""Queries on the feature matrix: cleaning, filling, splitting, scaling, balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash_sample
from ..operators import matrix, scale
from ..operators.balance import synthetic_rows, undersample
from ..operators.impute import impute_knn, impute_mean, impute_zero
from ..operators.split import (
    split_buckets, split_exact, split_hash, split_ordered, stratified_folds, take_split)
from ..plans.preparation import preprocess
from ..session import materialize
from ..sources.fixtures import table, view
from . import inputs
from .registry import h32, query

COLUMN_LIMIT = 0.0077
ROW_LIMIT = 0.07


@query("null_rate_cols", "SELECT idx, round(avg((x IS NULL)::INT), 6) AS missing_rate FROM two_class GROUP BY idx",
       steps=("two_class",))
def null_rate_cols(spark, sf_dir):
    rates = matrix.null_rate_columns(inputs.matrix(spark, sf_dir))
    return rates.select(F.col("idx").cast("bigint").alias("idx"), F.round("missing_rate", 6).alias("missing_rate"))


@query("null_rate_rows", """
    SELECT id, label, round(avg((x IS NULL)::INT), 6) AS missing_rate FROM two_class GROUP BY id, label""",
       steps=("two_class",))
def null_rate_rows(spark, sf_dir):
    rates = matrix.null_rate_rows(inputs.matrix(spark, sf_dir))
    return rates.withColumn("missing_rate", F.round("missing_rate", 6))


@query("clean_matrix", """
    SELECT id, CAST(label AS INT) AS label, idx, round(x, 6) AS x FROM fx_matrix WHERE label <> 9""",
       views=("fx_matrix",))
def clean_matrix(spark, sf_dir):
    """Label 9 stands for a missing label."""
    m = inputs.matrix(spark, sf_dir, binary=False)
    gaps = m.withColumn("label", F.nullif(F.col("label"), F.lit(9)))
    return inputs.cells(matrix.to_labelled_frame(gaps), "id", "label")


@query("drop_cols", f"""
    , kept AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new_idx FROM
       (SELECT idx FROM two_class GROUP BY idx HAVING avg((x IS NULL)::INT) <= {COLUMN_LIMIT}))
    SELECT b.id, k.new_idx AS idx, round(b.x, 6) AS x FROM two_class b JOIN kept k ON b.idx = k.idx""", steps=("two_class",))
def drop_cols(spark, sf_dir):
    m, _ = matrix.drop_sparse_columns(inputs.matrix(spark, sf_dir), threshold=COLUMN_LIMIT)
    return inputs.cells(m, "id")


@query("drop_rows", f"""
    SELECT id, idx, round(x, 6) AS x FROM two_class
    WHERE id IN (SELECT id FROM two_class GROUP BY id HAVING avg((x IS NULL)::INT) <= {ROW_LIMIT})""", steps=("two_class",))
def drop_rows(spark, sf_dir):
    return inputs.cells(matrix.drop_sparse_rows(inputs.matrix(spark, sf_dir), ROW_LIMIT), "id")


@query("impute_mean", "SELECT id, idx, round(x, 6) AS x FROM filled", steps=("filled",))
def impute_mean_query(spark, sf_dir):
    return inputs.cells(impute_mean(inputs.matrix(spark, sf_dir)), "id")


@query("impute_zero", "SELECT id, idx, round(coalesce(x, 0), 6) AS x FROM two_class", steps=("two_class",))
def impute_zero_query(spark, sf_dir):
    return inputs.cells(impute_zero(inputs.matrix(spark, sf_dir)), "id")


@query("impute_knn", """
    , gaps AS (SELECT id, idx FROM two_class WHERE x IS NULL),
    asking AS (SELECT DISTINCT id FROM gaps),
    present AS (SELECT id, idx, x FROM two_class WHERE x IS NOT NULL),
    pairs AS (
      SELECT q.id AS q, d.id AS d, round(sqrt((SELECT count(DISTINCT idx) FROM two_class) / count(*) * sum((q.x - d.x)^2)), 9) AS dist
      FROM present q JOIN asking a ON q.id = a.id JOIN present d ON q.idx = d.idx AND q.id <> d.id GROUP BY q.id, d.id),
    ranked AS (
      SELECT g.id, g.idx, p.x, row_number() OVER (PARTITION BY g.id, g.idx ORDER BY pairs.dist, pairs.d) AS rn
      FROM gaps g JOIN pairs ON pairs.q = g.id JOIN present p ON p.id = pairs.d AND p.idx = g.idx),
    near AS (SELECT id, idx, avg(x) AS x FROM ranked WHERE rn <= 5 GROUP BY id, idx)
    SELECT b.id, b.idx, round(coalesce(b.x, n.x, f.x), 6) AS x
    FROM two_class b JOIN filled f ON f.id = b.id AND f.idx = b.idx LEFT JOIN near n ON n.id = b.id AND n.idx = b.idx""",
       steps=("filled",))
def impute_knn_query(spark, sf_dir):
    return inputs.cells(impute_knn(inputs.matrix(spark, sf_dir)), "id")


@query("class_counts", "SELECT label, count(*) AS rows FROM (SELECT DISTINCT id, label FROM fx_matrix) GROUP BY label",
       views=("fx_matrix",))
def class_counts(spark, sf_dir):
    return matrix.class_counts(inputs.matrix(spark, sf_dir, binary=False))


@query("majority_class", """
    SELECT label, count(*) AS rows FROM (SELECT DISTINCT id, label FROM fx_matrix) GROUP BY label
    ORDER BY rows DESC, label LIMIT 1""", views=("fx_matrix",))
def majority_class(spark, sf_dir):
    return matrix.majority_class(matrix.class_counts(inputs.matrix(spark, sf_dir, binary=False)))


@query("split_exact", "SELECT id, label, is_test FROM split_of", steps=("split_of",))
def split_exact_query(spark, sf_dir):
    return split_exact(inputs.matrix(spark, sf_dir)).select("id", "label", "is_test")


@query("split_hash", f"SELECT id, label, {h32("id || ':123'")} / 4294967296.0 < 0.3 AS is_test FROM rows_of",
       steps=("rows_of",))
def split_hash_query(spark, sf_dir):
    return split_hash(inputs.matrix(spark, sf_dir)).select("id", "label", "is_test")


@query("split_ordered", """
    SELECT id, label, row_number() OVER (ORDER BY id) > n - ceil(0.3 * n) AS is_test
    FROM rows_of, (SELECT count(*) AS n FROM rows_of)""", steps=("rows_of",))
def split_ordered_query(spark, sf_dir):
    return split_ordered(inputs.matrix(spark, sf_dir)).select("id", "label", "is_test")


@query("split_2_1", f"""
    SELECT o_orderkey, CASE WHEN {h32("o_orderkey || ':split'")} % 3 < 2 THEN 'train' ELSE 'eval' END AS split
    FROM orders""")
def split_2_1(spark, sf_dir):
    return split_buckets(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("cv_folds", f"""
    SELECT id, label,
      CAST((row_number() OVER (PARTITION BY label ORDER BY {h32("id || ':fold'")}, id) - 1) % 5 AS INT) AS fold
    FROM rows_of""", steps=("rows_of",))
def cv_folds(spark, sf_dir):
    return stratified_folds(inputs.matrix(spark, sf_dir)).select("id", "label", "fold")


@query("hash_sample", f"""
    SELECT o_orderkey, month(o_orderdate) AS order_month, dayofweek(o_orderdate) + 1 AS order_day
    FROM orders WHERE {h32("o_orderkey || ':sample'")} / 4294967296.0 < 0.1""")
def hash_sample_query(spark, sf_dir):
    """Hash-rate sampling is the feature here."""
    return hash_sample(table(spark, sf_dir, "orders"), "o_orderkey", 0.1).select(
        "o_orderkey", F.month("o_orderdate").cast("bigint").alias("order_month"),
        F.dayofweek("o_orderdate").cast("bigint").alias("order_day"))


@query("standardize", """
    , stats AS (
      SELECT f.idx, avg(f.x) AS m, CASE WHEN stddev_pop(f.x) = 0 THEN 1 ELSE stddev_pop(f.x) END AS s
      FROM filled f JOIN split_of p ON p.id = f.id WHERE NOT p.is_test GROUP BY f.idx)
    SELECT f.id, p.is_test, f.idx, round((f.x - s.m) / s.s, 6) AS x
    FROM filled f JOIN split_of p ON p.id = f.id JOIN stats s ON s.idx = f.idx""", steps=("filled", "split_of"))
def standardize(spark, sf_dir):
    parts = take_split(materialize(split_exact(impute_mean(inputs.matrix(spark, sf_dir)))))
    train, test = scale.standardize(*parts)
    return inputs.cells(train.withColumn("is_test", F.lit(False)).unionByName(
        test.withColumn("is_test", F.lit(True))), "id", "is_test")


@query("zscore_features", """
    SELECT o_orderkey, round((o_totalprice - a) / s, 6) AS o_totalprice_xf, round((k - b) / t, 6) AS o_custkey_xf,
      o_orderstatus AS o_orderstatus_xf
    FROM (SELECT *, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey END AS k FROM orders),
      (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s,
         avg(CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey END) AS b,
         stddev_pop(CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE o_custkey END) AS t FROM orders)""")
def zscore_features(spark, sf_dir):
    """Every seventh customer number is made missing; missing counts as 0."""
    gaps = table(spark, sf_dir, "orders").withColumn("o_custkey", F.expr("CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END"))
    scored = scale.zscore_features(gaps, ["o_totalprice", "o_custkey"], label="o_orderstatus")
    return scored.select("o_orderkey", F.round("o_totalprice_xf", 6).alias("o_totalprice_xf"),
                         F.round("o_custkey_xf", 6).alias("o_custkey_xf"), "o_orderstatus_xf")


@query("undersample", f"""
    , train AS (SELECT id, label FROM split_of WHERE NOT is_test),
    ranked AS (
      SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {h32("id || ':7'")}, id) AS rn FROM train),
    few AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM train GROUP BY label))
    SELECT id, label FROM ranked, few WHERE rn <= CASE WHEN label = 1 THEN floor(few.n / 0.5) ELSE few.n END""",
       steps=("split_of",))
def undersample_query(spark, sf_dir):
    train, _ = take_split(split_exact(inputs.matrix(spark, sf_dir)))
    return undersample(train).select("id", "label")


@query("smote", f"""
    , small AS (SELECT id, idx, x FROM filled WHERE label = 0),
    members AS (SELECT id, row_number() OVER (ORDER BY {h32("id || ':smote'")}, id) - 1 AS r, count(*) OVER () AS c
                FROM (SELECT DISTINCT id FROM small)),
    plan AS (SELECT greatest((SELECT c FROM members LIMIT 1),
               CAST(floor(0.5 * (SELECT count(*) FROM rows_of WHERE label = 1)) AS BIGINT))
               - (SELECT c FROM members LIMIT 1) AS n_new),
    near AS (
      SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY dist, d) AS rn
      FROM (SELECT a.id AS q, b.id AS d, round(sqrt(sum((a.x - b.x)^2)), 9) AS dist
            FROM small a JOIN small b ON a.idx = b.idx AND a.id <> b.id GROUP BY a.id, b.id)),
    draws AS (
      SELECT m.id, j, 1 + {h32("'0:' || j || ':1'")} % least(5, c - 1) AS pick, {h32("'0:' || j || ':2'")} / 4294967296.0 AS u
      FROM (SELECT unnest(range(0, n_new)) AS j FROM plan) t JOIN members m ON m.r = j % m.c)
    SELECT 0 AS label, w.j, a.idx, round(a.x + w.u * (b.x - a.x), 6) AS x
    FROM draws w JOIN near n ON n.q = w.id AND n.rn = w.pick
    JOIN small a ON a.id = w.id JOIN small b ON b.id = n.d AND b.idx = a.idx""", steps=("filled", "rows_of"))
def smote_query(spark, sf_dir):
    return inputs.cells(synthetic_rows(impute_mean(inputs.matrix(spark, sf_dir))), "label", "j")


@query("preprocess_mean", f"""
    , cols AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new_idx FROM
        (SELECT idx FROM two_class GROUP BY idx HAVING avg((x IS NULL)::INT) <= 0.0077)),
    c1 AS (SELECT b.id, b.label, k.new_idx AS idx, b.x FROM two_class b JOIN cols k ON b.idx = k.idx),
    c2 AS (SELECT * FROM c1 WHERE id IN (SELECT id FROM c1 GROUP BY id HAVING avg((x IS NULL)::INT) <= 0.0077)),
    f AS (SELECT c2.id, c2.idx, c2.label, coalesce(c2.x, s.mean) AS x
          FROM c2 JOIN (SELECT idx, avg(x) AS mean FROM c2 GROUP BY idx) s ON s.idx = c2.idx),
    ids AS (SELECT DISTINCT id, label FROM f),
    sp AS (SELECT id, label, row_number() OVER (ORDER BY {h32("id || ':123'")}, id)
             <= ceil(0.3 * (SELECT count(*) FROM ids)) AS is_test FROM ids),
    st AS (SELECT f.idx, avg(f.x) AS m, CASE WHEN stddev_pop(f.x) = 0 THEN 1 ELSE stddev_pop(f.x) END AS s
           FROM f JOIN sp ON sp.id = f.id WHERE NOT is_test GROUP BY f.idx)
    SELECT f.id, f.label, sp.is_test, f.idx, round((f.x - st.m) / st.s, 6) AS x
    FROM f JOIN sp ON sp.id = f.id JOIN st ON st.idx = f.idx""", steps=("two_class",))
def preprocess_mean(spark, sf_dir):
    """The whole preparation, with limits tight enough to drop columns and rows."""
    done = preprocess(inputs.matrix(spark, sf_dir), threshold=COLUMN_LIMIT, fill="mean")
    return inputs.cells(done.train.withColumn("is_test", F.lit(False)).unionByName(
        done.test.withColumn("is_test", F.lit(True))), "id", "label", "is_test")


@query("preprocess_knn_smote")
def preprocess_knn_smote(spark, sf_dir):
    """Training rows, filled up with synthetic ones, and test rows."""
    done = preprocess(inputs.matrix(spark, sf_dir), fill="knn", balance="smote", ratio=0.3)
    both = done.train.withColumn("is_test", F.lit(False)).unionByName(done.test.withColumn("is_test", F.lit(True)), allowMissingColumns=True)
    return inputs.cells(both, "id", "label", "synthetic", "is_test")
