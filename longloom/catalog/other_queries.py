"""Queries on the ad log, sources and sinks, validation, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kv import query_param, truthy
from ..operators import metrics, profile
from ..operators.adlog import ID_PARAM, ad_metrics, attach_first_id, first_id, request_ids
from ..operators.impute import impute_mean
from ..operators.ranking import site_counts
from ..operators.split import split_buckets, split_exact, take_split
from ..plans import registry, training
from ..session import shared_dir
from ..sources import matrix_csv, tables
from ..sources.fixtures import table, view
from . import inputs
from .registry import h32, query

# ---------------------------------------------------------------- ad log

_PARSED = """list_filter(list_transform(string_split(AllRequestKv, '&'),
      lambda p: [url_decode(split_part(p,'=',1)), url_decode(substr(p, strpos(p,'=')+1))]),
      lambda e: e[1] = 'am_crmid' AND length(e[2]) > 0)[-1][2]"""

_METRICS = """
    , joined AS (
      SELECT f.FreewheelId, a.MaxAds, a.AdsSelected, a.AdDuration, a.MaxDuration,
        CASE WHEN EventName = 'defaultImpression' THEN 1 ELSE 0 END AS s, CASE WHEN EventName = '_q_complete' THEN 1 ELSE 0 END AS e
      FROM fx_ad_log a LEFT JOIN ad_first f ON a.UniqueIdentifier = f.UniqueIdentifier),
    sums AS (
      SELECT FreewheelId AS FreewheelID, coalesce(sum(MaxAds),0)::BIGINT AS MaxAds,
        coalesce(sum(AdsSelected),0)::BIGINT AS AdsSelected, coalesce(sum(AdDuration),0)::BIGINT AS AdDuration,
        coalesce(sum(MaxDuration),0)::BIGINT AS MaxDuration, sum(s)::BIGINT AS AdStarted, sum(e)::BIGINT AS AdEnded
      FROM joined WHERE FreewheelId IS NOT NULL AND FreewheelId <> '' GROUP BY FreewheelId)
    SELECT *, round(CASE WHEN AdStarted <> 0 THEN 1 - AdEnded / AdStarted END, 6) AS PercentExitAdBreaks,
      round(CASE WHEN MaxAds <> 0 THEN AdsSelected / MaxAds END, 6) AS AdServedVSAdRequested FROM sums"""


def _rounded_metrics(df):
    return df.withColumns({c: F.round(c, 6) for c in ("PercentExitAdBreaks", "AdServedVSAdRequested")})


@query("ad_metrics", _METRICS, steps=("ad_first",))
def ad_metrics_query(spark, sf_dir):
    return _rounded_metrics(ad_metrics(view(spark, sf_dir, "fx_ad_log")))


@query("ad_ids", f"""
    SELECT DISTINCT UniqueIdentifier, {_PARSED} AS FreewheelId FROM fx_ad_log
    WHERE AllRequestKv IS NOT NULL AND length(AllRequestKv) > 0""", views=("fx_ad_log",))
def ad_ids(spark, sf_dir):
    return request_ids(view(spark, sf_dir, "fx_ad_log"))


@query("ad_first_id", "SELECT * FROM ad_first", steps=("ad_first",))
def ad_first_id(spark, sf_dir):
    return first_id(view(spark, sf_dir, "fx_ad_log"))


@query("ad_first_match", """
    SELECT a.*, f.FreewheelId FROM fx_ad_log a LEFT JOIN ad_first f ON a.UniqueIdentifier = f.UniqueIdentifier""",
       steps=("ad_first",))
def ad_first_match(spark, sf_dir):
    return attach_first_id(view(spark, sf_dir, "fx_ad_log"))


@query("query_param_page_urls", """
    SELECT page_id, list_filter(list_transform(string_split(split_part(url, '?', 2), '&'),
      lambda p: [url_decode(split_part(p,'=',1)), url_decode(substr(p, strpos(p,'=')+1))]),
      lambda e: e[1] = 'id' AND length(e[2]) > 0)[-1][2] AS id FROM pages""")
def query_param_page_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", query_param(F.split_part("url", F.lit("?"), F.lit(2)), "id").alias("id"))


# ---------------------------------------------------------------- sources and sinks

@query("scan_table", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def scan_table(spark, sf_dir):
    df = tables.scan_table(spark, f"{sf_dir}/lineitem.parquet")
    return df.filter(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_quantity")


@query("scan_query", """
    SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM customer
    WHERE c_acctbal > 0 GROUP BY c_mktsegment""")
def scan_query(spark, sf_dir):
    return tables.scan_query(spark, """
        SELECT c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM {customer}
        WHERE c_acctbal > :least GROUP BY c_mktsegment""", {"least": 0}, customer=table(spark, sf_dir, "customer"))


@query("sql_template", """
    SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus""")
def sql_template(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("longloom_orders")
    return tables.query_template(spark, """
        SELECT o_orderstatus, count(*) AS orders FROM IDENTIFIER(:orders_table)
        WHERE o_orderpriority = :priority GROUP BY o_orderstatus""",
        {"orders_table": "longloom_orders"}, {"priority": "1-URGENT"})


@query("ctas_replace", "SELECT CpG_probe_id, count(beta_value) AS cpg_count FROM betas GROUP BY CpG_probe_id",
       steps=("betas",))
def ctas_replace(spark, sf_dir):
    target = f"{shared_dir(spark)}/site_counts"
    tables.replace_table(table(spark, sf_dir, "nation"), target)
    return tables.replace_table(site_counts(inputs.labelled(spark, sf_dir)), target)


# The declared schemas of the two result tables.
BETAS_SCHEMA = ("case_barcode:STRING, beta_value:FLOAT, CpG_probe_id:STRING, aliquot_barcode:STRING, "
                "sample_id:STRING, sample_status:STRING, row_number:INTEGER")
METRICS_SCHEMA = ("FreewheelID:STRING, MaxAds:INTEGER, AdsSelected:INTEGER, AdDuration:INTEGER, MaxDuration:INTEGER, "
                  "AdStarted:INTEGER, AdEnded:INTEGER, PercentExitAdBreaks:FLOAT, AdServedVSAdRequested:FLOAT")
SMALL_BUCKETS = {"start": 1, "end": 11000, "size": 10}


@query("write_truncate", "SELECT * FROM betas", steps=("betas",))
def write_truncate(spark, sf_dir):
    return tables.write_declared(inputs.betas(spark, sf_dir), f"{shared_dir(spark)}/betas", BETAS_SCHEMA)


@query("range_bucket", """
    SELECT CASE WHEN row_number >= 1 AND row_number < 10991 THEN CAST((row_number - 1) // 10 AS INT) END AS rn_bucket,
      count(*) AS rows, min(row_number) AS first_number, max(row_number) AS last_number FROM betas GROUP BY 1""",
       steps=("betas",))
def range_bucket(spark, sf_dir):
    target = f"{shared_dir(spark)}/bucketed"
    tables.write_bucketed(inputs.betas(spark, sf_dir), target, **SMALL_BUCKETS)
    return spark.read.parquet(target).groupBy("rn_bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row_number").alias("first_number"),
        F.max("row_number").alias("last_number"))


@query("rn_slice", "SELECT * FROM betas WHERE row_number BETWEEN 15 AND 32", steps=("betas",))
def rn_slice(spark, sf_dir):
    """A slice of participant numbers is the feature: it reads the folders of the slice only."""
    target = f"{shared_dir(spark)}/bucketed"
    tables.write_bucketed(inputs.betas(spark, sf_dir), target, **SMALL_BUCKETS)
    return tables.read_slice(spark, target, 15, 32, **SMALL_BUCKETS)


@query("slice_union", "SELECT * FROM betas", steps=("betas",))
def slice_union(spark, sf_dir):
    """Slices that touch and do not overlap, and the rows without a number, add up to the table."""
    target = f"{shared_dir(spark)}/bucketed"
    tables.write_bucketed(inputs.betas(spark, sf_dir), target, **SMALL_BUCKETS)
    edges = [1, 21, 41, 1 << 40]
    return tables.append_slices([
        *[tables.read_slice(spark, target, a, b - 1, **SMALL_BUCKETS) for a, b in zip(edges, edges[1:])],
        tables.read_unnumbered(spark, target)])


@query("text_sink", """
    SELECT CpG_probe_id || ',' || count(*) AS value FROM betas GROUP BY CpG_probe_id""", steps=("betas",))
def text_sink(spark, sf_dir):
    target = f"{shared_dir(spark)}/counts"
    tables.write_text(site_counts(inputs.labelled(spark, sf_dir), count_nulls=True), target, files=2)
    return spark.read.text(target)


@query("step_read_transform_write", _METRICS, steps=("ad_first",))
def step_read_transform_write(spark, sf_dir):
    target = f"{shared_dir(spark)}/ad_metrics"
    return tables.run_step(
        lambda: view(spark, sf_dir, "fx_ad_log"), lambda log: _rounded_metrics(ad_metrics(log)),
        lambda out: tables.write_declared(out, target, METRICS_SCHEMA))


def _wide(spark, sf_dir):
    m = inputs.matrix(spark, sf_dir, binary=False)
    width = m.agg(F.max(F.size("features"))).first()[0]
    project = F.when(F.col("label") < 5, "TCGA-BRCA").otherwise("TCGA-LUAD").alias("project_short_name")
    return m.select(F.col("id").cast("string").alias("id"), *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(width)],
                    F.col("label").cast("string").alias("label"), project)


@query("csv_roundtrip", "SELECT id, CAST(label AS VARCHAR) AS label, idx, round(x, 6) AS x FROM (SELECT CAST(id AS VARCHAR) AS id, label, idx, x FROM fx_matrix)",
       views=("fx_matrix",))
def csv_roundtrip(spark, sf_dir):
    target = f"{shared_dir(spark)}/matrix_csv"
    matrix_csv.write_matrix_csv(_wide(spark, sf_dir).drop("project_short_name"), target)
    vectors, _ = matrix_csv.wide_to_vectors(matrix_csv.read_matrix_csv(spark, target, "id", ("label",)), "id", ("label",))
    return inputs.cells(vectors, "id", "label")


@query("csv_multi", """
    SELECT CAST(id AS VARCHAR) AS id, CAST(label AS VARCHAR) AS label, idx, round(x, 6) AS x FROM fx_matrix
    WHERE label < 5""", views=("fx_matrix",))
def csv_multi(spark, sf_dir):
    """Three part files, one of them with its columns in another order; one project is asked for."""
    folder = shared_dir(spark)
    wide = _wide(spark, sf_dir)
    part = F.pmod(F.col("id").cast("bigint"), F.lit(3))
    for i in range(3):
        rows = wide.filter(part == i)
        matrix_csv.write_matrix_csv(rows.select(*reversed(rows.columns)) if i == 1 else rows, f"{folder}/part-{i}")
    labels = ("label", "project_short_name")
    rows = matrix_csv.read_matrix_parts(spark, [f"{folder}/part-{i}" for i in range(3)], "id", labels,
                                        project="TCGA-BRCA")
    vectors, _ = matrix_csv.wide_to_vectors(rows, "id", labels)
    return inputs.cells(vectors, "id", "label")


# ---------------------------------------------------------------- validation

def _profile_sql(source: str, numbers: dict[str, str], texts: list[str]) -> str:
    parts = []
    for c, kind in numbers.items():
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS missing,
          round(avg({x}),4) AS mean, round(stddev_pop({x}),4) AS std, min({x}) AS min, max({x}) AS max,
          count(*) FILTER (WHERE {x} = 0) AS zeros, CAST(NULL AS DOUBLE) AS avg_length FROM {source}""")
    for c in texts:
        parts.append(f"""SELECT '{c}', 'STRING', count(*), count(*) - count({c}), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
          CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT), round(avg(length({c})),4) FROM {source}""")
    return " UNION ALL ".join(parts)


def _profile_rounded(df):
    return profile.profile(df).withColumns({c: F.round(c, 4) for c in ("mean", "std", "avg_length")})


@query("profile", _profile_sql("fx_ad_log", {c: "INT" for c in (
    "UniqueIdentifier", "AdDuration", "AdsSelected", "MaxAds", "MaxDuration")}, ["AllRequestKv", "EventName"]),
    views=("fx_ad_log",))
def profile_query(spark, sf_dir):
    return _profile_rounded(view(spark, sf_dir, "fx_ad_log"))


@query("profile_documents", _profile_sql("documents", {"doc_id": "INT", "n_chars": "INT"}, ["text", "lang", "source"]))
def profile_documents(spark, sf_dir):
    return _profile_rounded(table(spark, sf_dir, "documents"))


@query("profile_quantiles")
def profile_quantiles(spark, sf_dir):
    return profile.profile_quantiles(table(spark, sf_dir, "lineitem"))


_TOP = """
    , vals AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents),
    counted AS (SELECT "column", value, count(*) AS rows FROM vals WHERE value IS NOT NULL GROUP BY ALL)"""


@query("profile_top_values", "WITH one AS (SELECT 1)" + _TOP + """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rows DESC, value) AS rank FROM counted)
    WHERE rank <= 3""")
def profile_top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "documents"), ["lang", "source"], 3)


@query("profile_distinct", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM lineitem""" for c in
    ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")))
def profile_distinct(spark, sf_dir):
    return profile.distinct_counts(table(spark, sf_dir, "lineitem"), [
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity"])


_COMPARED = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": None, "o_totalprice": "o_totalprice",
             "o_orderdate": "epoch(o_orderdate)", "o_orderpriority": None}


def _side_sql(c: str, x: str | None, side: str, split: str) -> str:
    where = f"FILTER (WHERE split = '{split}')"
    numbers = [f"round({f}({x}) {where}, 2)" if x else "NULL::DOUBLE" for f in ("avg", "stddev_pop")]
    return (f"count(*) {where} - count({c}) {where} AS missing_{side}, {numbers[0]} AS mean_{side}, {numbers[1]} AS std_{side}")


@query("profile_compare", f"""
    WITH parts AS (SELECT *, CASE WHEN {h32("o_orderkey || ':split'")} % 3 < 2 THEN 'train' ELSE 'eval' END AS split FROM orders)
    """ + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {_side_sql(c, x, "left", "train")}, {_side_sql(c, x, "right", "eval")} FROM parts"""
                             for c, x in _COMPARED.items()))
def profile_compare(spark, sf_dir):
    split = split_buckets(table(spark, sf_dir, "orders"), "o_orderkey")
    left, right = (split.filter(F.col("split") == s).drop("split") for s in ("train", "eval"))
    return profile.compare_profiles(left, right).withColumns(
        {f"{c}_{side}": F.round(f"{c}_{side}", 2) for c in ("mean", "std") for side in ("left", "right")})


@query("schema_infer", """
    SELECT "column", type, required, domain FROM (
      SELECT 'c_custkey' AS "column", 'INT' AS type, true AS required, NULL AS domain
      UNION ALL SELECT 'c_name', 'STRING', true, NULL UNION ALL SELECT 'c_nationkey', 'INT', true, NULL
      UNION ALL SELECT 'c_acctbal', 'FLOAT', true, NULL
      UNION ALL SELECT 'c_mktsegment', 'STRING', bool_and(c_mktsegment IS NOT NULL),
        string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) FROM customer)""")
def schema_infer(spark, sf_dir):
    schema = profile.infer_schema(table(spark, sf_dir, "customer"))
    return schema.withColumn("domain", F.array_join("domain", "|"))


@query("anomalies", """
    SELECT 'c_name' AS "column", 'missing_column' AS anomaly, 0::BIGINT AS rows
    UNION ALL SELECT 'tier', 'new_column', 0 UNION ALL SELECT 'c_custkey', 'type_change', 0
    UNION ALL SELECT 'c_nationkey', 'missing_values', count(*) FILTER (WHERE c_nationkey = 0) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'unexpected_value', count(*) FILTER (WHERE c_acctbal < 0) FROM customer""")
def anomalies(spark, sf_dir):
    """A changed copy of a table against the schema of the original."""
    customer = table(spark, sf_dir, "customer")
    changed = customer.select(
        F.col("c_custkey").cast("string").alias("c_custkey"), F.nullif("c_nationkey", F.lit(0)).alias("c_nationkey"),
        "c_acctbal", F.when(F.col("c_acctbal") < 0, "DEBTOR").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.lit("gold").alias("tier"))
    return profile.anomalies(changed, profile.infer_schema(customer))


# ---------------------------------------------------------------- model quality

_COUNTS = """SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE label <> 1 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction <> 1) AS fn FROM preds"""


@query("f1", f"SELECT tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM ({_COUNTS})",
       steps=("preds",))
def f1(spark, sf_dir):
    return metrics.f1_binary(inputs.predictions(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


@query("f1_weighted", """
    , per AS (SELECT c, count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS said,
        count(*) FILTER (WHERE label = c AND prediction = c) AS tp
      FROM preds, (SELECT DISTINCT label AS c FROM preds) GROUP BY c)
    SELECT round(sum(support * 2 * tp / (support + said)) / sum(support), 6) AS f1_weighted FROM per""",
       steps=("preds",))
def f1_weighted(spark, sf_dir):
    return metrics.f1_weighted(inputs.predictions(spark, sf_dir)).withColumn("f1_weighted", F.round("f1_weighted", 6))


@query("confusion", """
    SELECT a.c AS label, b.c AS prediction, count(p.label) AS rows
    FROM (VALUES (0),(1)) a(c) CROSS JOIN (VALUES (0),(1)) b(c)
    LEFT JOIN preds p ON p.label = a.c AND p.prediction = b.c GROUP BY a.c, b.c""", steps=("preds",))
def confusion(spark, sf_dir):
    return metrics.confusion(inputs.predictions(spark, sf_dir), [0, 1])


@query("accuracy", "SELECT count(*) AS rows, round(avg((label = prediction)::INT), 6) AS accuracy FROM preds",
       steps=("preds",))
def accuracy(spark, sf_dir):
    return metrics.accuracy(inputs.predictions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query("slice_accuracy", """
    SELECT d.lang, d.source, count(*) AS rows, round(avg((label = prediction)::INT), 6) AS accuracy
    FROM preds p JOIN documents d ON d.doc_id = p.doc_id GROUP BY d.lang, d.source""", steps=("preds",))
def slice_accuracy(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = inputs.predictions(spark, sf_dir).join(documents, "doc_id")
    return metrics.accuracy(rows, by=["lang", "source"]).withColumn("accuracy", F.round("accuracy", 6))


@query("bless", """
    SELECT round(a, 6) AS accuracy, round(b, 6) AS baseline_accuracy, round(a - b, 6) AS change,
      a >= 0.6 AND a - b > -1e-10 AS blessed
    FROM (SELECT avg((label = prediction)::INT) AS a, avg((label = 0)::INT) AS b FROM preds)""", steps=("preds",))
def bless(spark, sf_dir):
    """The baseline always says 0."""
    rows = inputs.predictions(spark, sf_dir)
    verdict = metrics.bless(metrics.accuracy(rows), metrics.accuracy(rows.withColumn("prediction", F.lit(0))))
    return verdict.withColumns({c: F.round(c, 6) for c in ("accuracy", "baseline_accuracy", "change")})


@query("latest_blessed", """
    SELECT model, uri, CAST(CAST(created AS DATE) AS VARCHAR) AS created FROM (
      SELECT *, row_number() OVER (PARTITION BY model ORDER BY created DESC, uri DESC) AS rn FROM fx_model_log WHERE blessed)
    WHERE rn = 1""", views=("fx_model_log",))
def latest_blessed(spark, sf_dir):
    return registry.latest_blessed(view(spark, sf_dir, "fx_model_log")).withColumn(
        "created", F.to_date("created").cast("string"))


# ---------------------------------------------------------------- models

def _parts(spark, sf_dir):
    return take_split(split_exact(impute_mean(inputs.matrix(spark, sf_dir))))


def _checked(scored):
    """What must hold of any model's answers: one row per test row, a class that has the highest probability, and
    probabilities that add up."""
    highest = F.array_position("probability", F.array_max("probability")) - 1
    total = F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)
    said = F.get("probability", F.col("prediction"))
    return scored.select("id", "label", F.col("prediction").isin(0, 1).alias("known_class"),
                         ((highest == F.col("prediction")) | (said == F.array_max("probability"))).alias("most_likely"),
                         (F.abs(total - 1) < 1e-6).alias("adds_up"))


_TEST_ROWS = "SELECT id, label, true AS known_class, true AS most_likely, true AS adds_up FROM split_of WHERE is_test"


@query("gbt_train", _TEST_ROWS, steps=("split_of",))
def gbt_train(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    model = training.fit(training.boosted_trees(n_estimators=5, max_depth=3, gamma=0.0), train)
    return _checked(training.score(model, test))


@query("mlp_train", _TEST_ROWS, steps=("split_of",))
def mlp_train(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    model = training.fit(training.neural_net(64), train)
    return _checked(training.score(model, test))


@query("grid_search", _TEST_ROWS, steps=("split_of",))
def grid_search(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    grid = {"max_depth": [2, 3], "n_estimators": [3]}
    return _checked(training.score(training.grid_search(train, grid).bestModel, test))


@query("random_search", _TEST_ROWS, steps=("split_of",))
def random_search(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    space = {**training.SPACE, "n_estimators": (2, 5, "integer"), "max_depth": (2, 3, "integer")}
    return _checked(training.score(training.random_search(train, space=space).bestModel, test))


@query("score_saved_model", _TEST_ROWS, steps=("split_of",))
def score_saved_model(spark, sf_dir):
    """Train, save, load, score."""
    train, test = _parts(spark, sf_dir)
    path = f"{shared_dir(spark)}/model"
    registry.save_model(training.fit(training.boosted_trees(n_estimators=2, max_depth=2), train), path)
    return _checked(training.score(registry.load_model(path), test))
