"""Queries on safe replacement, resumed pipelines, stored routines, and publication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.labels import sample_code, sample_status
from ..operators import metrics
from ..operators.impute import impute_mean
from ..operators.joins import fan_out
from ..operators.measurements import probe_lookup
from ..operators.ranking import rank_sites
from ..plans import registry, training
from ..plans.ledger import Ledger, run_pipeline
from ..session import materialize, shared_dir
from ..sources import tables
from ..sources.fixtures import table
from ..sources.routines import create_labelled_pivot, create_ranking
from ..sources.versions import VersionedTable
from . import inputs
from .other_queries import BETAS_SCHEMA
from .registry import query


@query("replace_from_itself", "SELECT *, 2 AS version FROM betas WHERE sample_status <> 'control'", steps=("betas",))
def replace_from_itself(spark, sf_dir):
    """A table with a declared schema replaced by a part of its own rows, after a replacement that failed."""
    target = VersionedTable(spark, f"{shared_dir(spark)}/betas")
    target.replace(inputs.betas(spark, sf_dir), BETAS_SCHEMA)
    broken = F.when(F.col("sample_status") == "tumor", F.raise_error(F.lit("broken"))).otherwise(F.col("case_barcode"))
    try:
        target.replace(target.read().withColumn("case_barcode", broken), BETAS_SCHEMA)
    except Exception as error:
        if "broken" not in str(error):
            raise
    rows = target.replace(target.read().filter("sample_status != 'control'"), BETAS_SCHEMA)
    return rows.withColumn("version", F.lit(target.version()))


@query("pipeline_resume", """
    , kinds AS (SELECT sample_status, count(*) AS rows FROM betas GROUP BY ALL)
    SELECT sample_status, rows, 'betas,kinds,sites' AS first_run, '' AS second_run, 'sites' AS third_run FROM kinds""", steps=("betas",))
def pipeline_resume(spark, sf_dir):
    """Three steps, run again as they were, and again with one of them changed; each run says what it computed."""
    base, started, results = shared_dir(spark), [], {}
    for name, df in zip(inputs.MEASUREMENT_VIEWS, inputs.raw(spark, sf_dir)):
        df.write.parquet(f"{base}/raw/{name}.parquet")
    for k in (5000, 5000, 10):
        ledger = Ledger(spark, f"{base}/ledger")
        results = run_pipeline(ledger, [
            ("betas", lambda: betas_step(*[table(spark, f"{base}/raw", n) for n in inputs.MEASUREMENT_VIEWS]), []),
            ("kinds", lambda betas: betas.groupBy("sample_status").agg(F.count(F.lit(1)).alias("rows")), ["betas"]),
            ("sites", lambda betas, k=k: rank_sites(betas, k), ["betas"])])
        started.append(",".join(ledger.started))
    return results["kinds"].withColumns(dict(zip(("first_run", "second_run", "third_run"), map(F.lit, started))))


def betas_step(meth, annotation, gdc):
    """Labelled measurements by plain joins; what stores tables on the way has new files, and a new fingerprint, each time."""
    hits = meth.join(probe_lookup(annotation, gdc), "probe_id").withColumnRenamed("probe_id", "CpG_probe_id")
    barcode = F.col("aliquot_barcode")
    return fan_out(hits).select("case_barcode", "beta_value", "CpG_probe_id", "aliquot_barcode",
                                sample_code(barcode).alias("sample_id"), sample_status(barcode).alias("sample_status"))


def _labelled_view(spark, sf_dir) -> str:
    name = f"longloom_betas_{uuid.uuid4().hex}"
    materialize(inputs.labelled(spark, sf_dir)).createOrReplaceTempView(name)
    return name


@query("routine_rank", """
    SELECT CpG_probe_id, score FROM scores WHERE cpg_count / samples >= 0.9
    ORDER BY score DESC, CpG_probe_id LIMIT 5000""", steps=("scores",))
def routine_rank(spark, sf_dir):
    """The ranking as a stored routine, called through a template."""
    name = create_ranking(spark, f"longloom_rank_{uuid.uuid4().hex}", _labelled_view(spark, sf_dir))
    return tables.query_template(spark, "SELECT * FROM IDENTIFIER(:routine)(:k, :least)", {"routine": name}, {"k": 5000, "least": 0.9})


@query("routine_pivot", """
    , listed AS (SELECT DISTINCT CpG_probe_id FROM betas ORDER BY 1 LIMIT 100),
    sums AS (
      SELECT aliquot_barcode, CpG_probe_id, round(sum(beta_value), 6) AS x FROM betas JOIN listed USING (CpG_probe_id) GROUP BY ALL)
    SELECT aliquot_barcode, sample_status, CpG_probe_id, x FROM sums JOIN (SELECT DISTINCT aliquot_barcode, sample_status FROM betas) USING (aliquot_barcode)""",
       steps=("betas",))
def routine_pivot(spark, sf_dir):
    """The labelled pivot of 100 columns as a stored routine, its cells as rows."""
    name = create_labelled_pivot(spark, f"longloom_pivot_{uuid.uuid4().hex}", _labelled_view(spark, sf_dir))
    rows = tables.query_template(spark, "SELECT * FROM IDENTIFIER(:routine)(:columns, :how)", {"routine": name}, {"columns": 100, "how": "SUM"})
    return rows.select("aliquot_barcode", "sample_status", F.explode("cells").alias("CpG_probe_id", "x")).withColumn("x", F.round("x", 6))


@query("run_query_step", "SELECT CpG_probe_id, count(beta_value) AS cpg_count FROM betas GROUP BY CpG_probe_id", steps=("betas",))
def run_query_step(spark, sf_dir):
    """A database made, a query run into its table, and the table read from where the step says it is."""
    source = _labelled_view(spark, sf_dir)
    where = tables.run_query_step(spark, f"longloom_{uuid.uuid4().hex}", "counts",
                                  "SELECT CpG_probe_id, count(beta_value) AS cpg_count FROM IDENTIFIER(:source) GROUP BY CpG_probe_id", {"source": source})
    return spark.table(where["output_table"])


@query("publish_blessed", """
    , said AS (SELECT avg((label = prediction)::INT) AS a, avg((label = 1)::INT) AS b FROM preds),
    runs AS (
      SELECT 'first' AS run, a AS accuracy, a >= 0.6 AS blessed FROM said
      UNION ALL SELECT 'second', b, b >= 0.6 AND b - a > -1e-10 FROM said)
    SELECT run, round(accuracy, 6) AS accuracy, blessed, blessed AS published FROM runs""", steps=("preds",))
def publish_blessed(spark, sf_dir):
    """Two models before the gate, the second against the first; what the record says of them, and whether they can be loaded."""
    rows, base = inputs.predictions(spark, sf_dir), shared_dir(spark)
    first = metrics.accuracy(rows)
    verdicts = {"first": metrics.bless(first), "second": metrics.bless(metrics.accuracy(rows.withColumn("prediction", F.lit(1))), first)}
    train = impute_mean(inputs.matrix(spark, sf_dir))
    model = training.fit(training.boosted_trees(n_estimators=1, max_depth=1), train)
    for name, verdict in verdicts.items():
        registry.publish_if_blessed(model, verdict, f"{base}/runs", name, f"{base}/served/{name}")

    def served(name):
        try:
            return training.score(registry.load_model(f"{base}/served/{name}"), train).count() > 0
        except Exception as error:  # a model that was not published has no files
            if "does not exist" not in str(error):
                raise
            return False

    published = F.create_map(*[F.lit(x) for name in verdicts for x in (name, served(name))])
    return spark.read.parquet(f"{base}/runs").select(
        F.col("model").alias("run"), F.round("accuracy", 6).alias("accuracy"), "blessed", published[F.col("model")].alias("published"))
