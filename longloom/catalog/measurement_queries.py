"""Queries on measurements: labels, joins, ranking, aggregates, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import (
    STAGE_CLASSES, encode_label, sample_code, sample_status, stage_class, stage_classes, stage_of_sample)
from ..operators import pivot, ranking
from ..operators.joins import fan_out
from ..operators.measurements import annotated, number_participants
from ..plans.preparation import STATUS_CLASSES, matrix_from_measurements
from ..sources.fixtures import view
from . import inputs
from .registry import STEPS, query

TARGETS = ["pathologic_stage", "pathologic_T", "pathologic_N", "pathologic_M"]


def _six(name):
    """Six digits. Means of few six-digit values often lie just between two; both engines then round up."""
    return F.round(F.col(name) + F.lit(1e-10), 6).alias(name)


@query("site_rank", """
    SELECT CpG_probe_id, score AS sum_squares_between_groups FROM scores WHERE cpg_count / samples >= 0.9
    ORDER BY score DESC, CpG_probe_id LIMIT 5000""", steps=("scores",))
def site_rank(spark, sf_dir):
    return ranking.rank_sites(inputs.labelled(spark, sf_dir))


@query("build_betas", "SELECT * FROM betas", steps=("betas",))
def build_betas(spark, sf_dir):
    return inputs.betas(spark, sf_dir)


@query("betas_join", "SELECT * FROM dna", steps=("dna",))
def betas_join(spark, sf_dir):
    return annotated(*inputs.raw(spark, sf_dir))


@query("participants_numbered", "SELECT * FROM numbered", steps=("numbered",))
def participants_numbered(spark, sf_dir):
    return number_participants(view(spark, sf_dir, "fx_methylation"))


_METH_STATUS = STEPS["betas"][2].split("AS sample_id, ")[1].split(" AS sample_status")[0].replace("d.", "")


@query("sample_status", f"""
    SELECT aliquot_barcode, substr(aliquot_barcode,14,2) AS sample_id, {_METH_STATUS} AS sample_status, count(*) AS n
    FROM fx_methylation GROUP BY ALL""", views=("fx_methylation",))
def sample_status_query(spark, sf_dir):
    barcode = F.col("aliquot_barcode")
    return view(spark, sf_dir, "fx_methylation").groupBy(
        barcode, sample_code(barcode).alias("sample_id"), sample_status(barcode).alias("sample_status")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("label_encode", """
    SELECT aliquot_barcode, CASE sample_status WHEN 'tumor' THEN 1 WHEN 'normal' THEN 0 END AS label
    FROM (SELECT DISTINCT aliquot_barcode, sample_status FROM betas) WHERE sample_status IN ('tumor','normal')""",
       steps=("betas",))
def label_encode(spark, sf_dir):
    labels = pivot.distinct_labels(inputs.labelled(spark, sf_dir))
    return encode_label(labels, "sample_status", STATUS_CLASSES).select("aliquot_barcode", "label")


@query("labels_distinct", "SELECT DISTINCT aliquot_barcode, sample_status FROM betas", steps=("betas",))
def labels_distinct(spark, sf_dir):
    return pivot.distinct_labels(inputs.labelled(spark, sf_dir))


@query("site_counts", "SELECT CpG_probe_id, cpg_count FROM means", steps=("means",))
def site_counts(spark, sf_dir):
    return ranking.site_counts(inputs.labelled(spark, sf_dir))


@query("site_counts_all", "SELECT CpG_probe_id, all_count AS cpg_count FROM means", steps=("means",))
def site_counts_all(spark, sf_dir):
    return ranking.site_counts(inputs.labelled(spark, sf_dir), count_nulls=True)


@query("aliquot_count", "SELECT count(DISTINCT aliquot_barcode) AS sample_count FROM betas", steps=("betas",))
def aliquot_count(spark, sf_dir):
    return ranking.sample_count(inputs.labelled(spark, sf_dir))


@query("coverage_filter", "SELECT CpG_probe_id, cpg_count FROM means WHERE cpg_count / samples >= 0.9",
       steps=("means",))
def coverage_filter(spark, sf_dir):
    df = inputs.labelled(spark, sf_dir)
    return ranking.filter_coverage(ranking.site_counts(df), ranking.sample_count(df))


@query("coverage_filter_strict", "SELECT CpG_probe_id, all_count AS cpg_count FROM means WHERE all_count / samples > 0.9",
       steps=("means",))
def coverage_filter_strict(spark, sf_dir):
    df = inputs.labelled(spark, sf_dir)
    return ranking.filter_coverage(ranking.site_counts(df, count_nulls=True), ranking.sample_count(df),
                                   inclusive=False)


@query("site_means", """
    SELECT CpG_probe_id, round(a + 1e-10, 6) AS mean_all, round(t + 1e-10, 6) AS mean_tumor,
      round(n + 1e-10, 6) AS mean_normal FROM means""",
       steps=("means",))
def site_means(spark, sf_dir):
    means = ranking.group_means(inputs.labelled(spark, sf_dir), ["tumor", "normal"])
    return means.select("CpG_probe_id", *[_six(c) for c in ("mean_all", "mean_tumor", "mean_normal")])


@query("pivot_class_avg", """
    SELECT CpG_probe_id, round(t + 1e-10, 6) AS tumor, round(n + 1e-10, 6) AS normal FROM means""", steps=("means",))
def pivot_class_avg(spark, sf_dir):
    means = pivot.pivot_class_means(inputs.labelled(spark, sf_dir), ["tumor", "normal"])
    return means.select("CpG_probe_id", *[_six(c) for c in ("tumor", "normal")])


@query("site_rank_pivot", """
    SELECT CpG_probe_id, score AS sum_squared_between_groups FROM scores WHERE all_count / samples > 0.9
    ORDER BY score DESC, CpG_probe_id LIMIT 5000""", steps=("scores",))
def site_rank_pivot(spark, sf_dir):
    return ranking.rank_sites_grouped(inputs.labelled(spark, sf_dir), ["tumor", "normal"])


@query("stage_join", """
    SELECT b.case_barcode, b.aliquot_barcode, b.CpG_probe_id, b.beta_value, s.pathologic_stage, s.pathologic_T,
      s.pathologic_N, s.pathologic_M
    FROM betas b JOIN (SELECT DISTINCT * FROM fx_patient_stage) s ON b.case_barcode = s.case_barcode
    WHERE b.sample_status = 'tumor' AND s.project_short_name = 'TCGA-BRCA'""",
       views=("fx_patient_stage",), steps=("betas",))
def stage_join(spark, sf_dir):
    df, stages = inputs.labelled(spark, sf_dir), view(spark, sf_dir, "fx_patient_stage")
    joined = ranking.join_stages(df, stages, *TARGETS)
    return fan_out(joined).select("case_barcode", "aliquot_barcode", "CpG_probe_id", "beta_value", *TARGETS)


def _class_sql(target: str, value: str) -> str:
    whens = " ".join(f"WHEN {value} = '{v}' THEN '{c}'" for c, vs in STAGE_CLASSES[target].items() if c for v in vs)
    return f"CASE {whens} END"


@query("stage_map", "SELECT DISTINCT " + ", ".join(f"{t}, {_class_sql(t, t)} AS {t}_class" for t in TARGETS)
       + " FROM fx_patient_stage", views=("fx_patient_stage",))
def stage_map(spark, sf_dir):
    stages = view(spark, sf_dir, "fx_patient_stage")
    return stages.select(*TARGETS, *[stage_class(F.col(t), t).alias(f"{t}_class") for t in TARGETS]).distinct()


@query("stage_override", "SELECT sample_id, pathologic_M, CASE WHEN TRY_CAST(sample_id AS INT) <= 9 THEN "
       + _class_sql("pathologic_M", "pathologic_M") + """ ELSE 'stage_0' END AS stage, count(*) AS n
    FROM betas b JOIN (SELECT DISTINCT * FROM fx_patient_stage) s ON b.case_barcode = s.case_barcode GROUP BY ALL""",
       views=("fx_patient_stage",), steps=("betas",))
def stage_override(spark, sf_dir):
    patients = view(spark, sf_dir, "fx_patient_stage").distinct().groupBy("case_barcode", "pathologic_M").agg(
        F.count(F.lit(1)).alias("copies"))
    df = inputs.labelled(spark, sf_dir).join(patients, "case_barcode")
    stage = stage_class(stage_of_sample(F.col("sample_id"), F.col("pathologic_M")), "pathologic_M")
    return df.groupBy("sample_id", "pathologic_M", stage.alias("stage")).agg(F.sum("copies").alias("n"))


def _register_stage_rank(target: str) -> None:
    classes = stage_classes(target)
    means = ", ".join(f"avg(beta_value) FILTER (WHERE cls = '{c}') AS m_{c}" for c in classes)
    total = " + ".join(f"power(coalesce(m_{c}, a) - a, 2)" for c in classes)

    @query(f"site_rank_{target.removeprefix('pathologic_').lower()}", f"""
        , staged AS (
          SELECT b.case_barcode, b.CpG_probe_id, b.beta_value, {_class_sql(target, 's.' + target)} AS cls
          FROM betas b JOIN (SELECT DISTINCT * FROM fx_patient_stage) s ON b.case_barcode = s.case_barcode
          WHERE b.sample_status = 'tumor' AND s.project_short_name = 'TCGA-BRCA'),
        per_site AS (
          SELECT CpG_probe_id, count(*) AS c, avg(beta_value) AS a, {means},
            (SELECT count(*) FROM (SELECT DISTINCT case_barcode FROM staged)) AS samples
          FROM staged GROUP BY CpG_probe_id)
        SELECT CpG_probe_id, round({total}, 9) AS sum_squared_between_groups FROM per_site WHERE c / samples > 0.9
        ORDER BY 2 DESC, 1 LIMIT 5000""", views=("fx_patient_stage",), steps=("betas",))
    def run(spark, sf_dir):
        return ranking.rank_sites_multiclass(inputs.labelled(spark, sf_dir), view(spark, sf_dir, "fx_patient_stage"),
                                             target)


for _target in TARGETS:
    _register_stage_rank(_target)


@query("site_semi_join", """
    SELECT CpG_probe_id, aliquot_barcode, beta_value FROM betas
    WHERE CpG_probe_id IN (SELECT CpG_probe_id FROM top_sites)""", steps=("top_sites",))
def site_semi_join(spark, sf_dir):
    df = inputs.labelled(spark, sf_dir)
    return pivot.keep_sites(df, inputs.top_sites(df)).select("CpG_probe_id", "aliquot_barcode", "beta_value")


@query("pivot_vector", """
    SELECT r.aliquot_barcode, r.sample_status, i.idx, round(b.beta_value, 6) AS x
    FROM (SELECT DISTINCT aliquot_barcode, sample_status FROM betas
          WHERE CpG_probe_id IN (SELECT CpG_probe_id FROM top_sites)) r
    CROSS JOIN site_idx i
    LEFT JOIN cells b ON b.aliquot_barcode = r.aliquot_barcode AND b.CpG_probe_id = i.CpG_probe_id""",
       steps=("site_idx", "cells"))
def pivot_vector(spark, sf_dir):
    df = inputs.labelled(spark, sf_dir)
    vectors = pivot.pivot_vector(df, pivot.site_index(inputs.top_sites(df)), on_duplicate="avg")
    return inputs.cells(vectors, "aliquot_barcode", "sample_status")


@query("pivot_vector_avg", """
    , idx_all AS (SELECT CpG_probe_id, row_number() OVER (ORDER BY CpG_probe_id) - 1 AS idx
                  FROM (SELECT DISTINCT CpG_probe_id FROM betas))
    SELECT r.aliquot_barcode, r.sample_status, i.idx, round(b.x, 6) AS x
    FROM (SELECT DISTINCT aliquot_barcode, sample_status FROM betas) r CROSS JOIN idx_all i
    LEFT JOIN (SELECT aliquot_barcode, CpG_probe_id, avg(beta_value) AS x FROM betas GROUP BY ALL) b
      ON b.aliquot_barcode = r.aliquot_barcode AND b.CpG_probe_id = i.CpG_probe_id""", steps=("betas",))
def pivot_vector_avg(spark, sf_dir):
    df = inputs.labelled(spark, sf_dir)
    index = pivot.site_index(df.select("CpG_probe_id").distinct())
    return inputs.cells(pivot.pivot_vector(df, index, on_duplicate="avg"), "aliquot_barcode", "sample_status")


_WIDE = """
    SELECT r.aliquot_barcode, s.CpG_probe_id, round(b.beta_value, 6) AS beta_value
    FROM (SELECT DISTINCT aliquot_barcode FROM betas WHERE CpG_probe_id IN (SELECT CpG_probe_id FROM top_sites)) r
    CROSS JOIN top_sites s
    LEFT JOIN cells b ON b.aliquot_barcode = r.aliquot_barcode AND b.CpG_probe_id = s.CpG_probe_id"""


@query("pivot_wide", _WIDE, steps=("top_sites", "cells"))
def pivot_wide(spark, sf_dir):
    """Unpivoted again, since the column names depend on the data."""
    df = inputs.labelled(spark, sf_dir)
    wide = pivot.pivot_wide(df, inputs.top_sites(df), on_duplicate="avg")
    return wide.unpivot("aliquot_barcode", [c for c in wide.columns if c != "aliquot_barcode"], "CpG_probe_id",
                        "beta_value").withColumn("beta_value", F.round("beta_value", 6))


# the annotated sites by name
_SITES = [f"cg{i:08d}" for i in range(200) if i % 40 != 39 and i % 50 != 49]
_SUM_SITES = _SITES[:100]


def _rounded_sums(df, **options):
    wide = pivot.pivot_sum(df, ["aliquot_barcode"], "CpG_probe_id", "beta_value", **options)
    return wide.select("aliquot_barcode", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


@query("pivot_sum", "SELECT aliquot_barcode, " + ", ".join(
    f"round(sum(beta_value) FILTER (WHERE CpG_probe_id = '{c}'), 6) AS {c}" for c in _SUM_SITES)
    + " FROM betas GROUP BY aliquot_barcode", steps=("betas",))
def pivot_sum(spark, sf_dir):
    """The number of columns is a parameter here."""
    return _rounded_sums(inputs.labelled(spark, sf_dir), max_columns=100)


@query("pivot_limit", "SELECT aliquot_barcode, " + ", ".join(
    f"round(sum(beta_value) FILTER (WHERE CpG_probe_id = '{c}'), 6) AS {c}" for c in _SITES)
    + " FROM betas GROUP BY aliquot_barcode ORDER BY aliquot_barcode LIMIT 20", steps=("betas",))
def pivot_limit(spark, sf_dir):
    """The first rows in order are the feature."""
    return _rounded_sums(inputs.labelled(spark, sf_dir), limit=20)


@query("labelled_pivot", "SELECT p.*, l.sample_status FROM (SELECT aliquot_barcode, " + ", ".join(
    f"round(sum(beta_value) FILTER (WHERE CpG_probe_id = '{c}'), 6) AS {c}" for c in _SITES)
    + """ FROM betas GROUP BY aliquot_barcode) p
    LEFT JOIN (SELECT DISTINCT aliquot_barcode, sample_status FROM betas) l USING (aliquot_barcode)""",
    steps=("betas",))
def labelled_pivot(spark, sf_dir):
    df = inputs.labelled(spark, sf_dir)
    return pivot.labelled_pivot(_rounded_sums(df), df)


@query("matrix_end_to_end", """
    SELECT r.id, r.label, i.idx, round(b.beta_value, 6) AS x
    FROM (SELECT DISTINCT aliquot_barcode AS id, CASE sample_status WHEN 'tumor' THEN 1 ELSE 0 END AS label FROM betas
          WHERE sample_status IN ('tumor','normal') AND CpG_probe_id IN (SELECT CpG_probe_id FROM top_sites)) r
    CROSS JOIN site_idx i
    LEFT JOIN cells b ON b.aliquot_barcode = r.id AND b.CpG_probe_id = i.CpG_probe_id""", steps=("site_idx", "cells"))
def matrix_end_to_end(spark, sf_dir):
    m, _ = matrix_from_measurements(*inputs.raw(spark, sf_dir), on_duplicate="avg")
    return inputs.cells(m, "id", "label")
