"""Queries on stored layouts and states: keyed tables, slices, bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, slices
from ..operators.joins import fan_out, multiplicity
from ..operators.measurements import number_participants, probe_lookup
from ..session import materialize, shared_dir
from ..sources.fixtures import view
from ..sources.keyed import store_by_key
from . import inputs
from .measurement_queries import TARGETS
from .registry import ORACLES, query


@query("betas_join_keyed", "SELECT * FROM dna", steps=("dna",))
def betas_join_keyed(spark, sf_dir):
    """The three-way join with the measurements stored by probe, where neither annotation need fit a task."""
    meth, annotation, gdc = inputs.raw(spark, sf_dir)
    hits = store_by_key(meth, "probe_id").join(probe_lookup(annotation, gdc))
    return fan_out(hits.withColumnRenamed("probe_id", "CpG_probe_id"))


@query("build_betas_keyed", "SELECT * FROM betas", steps=("betas",))
def build_betas_keyed(spark, sf_dir):
    """Participant numbers joined to measurements stored by participant."""
    meth = view(spark, sf_dir, "fx_methylation")
    return store_by_key(inputs.labelled(spark, sf_dir), "case_barcode").join(number_participants(meth), "left")


@query("stage_join_keyed")
def stage_join_keyed(spark, sf_dir):
    """Stages of patients joined to their tumor measurements, stored by patient."""
    stages = view(spark, sf_dir, "fx_patient_stage").filter("project_short_name = 'TCGA-BRCA'").dropDuplicates()
    tumor = inputs.labelled(spark, sf_dir).filter("sample_status = 'tumor'")
    joined = store_by_key(tumor, "case_barcode").join(multiplicity(stages, "case_barcode", *TARGETS))
    return fan_out(joined).select("case_barcode", "aliquot_barcode", "CpG_probe_id", "beta_value", *TARGETS)


ORACLES["stage_join_keyed"] = ORACLES["stage_join"]


@query("aliquot_count_bitmap", "SELECT count(DISTINCT aliquot_barcode) AS sample_count FROM betas", steps=("betas",))
def aliquot_count_bitmap(spark, sf_dir):
    """Samples counted by bitmaps over their numbers: what is shuffled are bitmaps."""
    betas = materialize(inputs.labelled(spark, sf_dir).select("aliquot_barcode"))
    numbers = materialize(slices.number_values(betas, "aliquot_barcode"))
    return slices.count_bitmaps(slices.bitmaps(betas.join(numbers, "aliquot_barcode"), "number"), out="sample_count")


@query("participants_by_status_bitmap", """
    SELECT sample_status, count(DISTINCT case_barcode) AS participants FROM betas WHERE row_number IS NOT NULL GROUP BY sample_status""",
       steps=("betas",))
def participants_by_status_bitmap(spark, sf_dir):
    """Participants of each status; their row numbers are the bits."""
    maps = slices.bitmaps(inputs.betas(spark, sf_dir), "row_number", ["sample_status"])
    return slices.count_bitmaps(maps, ["sample_status"], out="participants")


@query("site_rank_slices", """
    SELECT CpG_probe_id, score AS sum_squares_between_groups FROM scores WHERE cpg_count / samples >= 0.9
    ORDER BY score DESC, CpG_probe_id LIMIT 5000""", steps=("scores",))
def site_rank_slices(spark, sf_dir):
    """The ranking from the stored states of three slices of participants and of the rows without one."""
    betas = materialize(inputs.betas(spark, sf_dir))
    store = slices.RankingStore(spark, f"{shared_dir(spark)}/ranking")
    numbers = None
    for name, rows in [*[(f"p{i}", F.pmod("row_number", F.lit(3)) == i) for i in range(3)], ("none", F.col("row_number").isNull())]:
        part = betas.filter(rows)
        numbers = materialize(slices.number_values(part, "aliquot_barcode", numbers))
        store.add(name, part, numbers)
    return store.rank()


@query("coverage_slices", "SELECT CpG_probe_id, cpg_count FROM means WHERE cpg_count / samples >= 0.9", steps=("means",))
def coverage_slices(spark, sf_dir):
    """The coverage filter from the states of two slices that share samples."""
    betas = materialize(inputs.labelled(spark, sf_dir))
    numbers = materialize(slices.number_values(betas, "aliquot_barcode"))
    store = slices.RankingStore(spark, f"{shared_dir(spark)}/coverage")
    half = F.pmod(F.xxhash64("CpG_probe_id"), F.lit(2))
    for i in range(2):
        store.add(str(i), betas.filter(half == i), numbers)
    counts = slices.state_means(store.state()).select("CpG_probe_id", "cpg_count")
    return ranking.filter_coverage(counts, store.sample_count())
