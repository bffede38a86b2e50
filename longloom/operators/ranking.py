"""Feature ranking by between-group variance."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import stage_class, stage_classes, stage_of_sample
from ..functions.numeric import clean_value
from .joins import broadcast_if_small, multiplicity

SCORE_DIGITS = 9


def site_counts(betas: DataFrame, site: str = "CpG_probe_id", value: str = "beta_value",
                count_nulls: bool = False) -> DataFrame:
    """Measurements per site, with or without the missing ones."""
    counted = F.lit(1) if count_nulls else F.col(value)
    return betas.groupBy(site).agg(F.count(counted).alias("cpg_count"))


def sample_count(betas: DataFrame, sample: str = "aliquot_barcode", null_is_sample: bool = False) -> DataFrame:
    """One row: the exact number of distinct samples."""
    if null_is_sample:
        return betas.select(sample).distinct().agg(F.count(F.lit(1)).alias("sample_count"))
    return betas.agg(F.count_distinct(sample).alias("sample_count"))


def filter_coverage(counts: DataFrame, samples: DataFrame, min_coverage: float = 0.9, inclusive: bool = True,
                    count: str = "cpg_count") -> DataFrame:
    """Sites measured in a large enough share of the samples."""
    coverage = F.try_divide(F.col(count).cast("double"), F.col("_samples").cast("double"))
    bound = F.lit(float(min_coverage))
    kept = coverage >= bound if inclusive else coverage > bound
    return counts.withColumn("_samples", samples.scalar()).filter(kept).drop("_samples")


def _weighted_mean(value: Column, weight: Column | None, condition: Column | None = None) -> Column:
    if condition is not None:
        value = F.when(condition, value)
    if weight is None:
        return F.avg(value)
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def group_means(df: DataFrame, classes: list[str], site: str = "CpG_probe_id", value: str = "beta_value",
                label: str = "sample_status", weight: str | None = None, count_nulls: bool = False) -> DataFrame:
    """Per site: measurements, overall mean and the mean of every class, in one pass.

    Rows of other classes count towards the total and the overall mean. With ``weight`` a row stands for that many
    equal rows. NaN is a missing value.
    """
    df = clean_value(df, value)
    v, w = F.col(value), F.col(weight) if weight else None
    if w is None:
        total = F.count(F.lit(1) if count_nulls else v)
    else:
        total = F.coalesce(F.sum(w if count_nulls else F.when(v.isNotNull(), w)), F.lit(0))
    return df.groupBy(site).agg(
        total.alias("cpg_count"),
        _weighted_mean(v, w).alias("mean_all"),
        *[_weighted_mean(v, w, F.col(label) == c).alias(f"mean_{c}") for c in classes],
    )


def between_group_score(classes: list[str]) -> Column:
    """Sum over classes of the squared distance of the class mean from the overall mean; an absent class adds 0."""
    overall = F.col("mean_all")
    return reduce(add, [F.pow(F.coalesce(F.col(f"mean_{c}"), overall) - overall, F.lit(2.0)) for c in classes])


def top_sites(means: DataFrame, samples: DataFrame, classes: list[str], k: int, min_coverage: float,
              inclusive: bool, site: str, score: str) -> DataFrame:
    """The k best covered sites.

    Scores are rounded before ranking and ties go to the lower name, so the order in which partial sums arrive cannot
    change the result.
    """
    covered = filter_coverage(means, samples, min_coverage, inclusive)
    scored = covered.select(site, F.round(between_group_score(classes), SCORE_DIGITS).alias(score))
    return scored.orderBy(F.col(score).desc_nulls_last(), F.col(site)).limit(k)


def rank_sites(betas: DataFrame, k: int = 5000, min_coverage: float = 0.9, participants: DataFrame | None = None,
               site: str = "CpG_probe_id", score: str = "sum_squares_between_groups") -> DataFrame:
    """Sites that best separate tumor from normal samples.

    A site must have a value in at least ``min_coverage`` of the samples, counted over ``participants`` if given. The
    measurement table is aggregated once by site; counts and all means share that pass and its one shuffle.
    """
    classes = ["tumor", "normal"]
    samples = sample_count(betas if participants is None else participants)
    return top_sites(group_means(betas, classes, site=site), samples, classes, k, min_coverage, True, site, score)


def rank_sites_grouped(betas: DataFrame, classes: list[str], label: str = "sample_status", k: int = 5000,
                       min_coverage: float = 0.9, inclusive: bool = False, count_nulls: bool = True,
                       sample: str = "aliquot_barcode", site: str = "CpG_probe_id", weight: str | None = None,
                       score: str = "sum_squared_between_groups") -> DataFrame:
    """As ``rank_sites`` for any class list; by default counts rows, missing or not, and wants strictly more."""
    betas = betas.withColumn("beta_value", F.col("beta_value").cast("double"))
    samples = sample_count(betas, sample, null_is_sample=True)
    means = group_means(betas, classes, site=site, label=label, weight=weight, count_nulls=count_nulls)
    return top_sites(means, samples, classes, k, min_coverage, inclusive, site, score)


def join_stages(betas: DataFrame, stages: DataFrame, *targets: str, project: str = "TCGA-BRCA") -> DataFrame:
    """Tumor measurements of one project's patients with the annotated stage.

    Exact duplicates among the stage rows are dropped first. What is left is counted per patient and stage, in
    ``copies``, so a patient with many rows does not multiply their measurements.
    """
    patients = (
        stages.filter(F.col("project_short_name") == project).dropDuplicates()
        .transform(multiplicity, "case_barcode", *targets)
    )
    tumor = betas.filter(F.col("sample_status") == "tumor")
    return tumor.join(broadcast_if_small(patients), "case_barcode")


def rank_sites_multiclass(betas: DataFrame, stages: DataFrame, target: str = "pathologic_M",
                          project: str = "TCGA-BRCA", k: int = 5000, min_coverage: float = 0.9,
                          sample: str = "case_barcode") -> DataFrame:
    """Sites that best separate the stages of one project's tumor samples."""
    staged = join_stages(betas, stages, target, project=project)
    stage = stage_class(stage_of_sample(F.col("sample_id"), F.col(target)), target)
    return rank_sites_grouped(staged.withColumn("stage", stage), stage_classes(target), label="stage", k=k,
                              min_coverage=min_coverage, sample=sample, weight="copies")
