"""The inputs the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.measurements import build_betas, label_measurements
from ..operators.pivot import cells_to_vectors, vectors_to_cells
from ..operators.ranking import rank_sites
from ..session import materialize
from ..sources.fixtures import table, view

TOP = 5000
MEASUREMENT_VIEWS = ("fx_methylation", "fx_annotation", "fx_gdc_annotation")


def raw(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [view(spark, sf_dir, name) for name in MEASUREMENT_VIEWS]


def betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled measurements with participant numbers."""
    return build_betas(*raw(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled measurements, for the queries that need no participant numbers."""
    return label_measurements(*raw(spark, sf_dir))


def top_sites(df: DataFrame) -> DataFrame:
    """The best sites, stored: the list is read several times, the ranking behind it should run once."""
    return materialize(rank_sites(df, TOP).select("CpG_probe_id"))


def matrix(spark: SparkSession, sf_dir: str, binary: bool = True) -> DataFrame:
    """The embedding matrix as ``(id, label, features)`` with gaps; ``binary`` makes label 3 the small class 0."""
    label = F.max("label").alias("label")
    cells = view(spark, sf_dir, "fx_matrix")
    size = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).scalar()
    m = cells_to_vectors(cells, "id", size, carry=[label])
    return m.withColumn("label", F.when(F.col("label") == 3, 0).otherwise(1)) if binary else m


def cells(m: DataFrame, *keys: str) -> DataFrame:
    """Vector results as rows, numbers rounded to six digits."""
    return vectors_to_cells(m, *keys).select(*keys, F.col("idx").cast("bigint"), F.round("x", 6).alias("x"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction"), "doc_id")
