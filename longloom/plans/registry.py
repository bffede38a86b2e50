"""Trained models on record."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def record_run(spark: SparkSession, registry: str, model: str, uri: str, verdict: DataFrame) -> None:
    """Append one run with its ``bless`` verdict."""
    row = verdict.select(
        F.lit(model).alias("model"), F.lit(uri).alias("uri"), "accuracy", "blessed",
        F.current_timestamp().alias("created"))
    row.write.mode("append").parquet(registry)


def latest_blessed(registry: DataFrame) -> DataFrame:
    """The newest blessed run of every model; the higher uri of two of the same moment."""
    newest = F.max_by(F.struct("uri", "created"), F.struct("created", "uri"))
    return registry.filter("blessed").groupBy("model").agg(newest.alias("_run")).select("model", "_run.uri", "_run.created")


def publish_if_blessed(model: PipelineModel, verdict: DataFrame, registry: str, name: str, path: str) -> bool:
    """Save the model to its serving path if its verdict allows; record the run either way."""
    blessed = bool(verdict.first()["blessed"])
    if blessed:
        save_model(model, path)
    record_run(verdict.sparkSession, registry, name, path, verdict)
    return blessed
