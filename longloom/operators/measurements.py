"""The labelled measurement table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import sample_code, sample_status
from ..functions.numeric import clean_value
from ..session import materialize_measured
from .joins import BROADCAST_ROWS, broadcast_if_small, fan_out, multiplicity
from .numbering import ordered_index


def annotated(meth: DataFrame, annotation: DataFrame, gdc: DataFrame) -> DataFrame:
    """Measurements whose probe is in both annotation tables, with the annotated probe name.

    Repeated annotation rows repeat measurements, as an inner join of the three tables would. Both tables are first
    reduced to one row per probe with its number of copies, so the lookup that meets the measurements is small and
    unique, and a probe named by many annotation rows costs no shuffle of its measurements.
    """
    lookup, seen = materialize_measured(probe_lookup(annotation, gdc), most=F.max("copies"))
    lookup = F.broadcast(lookup) if seen["rows"] <= BROADCAST_ROWS else lookup
    hits = meth.join(lookup, "probe_id").withColumnRenamed("probe_id", "CpG_probe_id")
    return fan_out(hits) if (seen["most"] or 1) > 1 else hits.drop("copies")


def probe_lookup(annotation: DataFrame, gdc: DataFrame) -> DataFrame:
    """Probes in both annotation tables with the number of row pairs that name them."""
    return (
        multiplicity(annotation.select(F.col("Name").alias("probe_id")), "probe_id", out="n1")
        .join(multiplicity(gdc.select(F.col("CpG_probe_id").alias("probe_id")), "probe_id", out="n2"), "probe_id")
        .select("probe_id", (F.col("n1") * F.col("n2")).alias("copies"))
    )


def number_participants(meth: DataFrame, out: str = "row_number") -> DataFrame:
    """Every distinct participant with a dense number in name order."""
    return ordered_index(meth.select("case_barcode").distinct(), "case_barcode", out=out)


def _status_columns() -> list[Column]:
    barcode = F.col("aliquot_barcode")
    return [sample_code(barcode).alias("sample_id"), sample_status(barcode).alias("sample_status")]


def label_measurements(meth: DataFrame, annotation: DataFrame, gdc: DataFrame) -> DataFrame:
    """Annotated measurements with sample code and status, without participant numbers. NaN becomes NULL."""
    return annotated(clean_value(meth, "beta_value"), annotation, gdc).select(
        "case_barcode", "beta_value", "CpG_probe_id", "aliquot_barcode", *_status_columns())


def build_betas(meth: DataFrame, annotation: DataFrame, gdc: DataFrame) -> DataFrame:
    """The labelled measurement table with participant numbers.

    Numbers come from all measurements, annotated or not. A measurement without a participant has none.
    """
    numbers = broadcast_if_small(number_participants(meth))
    return label_measurements(meth, annotation, gdc).join(numbers, "case_barcode", "left")
