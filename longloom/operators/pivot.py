"""Long measurements to one row per sample."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import broadcast_if_small

log = logging.getLogger(__name__)


def keep_sites(betas: DataFrame, sites: DataFrame, site: str = "CpG_probe_id") -> DataFrame:
    """Measurements of the listed sites: a semi join, never a list of literals."""
    return betas.join(broadcast_if_small(sites.select(site).distinct()), site, "left_semi")


def site_index(sites: DataFrame, site: str = "CpG_probe_id", order: list[Column] | None = None) -> DataFrame:
    """Vector positions 0..D-1 of the listed sites, by name or by a given order.

    The list is as long as a feature vector, so numbering it in one task is bounded by what a row can hold.
    """
    keys = order or [F.col(site)]
    number = F.row_number().over(W.orderBy(*keys)) - 1
    return sites.select(site, number.cast("int").alias("idx"))


def unique_cells(df: DataFrame, row: str, column: str, value: str, on_duplicate: str = "error",
                 also: list[Column] | None = None) -> DataFrame:
    """One value per (row, column).

    ``on_duplicate``: ``error`` fails the job when a cell has several measurements, ``sum`` and ``avg`` combine them.
    Cells are combined before they move, so a sample or cell with very many rows is cheap.
    """
    combine = {"error": F.max, "sum": F.sum, "avg": F.avg}[on_duplicate](value)
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"), combine.alias("_v"), *(also or []))
    if on_duplicate == "error":
        message = F.concat(F.lit("duplicate cell: "), F.col(row).cast("string"), F.lit(", "),
                           F.col(column).cast("string"))
        cells = cells.withColumn("_v", F.when(F.col("_n") > 1, F.raise_error(message).cast("double"))
                                 .otherwise(F.col("_v")))
    return cells.withColumnRenamed("_v", value).drop("_n") if value not in (row, column) else cells.drop("_n")


def dense(cells: Column, length: Column) -> Column:
    """Array of ``length`` values from (idx, x) structs sorted by idx; absent positions are NULL.

    Each struct becomes its value behind as many NULLs as positions were skipped, which costs time linear in the
    length; looking every position up in a map would be quadratic.
    """
    gap = F.lit(None).cast("double")

    def filled(cell: Column, i: Column) -> Column:
        before = F.coalesce(F.get(cells, i - 1)["idx"], F.lit(-1))
        return F.concat(F.array_repeat(gap, (cell["idx"] - before - 1).cast("int")), F.array(cell["x"]))

    last = F.coalesce(F.try_element_at(cells, F.lit(-1))["idx"], F.lit(-1))
    return F.concat(F.flatten(F.transform(cells, filled)), F.array_repeat(gap, (length - 1 - last).cast("int")))


def collect_cells(idx: str, x: str) -> Column:
    """Aggregate the cells of one row, sorted by position. Cells must be unique, so there are at most D."""
    return F.array_sort(F.collect_list(F.struct(F.col(idx).cast("int").alias("idx"), F.col(x).alias("x"))))


def cells_to_vectors(cells: DataFrame, id_col: str, length: Column | int, idx: str = "idx", x: str = "x",
                     carry: list[Column] | None = None) -> DataFrame:
    """``(id, ..., features)`` from unique (id, idx, x) cells. ``carry`` are aggregates to keep beside the vector."""
    length = F.lit(length) if isinstance(length, int) else length
    rows = cells.groupBy(id_col).agg(*(carry or []), collect_cells(idx, x).alias("_cells"))
    rows = rows.withColumn("_length", length)
    return rows.withColumn("features", dense(F.col("_cells"), F.col("_length"))).drop("_cells", "_length")


def vectors_to_cells(m: DataFrame, *keys: str) -> DataFrame:
    """``(keys, idx, x)``: one row per vector position, missing values included."""
    return m.select(*keys, F.posexplode("features").alias("idx", "x"))


def pivot_vector(betas: DataFrame, index: DataFrame, row: str = "aliquot_barcode", site: str = "CpG_probe_id",
                 value: str = "beta_value", label: str = "sample_status",
                 on_duplicate: str = "error") -> DataFrame:
    """``(row, label, features)``: the values of a sample at the indexed sites, NULL where it has none.

    A sample with several labels gives one row per label. Unindexed measurements are dropped in the scan's own tasks;
    what is shuffled is the kept cells, by plain aggregates, and the distinct labels of samples beside them.
    """
    hits = betas.join(broadcast_if_small(index), site)
    cells = unique_cells(hits, row, "idx", value, on_duplicate)
    length = index.agg(F.count(F.lit(1))).scalar()
    rows = cells_to_vectors(cells, row, length, x=value)
    labels = hits.select(F.col(row).alias("_row"), F.col(label)).distinct()
    return rows.join(labels, F.col(row).eqNullSafe(F.col("_row"))).select(row, label, "features")


def pivot_wide(betas: DataFrame, sites: DataFrame, row: str = "aliquot_barcode", site: str = "CpG_probe_id",
               value: str = "beta_value", on_duplicate: str = "error",
               order: list[Column] | None = None) -> DataFrame:
    """One column per listed site, in list order; a site without values still gets its (NULL) column.

    The list becomes the columns of a schema. With thousands of sites ``pivot_vector`` makes the lighter plan.
    """
    names = [r[0] for r in sites.orderBy(*(order or [F.col(site)])).select(site).collect()]
    cells = unique_cells(keep_sites(betas, sites, site), row, site, value, on_duplicate)
    return cells.groupBy(row).pivot(site, names).agg(F.max(value)).select(row, *[f"`{n}`" for n in names])


def pivot_sum(df: DataFrame, rows: list[str], column: str, value: str, max_columns: int | None = None,
              aggregation: str = "sum", limit: int | None = None) -> DataFrame:
    """Pivot with an aggregate over all columns, or over the first ``max_columns`` by name, which is logged."""
    listed = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    names = [r[0] for r in (listed.limit(max_columns + 1) if max_columns is not None else listed).collect()]
    if max_columns is not None and len(names) > max_columns:
        log.warning("pivot by %s: columns from %s on are left out", column, names[max_columns])
        names = names[:max_columns]
    how = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[aggregation.lower()]
    out = df.groupBy(*rows).pivot(column, names).agg(how(value))
    return out.orderBy(*rows).limit(limit) if limit else out


def pivot_class_means(betas: DataFrame, classes: list[str], site: str = "CpG_probe_id",
                      label: str = "sample_status", value: str = "beta_value") -> DataFrame:
    """Mean value of each listed class per site, one column per class."""
    return betas.groupBy(site).pivot(label, classes).agg(F.avg(value))


def distinct_labels(betas: DataFrame, row: str = "aliquot_barcode", label: str = "sample_status") -> DataFrame:
    return betas.select(row, label).distinct()


def labelled_pivot(pivot: DataFrame, betas: DataFrame, row: str = "aliquot_barcode",
                   label: str = "sample_status") -> DataFrame:
    """All columns of the pivot plus the sample's label; several labels give several rows."""
    labels = distinct_labels(betas, row, label)
    return pivot.alias("a").join(labels.alias("b"), F.col(f"a.{row}") == F.col(f"b.{row}"), "left").select(
        "a.*", f"b.{label}")
