"""Rankings and counts kept up to date slice by slice.

A slice, such as a range of participants, is aggregated once into a mergeable state that is stored: sums and counts per site,
and which samples there are as bitmaps over their numbers. Results come from the stored states alone. A new slice adds its
own state, one that is delivered again replaces it, and the measurements of the others are not read again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import clean_value
from .numbering import ordered_index
from .ranking import top_sites

STATUS = ("tumor", "normal")


# ---------------------------------------------------------------- distinct counts by bitmaps

def number_values(df: DataFrame, column: str, known: DataFrame | None = None, out: str = "number") -> DataFrame:
    """``column, out``: a dense number from 0 for each distinct value; NULL has none.

    With ``known``, numbers given before stay, and new values are numbered behind them.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    if known is None:
        return ordered_index(values, column, out=out).withColumn(out, F.col(out) - 1)
    # only values without a number are put in order
    new = ordered_index(values.join(known, column, "left_anti"), column, out=out)
    last = known.agg(F.coalesce(F.max(out), F.lit(-1)).alias("last")).scalar()
    return known.select(column, out).unionByName(new.withColumn("_last", last).select(column, (F.col(out) + F.col("_last")).alias(out)))


def bitmaps(df: DataFrame, number: str, by: list[str] | None = None) -> DataFrame:
    """``by, bucket, bitmap``: which numbers (0 and more) there are, one bit each, NULL left out.

    A task sends one bitmap of 4 KB for each bucket of 32,768 numbers that it meets, however many rows have them.
    """
    n = F.col(number)
    known = df.filter(n.isNotNull())
    return known.groupBy(*(by or []), F.bitmap_bucket_number(n + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n + 1)).alias("bitmap"))


def merge_bitmaps(maps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The union of bitmaps, of several slices for instance."""
    return maps.groupBy(*(by or []), "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def count_bitmaps(maps: DataFrame, by: list[str] | None = None, out: str = "distinct_count") -> DataFrame:
    """How many numbers there are, exactly; numbers that several bitmaps hold count once."""
    return merge_bitmaps(maps, by).groupBy(*(by or [])).agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).alias(out))


# ---------------------------------------------------------------- ranking state

def _sum(value: Column, condition: Column | None = None) -> tuple[Column, Column]:
    value = value if condition is None else F.when(condition, value)
    return F.count(value), F.coalesce(F.sum(value), F.lit(0.0))


def site_state(betas: DataFrame, classes: tuple[str, ...] = STATUS, site: str = "CpG_probe_id", value: str = "beta_value",
               label: str = "sample_status") -> DataFrame:
    """``site, n_rows, n_all, sum_all, n_<class>, sum_<class>``: what the means of a site are made of. NaN is a missing value."""
    df, v = clean_value(betas, value), F.col(value)
    parts = [F.count(F.lit(1)).alias("n_rows")]
    for name, condition in [("all", None), *[(c, F.col(label) == c) for c in classes]]:
        n, total = _sum(v, condition)
        parts += [n.alias(f"n_{name}"), total.alias(f"sum_{name}")]
    return df.groupBy(site).agg(*parts)


def merge_states(states: DataFrame, site: str = "CpG_probe_id") -> DataFrame:
    """The state of all rows behind several states."""
    return states.groupBy(site).agg(*[F.sum(c).alias(c) for c in states.columns if re.match("(n|sum)_", c)])


def state_means(state: DataFrame, classes: tuple[str, ...] = STATUS, site: str = "CpG_probe_id", count_nulls: bool = False) -> DataFrame:
    """Measurements and means of each site, as ``group_means`` has them."""
    mean = {c: F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}")).alias(f"mean_{c}") for c in ("all", *classes)}
    return state.select(site, F.col("n_rows" if count_nulls else "n_all").alias("cpg_count"), *mean.values())


@dataclass
class RankingStore:
    """Stored states under a path: ``numbers``, ``sites/slice=...`` and ``samples/slice=...``."""

    spark: SparkSession
    path: str
    classes: tuple[str, ...] = STATUS
    site: str = "CpG_probe_id"
    sample: str = "aliquot_barcode"

    def _folder(self, kind: str, name: str) -> str:
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"a slice's name has letters, digits, _ and - only, not {name!r}")
        return f"{self.path}/{kind}/slice={name}"

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}/slice=*")

    def add(self, name: str, betas: DataFrame, numbers: DataFrame) -> None:
        """Aggregate one slice and store its state in place of one of that name.

        ``numbers`` has a number for each sample of the slice (``number_values``), the same one in all slices. The slice is
        read twice, once for its sites and once for its samples.
        """
        site_state(betas, self.classes, self.site).write.mode("overwrite").parquet(self._folder("sites", name))
        samples = betas.select(self.sample).distinct().join(numbers, self.sample)
        bitmaps(samples, "number").write.mode("overwrite").parquet(self._folder("samples", name))

    def state(self) -> DataFrame:
        return merge_states(self._stored("sites").drop("slice"), self.site)

    def sample_count(self) -> DataFrame:
        """One row: distinct samples of all slices, those in several slices once."""
        return count_bitmaps(self._stored("samples").drop("slice"), out="sample_count")

    def rank(self, k: int = 5000, min_coverage: float = 0.9, score: str = "sum_squares_between_groups") -> DataFrame:
        """The ranking of all slices, as ``rank_sites`` makes it of all their measurements."""
        means = state_means(self.state(), self.classes, self.site)
        return top_sites(means, self.sample_count(), list(self.classes), k, min_coverage, True, self.site, score)
