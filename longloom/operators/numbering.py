"""Row numbers over a whole table without sending it through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, hash32, known_id
from ..session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above, the position in it below


def ordered_index(df: DataFrame, *order: str, out: str = "row_number") -> DataFrame:
    """Dense 1..N numbers in sort order, NULL keys first.

    The rows are range-partitioned and sorted, each gets its position within its partition, and the counts of the
    partitions before (one row per partition) are added. The sorted rows are written once, since positions must not
    change between the counting and the adding. Pass narrow, distinct rows: the columns needed and no more.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(placed.withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_pos"), _LOCAL_BITS)
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    local = F.col("_pos").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    number = (F.col("_before") + local + 1).cast("bigint").alias(out)
    # at most one row per partition of the sort
    return stored.withColumn("_part", part).join(F.broadcast(before), "_part").select(*df.columns, number)


def _buckets(bits: int, key: Column) -> Column:
    return F.shiftright(key, HASH_BITS - bits)


def hash_rank(df: DataFrame, id_col: str, salt: object, by: str | None = None, out: str = "rank",
              bits: int = 16) -> DataFrame:
    """Dense 1..n numbers within each ``by`` group in the order of a seeded hash of the id.

    Rows are counted per slice of the hash range; the rank is the count of the slices before plus the position in the
    slice. A group of any size thus spreads evenly over ``2**bits`` slices, and no task sorts a whole group. NULL
    groups are ranked among themselves; a NULL id is an error.
    """
    # never NULL, so that a plain equality joins on it and the rows keep the partitioning of the window
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("NULL")) if by else F.lit("")
    keyed = df.withColumn("_g", group).withColumn("_h", hash32(known_id(id_col), salt))
    keyed = keyed.withColumn("_b", _buckets(bits, F.col("_h")))
    counts = keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(
        "_g", "_b",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
    )
    inside = F.row_number().over(W.partitionBy("_g", "_b").orderBy("_h", id_col))
    joined = keyed.withColumn("_in", inside).join(before, ["_g", "_b"])
    return joined.select(*df.columns, (F.col("_before") + F.col("_in")).cast("bigint").alias(out))


def hash_cut(df: DataFrame, id_col: str, salt: object, quota: DataFrame, by: str | None = None,
             bits: int = 16) -> DataFrame:
    """Where to cut each group so that exactly its quota of rows comes before the cut, in hash order.

    ``quota`` has ``(g, quota)`` rows, g being the value of ``by`` (any one value without ``by``). The result has
    ``(g, cut_hash, cut_id)``, the last row within the quota; a group whose quota is 0 has no row. Counting hash
    slices finds the slice with the cut, and only that slice, about a ``2**bits``-th of the group, is sorted. A NULL id
    is an error.
    """
    group = F.col(by) if by else F.lit(0)
    keyed = df.select(group.alias("g"), F.col(id_col).alias("cut_id"), hash32(known_id(id_col), salt).alias("cut_hash"))
    keyed = keyed.withColumn("b", _buckets(bits, F.col("cut_hash")))
    counts = keyed.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("g").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    slices = counts.withColumn("upto", F.sum("n").over(upto))
    crossing = (
        slices.join(quota, "g")
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("g", "b", (F.col("quota") - (F.col("upto") - F.col("n"))).alias("take"))
    )
    place = F.row_number().over(W.partitionBy("g", "b").orderBy("cut_hash", "cut_id"))
    # one crossing slice per group
    return (
        keyed.join(F.broadcast(crossing), ["g", "b"]).withColumn("place", place)
        .filter(F.col("place") == F.col("take")).select("g", "cut_hash", "cut_id")
    )
