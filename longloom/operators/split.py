"""Train/test splits and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash32, known_id, uniform
from .numbering import hash_cut, hash_rank, ordered_index


def _share(rows: Column, share: float) -> Column:
    return F.ceil(rows * F.lit(float(share))).cast("bigint")


def split_exact(m: DataFrame, test_size: float = 0.3, seed: object = 123, id_col: str = "id",
                out: str = "is_test") -> DataFrame:
    """Mark exactly ``ceil(test_size * n)`` rows as test: the first ones in seeded hash order.

    The rows are not sorted or moved. The last test row is looked up and each row compares itself with it. A NULL id
    is an error.
    """
    quota = m.agg(_share(F.count(F.lit(1)), test_size).alias("quota")).select(F.lit(0).alias("g"), "quota")
    cut = hash_cut(m, id_col, seed, quota).select(F.struct("cut_hash", "cut_id")).scalar()
    own = F.struct(hash32(known_id(id_col), seed).alias("cut_hash"), F.col(id_col).alias("cut_id"))
    return m.withColumn("_cut", cut).withColumn(out, F.coalesce(own <= F.col("_cut"), F.lit(False))).drop("_cut")


def split_hash(m: DataFrame, test_size: float = 0.3, seed: object = 123, id_col: str = "id",
               out: str = "is_test") -> DataFrame:
    """Mark about ``test_size`` of the rows as test, each row on its own: no pass over the table. A NULL id is an error."""
    return m.withColumn(out, uniform(known_id(id_col), seed) < F.lit(float(test_size)))


def split_ordered(m: DataFrame, test_size: float = 0.3, id_col: str = "id", out: str = "is_test") -> DataFrame:
    """Mark the last ``ceil(test_size * n)`` rows in id order as test; ids are distinct, and a NULL id is an error.

    On a training set with synthetic rows appended, whose ids are the highest, this tests on those rows; split first,
    then augment.
    """
    m = m.withColumn(id_col, known_id(id_col))
    ids = ordered_index(m.select(id_col), id_col, out="_number")
    last = ids.agg((F.count(F.lit(1)) - _share(F.count(F.lit(1)), test_size)).alias("n")).scalar()
    cut = ids.withColumn("_last", last).filter(F.col("_number") == F.col("_last")).select(id_col).scalar()
    return m.withColumn("_cut", cut).withColumn(out, F.coalesce(F.col(id_col) > F.col("_cut"), F.lit(True))).drop("_cut")


def split_buckets(df: DataFrame, key: str, seed: object = "split", train: int = 2, evaluation: int = 1,
                  out: str = "split") -> DataFrame:
    """Assign each key to ``train`` or ``eval`` by hash bucket, two to one unless told otherwise."""
    bucket = F.pmod(hash32(key, seed), F.lit(train + evaluation))
    return df.withColumn(out, F.when(bucket < train, "train").otherwise("eval"))


def take_split(m: DataFrame, flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    return m.filter(~F.col(flag)).drop(flag), m.filter(flag).drop(flag)


def stratified_folds(m: DataFrame, folds: int = 5, label: str = "label", id_col: str = "id", seed: object = "fold",
                     out: str = "fold") -> DataFrame:
    """Deal the rows of every class out over the folds in seeded hash order: fold sizes differ by one at most."""
    ranked = hash_rank(m, id_col, seed, by=label, out="_rank")
    return ranked.withColumn(out, F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank")
