"""Tables stored in sorted buckets of a key, and joins that leave them where they are.

A measurement table is written once, its rows placed in buckets by the key that lookups come by. A lookup that is too large
to broadcast is then written into the same buckets, and the join reads bucket against bucket: the lookup moves, the
measurements don't.

A bucket is one task of such a join, and adaptive execution cannot split it. Keys with more rows than a bucket ought to have,
of which there are fewer than buckets, are therefore spread over as many buckets as they need by a salt, and the lookup's
rows for them are repeated once for each salt.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize_measured, shared_dir

SALT = "_salt"


@dataclass
class Keyed:
    """A stored table: its name, key, buckets, columns, and the keys that are spread (``key, salts``, fewer rows than buckets)."""

    spark: SparkSession
    name: str
    key: str
    buckets: int
    columns: list[str]
    spread: DataFrame

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def join(self, lookup: DataFrame, how: str = "inner") -> DataFrame:
        """The rows joined to a lookup by the key, ``inner``, ``left`` or ``left_semi``.

        The lookup may have any size and several rows for a key; a NULL key matches nothing. Only the lookup is shuffled.
        """
        if how not in ("inner", "left", "left_semi"):
            raise ValueError(f"no such join: {how}")
        own = lookup.filter(F.col(self.key).isNotNull()).join(F.broadcast(self.spread), self.key, "left")
        salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
        other = _store(own.select(*lookup.columns, F.explode(salts).alias(SALT)), self.key, self.buckets)
        left = self.spark.table(self.name)
        both = left.join(self.spark.table(other).hint("merge"), [self.key, SALT], how)
        return both.drop(SALT)


def _place(df: DataFrame, key: str, buckets: int) -> DataFrame:
    # the same hash that the buckets go by: a task writes one bucket, as one file
    return df.repartition(buckets, key, SALT).sortWithinPartitions(key, SALT)


def _store(df: DataFrame, key: str, buckets: int) -> str:
    name = f"longloom_keyed_{uuid.uuid4().hex}"
    writer = _place(df, key, buckets).write.format("parquet").bucketBy(buckets, key, SALT).sortBy(key, SALT)
    writer.option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return name


def store_by_key(df: DataFrame, key: str, buckets: int | None = None) -> Keyed:
    """Write a table in sorted buckets of a key.

    Rows with a NULL key are spread like those of a very frequent key. Columns named ``_salt`` or ``_salts`` are an error.
    """
    if {SALT, "_salts"} & set(df.columns):
        raise ValueError("columns named _salt or _salts are in the way")
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts, seen = materialize_measured(df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("_n")), all=F.sum("_n"))
    share = max(1, -(-(seen["all"] or 0) // buckets))
    # fewer keys than buckets have more rows than a bucket's share
    spread = counts.filter(F.col("_n") > share).select(F.col(key), F.least(F.ceil(4 * F.col("_n") / share), F.lit(buckets)).cast("int").alias("_salts"))
    spread = materialize_measured(spread)[0]
    joined = df.withColumn("_key", F.col(key)).join(F.broadcast(spread.withColumnRenamed(key, "_hot")), F.col("_key").eqNullSafe(F.col("_hot")), "left")
    salted = joined.withColumn(SALT, _salt(df.columns)).drop("_key", "_hot", "_salts")
    return Keyed(df.sparkSession, _store(salted, key, buckets), key, buckets, df.columns, spread.filter(F.col(key).isNotNull()))


def _salt(columns: list[str]) -> Column:
    """A salt from the whole row: a task that is run again places it alike. Equal rows are told apart by no hash and share a salt."""
    return F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.col("_salts")).cast("int"), F.lit(0))
