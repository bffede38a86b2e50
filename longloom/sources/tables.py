"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names a declared schema string may use.
SCHEMA_TYPES = {
    "STRING": T.StringType(),
    "FLOAT": T.DoubleType(),
    "FLOAT64": T.DoubleType(),
    "INTEGER": T.LongType(),
    "INT64": T.LongType(),
    "BOOLEAN": T.BooleanType(),
}


def scan_table(spark: SparkSession, source: str, fmt: str | None = "parquet",
               options: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a table: a path in some format, or with ``fmt=None`` a catalog table."""
    if fmt is None:
        return spark.table(source)
    return spark.read.format(fmt).options(**(options or {})).load(source)


def scan_query(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None,
               **frames: DataFrame) -> DataFrame:
    """Rows of a query. ``args`` fill ``:name`` markers, ``frames`` fill ``{name}`` table places."""
    return spark.sql(sql, args=dict(args or {}), **frames)


def query_template(spark: SparkSession, sql: str, tables: Mapping[str, str],
                   args: Mapping[str, object] | None = None) -> DataFrame:
    """Run a query whose table names are holes, written ``IDENTIFIER(:hole)``.

    Names and values are bound by the engine, never pasted into the text.
    """
    return spark.sql(sql, args={**tables, **(args or {})})


def parse_schema(text: str) -> T.StructType:
    """``"a:STRING, b:FLOAT"`` as a struct type."""
    fields = []
    for part in text.split(","):
        name, _, kind = part.partition(":")
        key = kind.strip().upper()
        if key not in SCHEMA_TYPES:
            raise ValueError(f"unknown type {kind.strip()!r} for column {name.strip()!r}")
        fields.append(T.StructField(name.strip(), SCHEMA_TYPES[key]))
    return T.StructType(fields)


def conform(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Columns of a declared schema, in its order and types. A value that does not fit is an error."""
    schema = parse_schema(schema) if isinstance(schema, str) else schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def replace_table(df: DataFrame, target: str, fmt: str | None = "parquet") -> DataFrame:
    """Create or replace a table from a query and return its rows."""
    if fmt is None:
        df.write.mode("overwrite").saveAsTable(target)
        return df.sparkSession.table(target)
    df.write.mode("overwrite").format(fmt).save(target)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(target)


def write_declared(df: DataFrame, target: str, schema: T.StructType | str, fmt: str | None = "parquet") -> DataFrame:
    """Replace a table's rows, creating it if needed, cast to a declared schema."""
    return replace_table(conform(df, schema), target, fmt)


def write_new(df: DataFrame, target: str, fmt: str | None = "parquet") -> None:
    """Write a table; an existing one is an error."""
    if fmt is None:
        df.write.mode("errorifexists").saveAsTable(target)
    else:
        df.write.mode("errorifexists").format(fmt).save(target)


def write_text(df: DataFrame, target: str, files: int | None = None, sep: str = ",") -> None:
    """One line per row, columns joined by ``sep``, NULL as empty; ``files`` sets the number of files."""
    line = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), sep)
    out = df.select(line.alias("value"))
    (out.repartition(files) if files else out).write.text(target)


# Bounds of the participant-number buckets.
BUCKET_START, BUCKET_END, BUCKET_SIZE = 1, 11000, 100


def range_bucket(number, start: int = BUCKET_START, end: int = BUCKET_END, size: int = BUCKET_SIZE):
    """Bucket of a number among the points start, start+size, ... up to ``end``; NULL outside all buckets."""
    last = start + (end - start) // size * size
    inside = (number >= start) & (number < last)
    return F.when(inside, F.floor((number - start) / size).cast("int"))


def write_bucketed(df: DataFrame, target: str, number: str = "row_number", bucket: str = "rn_bucket",
                   **bounds: int) -> None:
    """Write a table in one folder per range bucket, rows sorted by the number within each file.

    Rows are rebalanced by bucket: adaptive execution cuts a bucket of any size into tasks of the advisory partition
    size and puts small buckets together, so neither one huge bucket nor many tiny ones decide the file sizes.
    """
    out = df.withColumn(bucket, range_bucket(F.col(number), **bounds))
    (
        out.hint("rebalance", F.col(bucket))
        .sortWithinPartitions(bucket, number)
        .write.mode("overwrite").partitionBy(bucket).parquet(target)
    )


def read_slice(spark: SparkSession, source: str, first: int, last: int, number: str = "row_number",
               bucket: str = "rn_bucket", **bounds: int) -> DataFrame:
    """Rows of a bucketed table with ``first <= number <= last``.

    The bucket bounds are added as a predicate on the folder column, so only the folders of the slice are listed and
    read; numbers outside all buckets live in the NULL folder.
    """
    start, end, size = (bounds.get(k, v) for k, v in
                        (("start", BUCKET_START), ("end", BUCKET_END), ("size", BUCKET_SIZE)))
    top = start + (end - start) // size * size
    low = (max(first, start) - start) // size
    high = (min(last, top - 1) - start) // size
    folders = F.col(bucket).between(low, high)
    if first < start or last >= top:
        folders = folders | F.col(bucket).isNull()
    df = spark.read.parquet(source)
    return df.filter(folders & F.col(number).between(first, last)).drop(bucket)


def read_unnumbered(spark: SparkSession, source: str, number: str = "row_number", bucket: str = "rn_bucket") -> DataFrame:
    """The slice of a bucketed table that no range has: rows without a number, in the NULL folder."""
    return spark.read.parquet(source).filter(F.col(bucket).isNull() & F.col(number).isNull()).drop(bucket)


def append_slices(slices: list[DataFrame]) -> DataFrame:
    """All rows of several slices, columns matched by name."""
    out = slices[0]
    for part in slices[1:]:
        out = out.unionByName(part)
    return out


def run_query_step(spark: SparkSession, database: str, table: str, sql: str,
                   args: Mapping[str, object] | None = None) -> dict[str, str]:
    """Make sure the database exists, run the query into its table, and say where the result is."""
    spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:db)", args={"db": database})
    target = f"{database}.{table}"
    scan_query(spark, sql, args).write.mode("overwrite").saveAsTable(target)
    return {"output_dataset": database, "output_table": target}


def run_step(read: Callable[[], DataFrame], transform: Callable[[DataFrame], DataFrame] | None,
             write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Read, transform if a transform is given, write."""
    df = read()
    return write(df.transform(transform) if transform else df)
