"""Feature matrices as CSV: an id column, one column per feature, label columns."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a CSV file or folder; one line is read."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def matrix_schema(columns: list[str], id_col: str, text_cols: tuple[str, ...]) -> T.StructType:
    """Id and label columns as text, every other column a number."""
    text = {id_col, *text_cols}
    return T.StructType([T.StructField(c, T.StringType() if c in text else T.DoubleType()) for c in columns])


def write_matrix_csv(df: DataFrame, path: str) -> None:
    """Write with a header. No row index is added: read back, it would pass for a feature."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_matrix_csv(spark: SparkSession, path: str, id_col: str, label_cols: tuple[str, ...]) -> DataFrame:
    """One wide row per line. The types follow from the header, so no pass over the data infers them.

    Every file of a folder must have its columns in the same order, and every line must fit; others are an error.
    ``read_matrix_parts`` reads what is not so well kept.
    """
    schema = matrix_schema(header_of(spark, path), id_col, label_cols)
    return spark.read.option("header", True).option("nanValue", "nan").option("enforceSchema", False).option(
        "mode", "FAILFAST").schema(schema).csv(path)


def write_vectors_csv(m: DataFrame, names: list[str], path: str, id_col: str = "id", label_cols: tuple[str, ...] = ("label",),
                      sep: str = ",") -> None:
    """Write ``(id, labels, features)`` rows as CSV lines with the feature names as header, without a column for each.

    NULL is an empty field. Ids and labels are quoted where they need it.
    """
    def field(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(text.rlike(f'[{sep}"\\r\\n]'), quoted).otherwise(text)

    values = F.array_join(F.transform("features", lambda x: F.coalesce(x.cast("string"), F.lit(""))), sep)
    line = F.concat_ws(sep, field(id_col), values, *[field(c) for c in label_cols])
    # a column's name is the header of each file
    m.select(line.alias(sep.join([id_col, *names, *label_cols]))).write.mode("overwrite").option("header", True).option(
        "quote", "\u0000").option("sep", "\u0001").option("escape", "\u0000").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def wide_to_vectors(df: DataFrame, id_col: str, label_cols: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``(id, labels, features)`` rows and the feature names in vector order; NaN becomes NULL."""
    names = [c for c in df.columns if c != id_col and c not in label_cols]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    features = F.transform(values, lambda x: F.when(~F.isnan(x), x))
    return df.select(id_col, *label_cols, features.alias("features")), names


REJECTED, FILE = "_rejected", "_file"


def _read_group(spark: SparkSession, header: tuple[str, ...], files: list[str], id_col: str, labels: tuple[str, ...],
                sep: str = ",") -> DataFrame:
    """Lines of files with one header; ``_rejected`` is the text of a line that does not fit.

    A line with fewer fields than the header has missing values. One with more fields, or with text where a number
    belongs, does not fit. What cannot be read as a file at all is an error.
    """
    schema = matrix_schema(list(header), id_col, labels).add(REJECTED, T.StringType())
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("nanValue", "nan").option(
        "sep", sep).option("columnNameOfCorruptRecord", REJECTED).schema(schema).csv(files)
    fields = F.split(F.col(REJECTED), f"[{sep}](?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    numbers = [i for i, c in enumerate(header) if c != id_col and c not in labels]

    def number(text: Column) -> Column:
        return (F.trim(text) == "") | F.lower(F.trim(text)).isin("nan") | F.trim(text).try_cast("double").isNotNull()

    fits = F.size(fields) < len(header)
    at = F.array(*[F.lit(i) for i in numbers]) if numbers else F.array().cast("array<int>")
    fits = fits & F.forall(at, lambda i: F.coalesce(number(F.get(fields, i)), F.lit(True)))
    # the reader checks only columns that are asked for, so every column is named, for none of its characters
    every = F.substring(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in header]), 1, 0)
    return rows.select(*[F.col(f"`{c}`") for c in header], F.when(~fits, F.concat(REJECTED, every)).alias(REJECTED),
                       F.col("_metadata.file_path").alias(FILE))


def _parts(spark: SparkSession, paths: list[str], id_col: str, label_cols: tuple[str, ...], max_files: int | None,
           project: str | None, project_col: str) -> tuple[DataFrame, list[str]]:
    chosen = sorted(paths)[:max_files]
    labels = tuple(label_cols) + ((project_col,) if project else ())
    columns = header_of(spark, chosen[0])
    groups: dict[tuple[str, ...], list[str]] = {tuple(columns): [chosen[0]]}
    for path in chosen[1:]:
        try:
            header = header_of(spark, path)
        except Exception as error:
            log.warning("skipping %s: %s", path, error)
            continue
        if set(header) != set(columns):
            log.warning("skipping %s: its columns differ from those of %s", path, chosen[0])
            continue
        groups.setdefault(tuple(header), []).append(path)
    frames = [_read_group(spark, header, files, id_col, labels) for header, files in groups.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out, columns


def read_matrix_parts(spark: SparkSession, paths: list[str], id_col: str, label_cols: tuple[str, ...],
                      max_files: int | None = None, project: str | None = None,
                      project_col: str = "project_short_name") -> DataFrame:
    """Rows of the first ``max_files`` part files, in path order, optionally of one project only.

    Columns are matched by name. The first file must be readable and sets the columns; a later one without a
    readable header of the same columns is skipped with a warning. Short lines have missing values; lines with too many
    fields or with text for a number are left out, and ``rejected_lines`` lists them.
    """
    out, columns = _parts(spark, paths, id_col, label_cols, max_files, project, project_col)
    out = out.filter(F.col(REJECTED).isNull())
    if project:
        out = out.filter(F.col(project_col) == project)
    return out.select(*columns)


def rejected_lines(spark: SparkSession, paths: list[str], id_col: str, label_cols: tuple[str, ...],
                   max_files: int | None = None) -> DataFrame:
    """``(file, line)`` for every line of the part files that ``read_matrix_parts`` leaves out."""
    out, _ = _parts(spark, paths, id_col, label_cols, max_files, None, "")
    return out.filter(F.col(REJECTED).isNotNull()).select(F.col(FILE).alias("file"), F.col(REJECTED).alias("line"))
