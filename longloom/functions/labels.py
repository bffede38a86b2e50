"""Labels derived from sample identifiers and stage annotations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample codes of the public barcode format (characters 14-15 of an aliquot barcode).
TUMOR_CODES = [f"{i:02d}" for i in range(1, 10)]
NORMAL_CODES = [f"{i:02d}" for i in range(10, 20)]

# Annotated sub-stages per class. Values listed under None are known and have no class.
STAGE_CLASSES = {
    "pathologic_stage": {
        "stage_0": ["stage_0"],
        "stage_1": ["Stage I", "Stage IA", "Stage IB"],
        "stage_2": ["Stage II", "Stage IIA", "Stage IIB"],
        "stage_3": ["Stage III", "Stage IIIA", "Stage IIIB", "Stage IIIC"],
        "stage_4": ["Stage IV"],
        "stage_5": ["Stage X"],
    },
    "pathologic_T": {
        "stage_0": ["stage_0"],
        "stage_1": ["T1", "T1a", "T1b", "T1c"],
        "stage_2": ["T2", "T2a", "T2b"],
        "stage_3": ["T3", "T3a"],
        "stage_4": ["T4", "T4b", "T4d"],
        None: ["TX"],
    },
    "pathologic_N": {
        "stage_0": ["stage_0", "N0", "N0 (i-)", "N0 (i+)", "N0 (mol+)"],
        "stage_1": ["N1", "N1a", "N1b", "N1c", "N1mi"],
        "stage_2": ["N2", "N2a"],
        "stage_3": ["N3", "N3a", "N3b", "N3c"],
        None: ["NX"],
    },
    "pathologic_M": {
        "stage_0": ["stage_0", "M0", "cM0 (i+)"],
        "stage_1": ["M1"],
        None: ["MX"],
    },
}


def sample_code(barcode: Column) -> Column:
    return F.substring(barcode, 14, 2)


def sample_status(barcode: Column) -> Column:
    """normal, tumor or control; whatever is in neither code list, NULL included, is control."""
    code = sample_code(barcode)
    return (
        F.when(code.isin(NORMAL_CODES), "normal")
        .when(code.isin(TUMOR_CODES), "tumor")
        .otherwise("control")
    )


def stage_classes(target: str) -> list[str]:
    """The distinct classes of one annotation column, sorted."""
    return sorted(c for c in STAGE_CLASSES[target] if c is not None)


def stage_class(value: Column, target: str) -> Column:
    """Class of an annotated stage; NULL when the value is missing, unclassified or unknown."""
    known = [(v, c) for c, values in STAGE_CLASSES[target].items() if c is not None for v in values]
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known)])
    return F.try_element_at(table, value)


def stage_of_sample(code: Column, stage: Column) -> Column:
    """Stage of a sample: its patient's stage for tumor codes (9 and below), else ``stage_0``."""
    return F.when(code.try_cast("int") <= 9, stage).otherwise(F.lit("stage_0"))


def encode_label(df: DataFrame, column: str, classes: dict[str, int], out: str = "label",
                 unknown: str = "drop") -> DataFrame:
    """Map label text to class numbers.

    ``unknown`` says what happens to a value outside ``classes``: ``drop`` the row, ``null`` the label or raise an
    ``error``.
    """
    code = F.lit(None).cast("int")
    for name, number in reversed(list(classes.items())):
        code = F.when(F.col(column) == name, F.lit(number)).otherwise(code)
    if unknown == "error":
        message = F.concat(F.lit("unknown label: "), F.coalesce(F.col(column), F.lit("NULL")))
        known = F.coalesce(F.col(column).isin(list(classes)), F.lit(False))
        code = F.when(known, code).otherwise(F.raise_error(message).cast("int"))
    elif unknown not in ("drop", "null"):
        raise ValueError(f"unknown policy: {unknown}")
    out_df = df.withColumn(out, code)
    return out_df.filter(F.col(out).isNotNull()) if unknown == "drop" else out_df
