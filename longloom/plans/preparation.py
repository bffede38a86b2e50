"""From raw measurements to prepared training data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import encode_label
from ..functions.numeric import clean_features
from ..operators.balance import smote, undersample
from ..operators.impute import impute
from ..operators.matrix import drop_sparse_columns, drop_sparse_rows, drop_unlabelled
from ..operators.measurements import label_measurements
from ..operators.pivot import pivot_vector, site_index
from ..operators.ranking import rank_sites
from ..operators.scale import standardize
from ..operators.split import split_exact, take_split
from ..session import materialize

# Class numbers of the status labels.
STATUS_CLASSES = {"tumor": 1, "normal": 0}


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    index: DataFrame | None


def clean(m: DataFrame, index: DataFrame | None = None, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Drop unlabelled rows, then sparse columns, then sparse rows."""
    m, index = drop_sparse_columns(drop_unlabelled(m), index, threshold)
    return drop_sparse_rows(m, threshold), index


def preprocess(m: DataFrame, index: DataFrame | None = None, threshold: float = 0.1, test_size: float = 0.3,
               fill: str = "knn", balance: str | None = None, ratio: float = 0.5, seed: int = 123,
               fit_on: str = "all") -> Prepared:
    """Clean, fill, split, standardise and balance a matrix.

    ``balance`` is None, ``smote`` or ``undersample`` and concerns the training rows only. With ``fit_on='all'``
    values are filled from all rows before the split; ``'train'`` splits first and fills from training rows. Which
    columns are too sparse is decided on all rows either way. NaN is a missing value.
    """
    cleaned, index = clean(materialize(clean_features(m)), index, threshold)
    cleaned = materialize(cleaned)
    stored = {"stored": True} if fill == "knn" else {}
    if fit_on == "all":
        filled = impute(cleaned, fill, **stored)
        train, test = take_split(materialize(split_exact(filled, test_size, seed)))
    else:
        train, test = take_split(materialize(split_exact(cleaned, test_size, seed)))
        fitted = {} if fill == "zero" else {"fit_on": train}
        train, test = (materialize(impute(part, fill, **stored, **fitted)) for part in (train, test))
    train, test = standardize(train, test)
    if balance == "smote":
        train = smote(train, ratio)
    elif balance == "undersample":
        train = undersample(train, ratio)
    return Prepared(train, test, index)


def prepare_labelled(m: DataFrame, index: DataFrame | None = None, threshold: float = 0.1,
                     fill: str = "knn") -> tuple[DataFrame, DataFrame | None]:
    """The cleaned and filled matrix as one labelled frame, without split, and the index of the columns left."""
    cleaned, index = clean(materialize(clean_features(m)), index, threshold)
    return impute(cleaned, fill).withColumn("label", F.col("label").cast("int")), index


def matrix_from_measurements(meth: DataFrame, annotation: DataFrame, gdc: DataFrame, k: int = 5000,
                             min_coverage: float = 0.9, on_duplicate: str = "error",
                             unknown: str = "drop") -> tuple[DataFrame, DataFrame]:
    """Label, rank, pivot: the ``(id, label, features)`` matrix of the k best sites and its site index.

    ``on_duplicate`` says what several measurements of one cell are: an ``error``, their ``sum`` or ``avg``. ``unknown`` says
    what happens to control and unlabelled samples: ``drop`` them, ``null`` their label or raise an ``error``.

    The ranked sites are stored, a short list read several times. The labelled measurements are not: labelling joins
    within the scan's tasks, so scanning the raw table twice costs less than writing it out.
    """
    betas = label_measurements(meth, annotation, gdc)
    index = site_index(materialize(rank_sites(betas, k, min_coverage)))
    rows = encode_label(pivot_vector(betas, index, on_duplicate=on_duplicate), "sample_status", STATUS_CLASSES,
                        unknown=unknown)
    return rows.select(F.col("aliquot_barcode").alias("id"), "label", "features"), index
