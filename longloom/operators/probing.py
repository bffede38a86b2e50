"""Nearest rows under missing values, approximately: candidates are looked for near pivots.

A bounded number of rows, filled by column means, are pivots. Every candidate belongs to the cell of its nearest pivot, by the
distance over the columns that it has, and a question meets the candidates of the pivots nearest to it. Within cells the
comparison is the exact one. How many cells a question needs is measured: for a sample of questions the exact neighbours are
found, and as many cells are looked into as it takes to hold the wanted share of them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .neighbours import _matrix, nearest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 64
SAMPLE = 256  # questions that are answered exactly, to measure by
ROUNDS = 3  # of moving pivots to the means of their cells


def cell_order(df: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    """The rows with ``cells``: the ``n`` nearest pivots, the nearest first. A row without any value is near the first ones."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            known = ~np.isnan(x)
            filled = np.where(known, x, 0.0)
            far = (filled ** 2).sum(axis=1)[:, None] + known @ (pivots ** 2).T - 2 * filled @ pivots.T
            order = np.argsort(far, axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))],
                                             names=["id", "features", "cells"])

    schema = T.StructType([df.schema["id"], T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return df.select("id", F.col("features").cast("array<double>").alias("features")).mapInArrow(each, schema)


def choose_pivots(donors: DataFrame, width: int, cells: int = CELLS, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``cells`` rows, the first by a hash, moved to the means of their cells a few times.

    A mean is over the values that a column has in the cell; what a cell or table knows nothing of is the column's mean, or 0.
    """
    cast = donors.select("id", F.col("features").cast("array<double>").alias("features"))
    means = np.zeros(width)  # a row for each column comes back
    for r in cast.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).collect():
        means[r["i"]] = r["x"] or 0.0
    first = cast.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    pivots = np.array([[m if v is None else v for v, m in zip(r["features"], means)] for r in first]).reshape(len(first), width)
    for _ in range(rounds if len(pivots) > 1 else 0):
        own = cell_order(cast, pivots, 1).select(F.col("cells")[0].alias("cell"), F.posexplode("features").alias("i", "x"))
        for r in own.groupBy("cell", "i").agg(F.avg("x").alias("x")).filter("x IS NOT NULL").collect():  # cells x columns
            pivots[r["cell"], r["i"]] = r["x"]
    return pivots


def nearest_probed(queries: DataFrame, donors: DataFrame, k: int, per_gap: bool, block_rows: int, split_rows: int, recall: float = 0.95,
                   cells: int = CELLS, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """As ``nearest`` without groups, and what was measured: the number of cells, how many are probed, and the sample's recall.

    ``recall`` is the share of a question's exact neighbours that shall be among the candidates, on average over a sample of
    ``sample`` questions. A table with fewer neighbours for all its questions is searched whole.
    """
    n_donors = donors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")).first()
    if not n_donors["n"]:
        return nearest(queries, donors, {None: (0, 0)}, k, per_gap, block_rows=block_rows, split_rows=split_rows), {"cells": 0, "probes": 0, "recall": 1.0}
    pivots = choose_pivots(donors, n_donors["width"] or 0, cells)
    placed = materialize(cell_order(donors, pivots, 1).select("id", "features", F.col("cells")[0].alias("cell")))
    asked = materialize(cell_order(queries, pivots, len(pivots)))

    some = materialize(asked.orderBy(F.xxhash64("id"), "id").limit(sample))
    exact = nearest(some.select("id", "features"), donors.select("id", "features"), {None: (sample, n_donors["n"])}, k, per_gap,
                    block_rows=block_rows, split_rows=split_rows)
    pairs = exact.select("id", F.explode("best.donor").alias("donor"))
    where = pairs.join(some.select("id", "cells"), "id").join(placed.select(F.col("id").alias("donor"), "cell"), "donor")
    found = {r["at"]: r["n"] for r in where.groupBy(F.array_position("cells", F.col("cell")).alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held, total, probes = 0, sum(found.values()), len(pivots)
    for p in range(1, len(pivots) + 1):
        held += found.get(p, 0)
        if total and held >= recall * total:
            probes = p
            break
    near = asked.select("id", "features", F.explode(F.slice("cells", 1, probes)).alias("cell"))
    sizes = {r["cell"]: [0, r["n"]] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["cell"] in sizes:
            sizes[r["cell"]][0] = r["n"]
    best = nearest(near, placed, {c: tuple(s) for c, s in sizes.items()}, k, per_gap, group="cell", block_rows=block_rows, split_rows=split_rows)
    return best, {"cells": len(pivots), "probes": probes, "recall": held / total if total else 1.0}
