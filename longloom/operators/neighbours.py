"""Exact nearest rows under missing values.

The distance of two rows is taken over the positions both have, scaled up to the full number of positions:
``sqrt(D / n * sum((x - y)^2))`` over n shared positions. It is no metric, so no index can skip pairs and every row in
question has to be compared with every candidate. The comparison is laid out as a grid: query rows in blocks, candidate
rows in splits, one cell of the grid per (block, split). Spark copies each row to the cells that need it and shuffles
them there; a cell holds one block, streams its split past it in Arrow batches, and puts out only the k best per
question. No pair is ever a row of a frame, and both sides of a cell are bounded however large the groups are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the task code travels with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_MB = 512  # of a cell's query block
BLOCK_ROWS = 8192
SPLIT_ROWS = 32768
STEP_ROWS = 2048  # donors compared at a time
TILE_ROWS = 256  # queries compared at a time: a cell's work arrays have these times a step's donors, 4 MB each
MAX_TASKS = 20_000  # a task works through several cells, one after the other, when there are more
DIST_DIGITS = 9
_SLACK = 2 * 10.0 ** -DIST_DIGITS


class QueryBlock:
    """The query rows of one cell and their best candidates so far."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int, per_gap: bool):
        self.ids, self.k, self.per_gap = ids, k, per_gap
        self.values, self.known = values, ~np.isnan(values)
        self.filled = np.where(self.known, values, 0.0)
        # what is asked: each missing position of a row, or (-1) the row as a whole
        self.asked = [np.flatnonzero(~row) if per_gap else np.array([-1]) for row in self.known]
        self.dist = [np.full((len(a), k), np.inf) for a in self.asked]
        self.donor = [np.zeros((len(a), k), dtype=ids.dtype) for a in self.asked]
        self.value = [np.zeros((len(a), k)) for a in self.asked]

    def offer(self, ids: np.ndarray, values: np.ndarray) -> None:
        known = ~np.isnan(values)
        filled = np.where(known, values, 0.0)
        mask, squared = known.astype(float), filled ** 2
        for at in range(0, len(self.ids), TILE_ROWS):
            low, high = self._bounds(slice(at, at + TILE_ROWS), mask, filled, squared)
            for i, asked in enumerate(self.asked[at:at + TILE_ROWS]):
                if len(asked):
                    self._merge(at + i, ids, values, known, low[i], high[i])

    def _bounds(self, tile: slice, mask: np.ndarray, filled: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which two numbers each distance lies, by matrix products; only rows that may be among the best are
        compared exactly. Work arrays are as large as a tile, whatever the block's rows."""
        own, qmask = self.filled[tile], self.known[tile].astype(float)
        squares = (own ** 2) @ mask.T + qmask @ squared.T
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = mask.shape[1] / (qmask @ mask.T)
            rough = (squares - 2.0 * (own @ filled.T)) * scale
            error = 1e-12 * squares * scale
        rough[~np.isfinite(rough)] = np.inf
        error[~np.isfinite(error)] = 0.0
        return np.sqrt(np.maximum(rough - error, 0.0)), np.sqrt(np.maximum(rough + error, 0.0))

    def _has(self, i: int, ids: np.ndarray, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which of the rows can answer which question of query i."""
        if self.per_gap:
            return known[np.ix_(rows, self.asked[i])]
        return (ids[rows] != self.ids[i])[:, None]

    def _merge(self, i, ids, values, known, low, high) -> None:
        k = self.k
        bound = self.dist[i][:, -1]  # the k-th best so far, by question
        near = np.flatnonzero((low <= bound.max() + _SLACK) & np.isfinite(low))
        if len(near) > k:
            # whatever is certainly behind the k-th of these on every question is out, too
            reach = np.where(self._has(i, ids, known, near), high[near, None], np.inf)
            bound = np.minimum(bound, np.partition(reach, k - 1, axis=0)[k - 1])
            near = near[low[near] <= bound.max() + _SLACK]
        if not len(near):
            return
        has = self._has(i, ids, known, near)
        shared = known[near] & self.known[i]
        diff = np.where(shared, values[near] - self.values[i], 0.0)
        exact = np.sqrt(values.shape[1] / shared.sum(axis=1) * (diff ** 2).sum(axis=1)).round(DIST_DIGITS)
        rows = len(self.asked[i])
        offered = np.where(has, exact[:, None], np.inf).T
        donated = values[near][:, self.asked[i]].T if self.per_gap else np.zeros((rows, len(near)))
        dist = np.concatenate([self.dist[i], offered], axis=1)
        donor = np.concatenate([self.donor[i], np.broadcast_to(ids[near], (rows, len(near)))], axis=1)
        value = np.concatenate([self.value[i], donated], axis=1)
        best = np.lexsort((donor, dist), axis=1)[:, :k]
        self.dist[i] = np.take_along_axis(dist, best, axis=1)
        self.donor[i] = np.take_along_axis(donor, best, axis=1)
        self.value[i] = np.take_along_axis(value, best, axis=1)

    def answers(self) -> dict[str, np.ndarray]:
        parts = []
        for i, asked in enumerate(self.asked):
            row, col = np.nonzero(np.isfinite(self.dist[i]))
            parts.append((np.repeat(self.ids[i:i + 1], len(row)), asked[row], self.dist[i][row, col],
                          self.donor[i][row, col], self.value[i][row, col]))
        names = ["id", "idx", "dist", "donor", "value"]
        return {n: np.concatenate([p[j] for p in parts]) for j, n in enumerate(names)}


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _ids(column: pa.Array) -> np.ndarray:
    found = column.to_numpy(zero_copy_only=False)
    return found.astype(str) if found.dtype == object else found


def _cell_worker(k: int, per_gap: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, asking, block = None, [], None

        def finish():
            found = block.answers() if block is not None else None
            if found is not None and len(found["id"]):
                found["idx"] = found["idx"].astype(np.int32)
                yield pa.RecordBatch.from_pydict({n: pa.array(v) for n, v in found.items()})

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("_g", "_q", "_d", "_side")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows]):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                here, side = tuple(keys[:3, start]), keys[3, start]
                if here != cell:
                    yield from finish()
                    cell, asking, block = here, [], None
                if side == 0:
                    asking.append((_ids(part.column("id")), _matrix(part.column("features"))))
                elif asking or block is not None:
                    if block is None:
                        block = QueryBlock(np.concatenate([a[0] for a in asking]),
                                           np.concatenate([a[1] for a in asking]), k, per_gap)
                        asking = []
                    for at in range(0, part.num_rows, STEP_ROWS):
                        step = part.slice(at, STEP_ROWS)
                        block.offer(_ids(step.column("id")), _matrix(step.column("features")))
        yield from finish()

    return work


def block_rows_for(width: int, memory_mb: int = BLOCK_MB) -> int:
    """Query rows of a block that fit in the memory.

    Every donor row is copied once per block, so blocks are as large as they can be, up to ``BLOCK_ROWS``: the values of a
    block are held four times over while it is put together. The work arrays of a comparison don't grow with it.
    """
    return max(64, min(BLOCK_ROWS, (memory_mb << 17) // (4 * max(1, width))))


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def nearest(queries: DataFrame, donors: DataFrame, sizes: dict[object, tuple[int, int]], k: int, per_gap: bool,
            group: str | None = None, block_rows: int = 2048, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The k nearest donors as ``(id, idx, best)``, best an array of (dist, donor, value) sorted by distance, then id.

    ``per_gap`` asks once per missing position of a query, among donors that have it; otherwise once per query (idx
    -1), among other rows. With ``group`` a query meets donors of its own group only. ``sizes`` gives the number of
    queries and donors of each group (key None without groups).
    """
    grid = {g: (_blocks(q, block_rows), _blocks(d, split_rows)) for g, (q, d) in sizes.items()}
    order = {g: i for i, g in enumerate(grid)}

    def by_group(values: dict[object, int]) -> Column:
        if group is None:
            return F.lit(values[None])
        if len(values) > 16:  # one flat expression for many groups
            return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(group))
        out = F.lit(None).cast("int")
        for g, v in values.items():
            out = F.when(F.col(group) == F.lit(g), F.lit(v)).otherwise(out)
        return out

    n_blocks, n_splits = by_group({g: b for g, (b, _) in grid.items()}), by_group({g: s for g, (_, s) in grid.items()})
    place = F.xxhash64("id")

    def side(df: DataFrame, number: int) -> DataFrame:
        own_block, own_split = F.pmod(place, n_blocks), F.pmod(F.shiftright(place, 20), n_splits)
        copies = F.explode(F.sequence(F.lit(0), (n_splits if number == 0 else n_blocks) - 1))
        df = df.withColumn("_g", by_group(order)).filter(F.col("_g").isNotNull())
        q, d = (own_block.cast("int"), copies) if number == 0 else (copies, own_split.cast("int"))
        return df.select("_g", q.alias("_q"), d.alias("_d"), F.lit(number).alias("_side"), "id", "features")

    cells = sum(b * s for b, s in grid.values())
    laid_out = side(queries, 0).unionByName(side(donors, 1))
    tasks = min(2 * cells, MAX_TASKS)
    laid_out = laid_out.repartition(tasks, "_g", "_q", "_d").sortWithinPartitions("_g", "_q", "_d", "_side")
    id_type = queries.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("idx", T.IntegerType()), T.StructField("dist", T.DoubleType()),
        T.StructField("donor", id_type), T.StructField("value", T.DoubleType()),
    ])
    found = laid_out.mapInArrow(_cell_worker(k, per_gap), schema)
    # k per split the query met
    best = F.slice(F.array_sort(F.collect_list(F.struct("dist", "donor", "value"))), 1, k)
    return found.groupBy("id", "idx").agg(best.alias("best"))
