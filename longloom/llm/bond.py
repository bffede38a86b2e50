"""Hard negatives by BOND: a branch-and-bound scan of vectors stored by dimension.

A block of rows is kept as columns, one per dimension, with each column's least and highest value. An anchor reads the
columns in descending order of its own components' magnitude and adds to every candidate's score. What the columns not yet
read can still add lies between sums of products with their extremes, so that each candidate's score has a lower and an
upper bound; candidates that can no longer be in the result leave the bitmap, and later columns are read for those left.

Two such scans make the result. The first looks for an anchor's highest rows of its own label, its positives. The second
looks, for each positive's score, for the highest rows of other labels whose score lies in a window relative to it; one
scan serves all positives of an anchor. Anchors and rows are cut into blocks of bounded size that meet in the cells of a
grid; a cell gives as many rows for each anchor or positive as are wanted, and the best over the cells are the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize, materialize_measured
from .cover_tree import scaled, usable

ANCHOR_BLOCK = 1024
BLOCK_BYTES = 16 << 20  # of the columns of one block
READ = 8  # columns between two looks at the bounds


class Columns:
    """Rows of whole numbers, stored by dimension."""

    def __init__(self, rows: np.ndarray):
        self.values = np.ascontiguousarray(rows.T)
        self.low, self.high = self.values.min(axis=1), self.values.max(axis=1)
        self.read = 0  # values read so far, to measure by

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray,
             may_win: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and exact scores of the candidates left.

        ``may_win`` tells from the lower and upper bounds of scores which candidates stay. In the end both are the scores.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.low, anchor * self.high])[:, order]
        rest = np.zeros((2, len(order) + 1), np.int64)
        rest[0, :-1] = np.cumsum(ends.min(axis=0)[::-1])[::-1]
        rest[1, :-1] = np.cumsum(ends.max(axis=0)[::-1])[::-1]
        left = np.flatnonzero(bitmap)
        scores = np.zeros(len(left), np.int64)
        for i in range(0, len(order), READ):
            for d in order[i:i + READ].tolist():
                column = self.values[d]
                scores += anchor[d] * (column if len(left) == len(column) else column[left])
            self.read += len(left) * len(order[i:i + READ])
            done = min(i + READ, len(order))
            stays = may_win(scores + rest[0, done], scores + rest[1, done])
            if not stays.all():
                left, scores = left[stays], scores[stays]
            if not len(left):
                break
        return left, scores


def kth(values: np.ndarray, k: int) -> int | float:
    """The kth highest value, and no bound if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def first(left: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id."""
    return np.lexsort((ids[left], -scores))[:k]


def highest(columns: Columns, anchor: np.ndarray, bitmap: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the k highest candidates."""
    left, scores = columns.scan(anchor, bitmap, lambda low, high: high >= kth(low, k))
    best = first(left, scores, ids, k)
    return left[best], scores[best]


def in_windows(columns: Columns, anchor: np.ndarray, bitmap: np.ndarray, ids: np.ndarray, k: int,
               windows: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least and highest score) rows and scores of the k highest candidates within it."""

    def may_win(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for least, most in windows:
            sure = low[(low >= least) & (high <= most)]
            stays |= (high >= max(least, kth(sure, k))) & (low <= most)
        return stays

    left, scores = columns.scan(anchor, bitmap, may_win)
    out = []
    for least, most in windows:
        within = np.flatnonzero((scores >= least) & (scores <= most))
        best = within[first(left[within], scores[within], ids, k)]
        out.append((left[best], scores[best]))
    return out


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and highest n with ``low * score <= 100 * n <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _check_range(anchors: np.ndarray, rows: np.ndarray) -> None:
    if float(np.abs(anchors.astype(float)).max(axis=0) @ np.abs(rows.astype(float)).max(axis=0)) >= 2.0 ** 62:
        raise OverflowError("scores do not fit a long")


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30,
                   high: int = 90, times: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor row.

    Components are multiplied by ``times`` and rounded down, scores are inner products with the anchor; higher ones come
    first, ties by smaller id. Positives are the first ``positives`` other rows of the anchor's label. For each, the first
    ``negatives`` rows of other labels are listed whose score is ``low`` to ``high`` percent of the positive's; fewer if
    there are fewer. A negative positive score has no such window.

    Rows with a NULL id or label, or whose vector is NULL, empty or holds NULL or non-finite components, take no part.
    Vectors meet those of their own length only. Repeated rows are rows of their own: each is an anchor, and the others
    of its kind are its candidates. Scores beyond a long are an error. Other columns are not read; an empty table gives no
    rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_v"),
                          F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("_v")))
    rows = rows.select("id", "label", scaled(F.col("_v"), times).alias("v"), "anchor", F.monotonically_increasing_id().alias("row"))
    # a row's own number is one that stays, because the numbered rows are written
    rows, seen = materialize_measured(rows, anchors=F.count_if("anchor"), width=F.max(F.size("v")))
    block_rows = max(1, BLOCK_BYTES // (8 * (seen["width"] or 1)))
    grid = max(1, -(-(seen["anchors"] or 0) // ANCHOR_BLOCK)), max(1, -(-seen["rows"] // block_rows))

    def cells(df: DataFrame, own: int) -> DataFrame:
        """Rows of side ``own`` of the grid, one copy for each block of the other side."""
        place = [F.pmod(F.xxhash64("row"), F.lit(grid[own])).cast("int"),
                 F.explode(F.sequence(F.lit(0), F.lit(grid[1 - own] - 1)))]
        return df.withColumn("width", F.size("v")).withColumn("a", place[own]).withColumn("d", place[1 - own]).groupBy("width", "a", "d")

    anchors, data = rows.filter("anchor").drop("anchor"), rows.drop("anchor")

    def near(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names, found = ["anchor", "positive", "score"], []
        if len(asked) and len(block):
            own, ids, labels, numbers = np.stack(asked["v"]), block["id"].to_numpy(), block["label"].to_numpy(), block["row"].to_numpy()
            columns = Columns(np.stack(block["v"]))
            _check_range(own, columns.values.T)
            for i, (row, label) in enumerate(zip(asked["row"], asked["label"])):
                at, scores = highest(columns, own[i], (labels == label) & (numbers != row), ids, positives)
                found.append(pd.DataFrame({"anchor": row, "positive": ids[at], "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({n: np.zeros(0, np.int64) for n in names})

    best = W.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    paired = cells(anchors, 0).cogroup(cells(data, 1)).applyInPandas(near, "anchor long, positive long, score long")
    paired = paired.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= positives)
    listed = paired.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "positive", "score"))).alias("best"))
    asked = materialize(anchors.join(listed.withColumnRenamed("anchor", "row"), "row").select(
        "row", "id", "label", "v", F.col("best.positive").alias("positive"), F.col("best.score").alias("score")))

    def far(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor", "anchor_id", "n", "positive_id", "negative_id", "positive_score", "negative_score"]
        found = []
        if len(asked) and len(block):
            own, ids, labels = np.stack(asked["v"]), block["id"].to_numpy(), block["label"].to_numpy()
            columns = Columns(np.stack(block["v"]))
            _check_range(own, columns.values.T)
            for i, x in enumerate(asked.itertuples()):
                windows = [window_of(int(s), low, high) for s in x.score]
                for n, (at, scores) in enumerate(in_windows(columns, own[i], labels != x.label, ids, negatives, windows)):
                    found.append(pd.DataFrame({"anchor": x.row, "anchor_id": x.id, "n": n, "positive_id": x.positive[n],
                                               "negative_id": ids[at], "positive_score": x.score[n], "negative_score": scores}))
        return pd.concat(found) if found else pd.DataFrame({n: np.zeros(0, np.int64) for n in names})

    kinds = "anchor long, anchor_id long, n long, positive_id long, negative_id long, positive_score long, negative_score long"
    mined = cells(asked, 0).cogroup(cells(data, 1)).applyInPandas(far, kinds)
    best = W.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "negative_id")
    ranked = mined.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
