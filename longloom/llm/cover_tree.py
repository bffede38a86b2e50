"""Exact search for the highest inner products by cover trees over queries and data together.

Both sides are cut into blocks of bounded size, and every block of queries meets every block of data in one cell of a
grid. In a cell both sides become cover trees: a node is a ball around one of its own points, its children are balls of
half the size around points further apart than that, the first around the node's own center. Pairs of nodes are looked at
together, those with the highest bound first. No inner product between two balls exceeds

    <a, b> + r_a |b| + r_b |a| + r_a r_b

for centers a, b and covering radii r_a, r_b; a pair whose bound is below the worst kth score in the query node is left out
with all that is below it. Leaves are compared by one matrix product. A ball that would need more than ``FAN`` smaller ones
stays a leaf, which in many dimensions is the end of what pruning can do. A cell gives k rows per query at most, and the
best over the cells are the result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize_measured

QUERY_BLOCK = 4096
DATA_BLOCK = 8192
LEAF = 64
FAN = 64
_EXACT = 2.0 ** 52


@dataclass
class Node:
    center: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray | None = None  # of a leaf
    children: list[Node] = field(default_factory=list)
    worst: float = -np.inf  # of the kth scores below a query node


def build(points: np.ndarray, rows: np.ndarray | None = None, center: int | None = None, scale: float | None = None) -> Node:
    """The cover tree of the given rows; ``scale`` is a radius that is known to cover them."""
    rows = np.arange(len(points)) if rows is None else rows
    center = rows[0] if center is None else center
    own = points[rows]
    far = np.sqrt(((own - points[center]) ** 2).sum(axis=1))
    radius = float(far.max())
    node = Node(points[center], float(np.sqrt((points[center] ** 2).sum())), radius * (1 + 1e-9))
    scale = radius if scale is None else min(scale, radius)
    if len(rows) <= LEAF or radius == 0.0:
        node.rows = rows
        return node
    cover, parts = scale / 2, []
    left, distance, at = np.arange(len(rows)), far, center
    while len(left):
        if len(parts) == FAN:
            node.rows = rows
            return node
        near = distance <= cover
        parts.append((at, left[near]))
        left = left[~near]
        if len(left):  # the next center is further than the cover from all before
            at = rows[left[0]]
            distance = np.sqrt(((own[left] - points[at]) ** 2).sum(axis=1))
    node.children = [build(points, rows[p], c, cover) for c, p in parts]
    return node


def bound(a: Node, b: Node) -> float:
    high = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return high + abs(high) * 1e-9 + 1e-6


class Best:
    """The k best scores of each query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, kind: type):
        self.k, self.pairs, self.skipped = k, 0, 0
        self.scores = np.full((n, k), -np.inf, dtype=kind)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries ``rows`` against data rows with ``ids``, ascending."""
        k = min(self.k, scores.shape[1])
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        mask = (scores >= np.maximum(least, self.scores[rows, -1])[:, None]) & (scores > -np.inf)
        r, c = np.nonzero(mask)
        changed = np.unique(r)
        if not len(changed):
            return
        which = np.concatenate([r, np.repeat(changed, self.k)])
        value = np.concatenate([scores[r, c], self.scores[rows[changed]].ravel()])
        name = np.concatenate([ids[c], self.ids[rows[changed]].ravel()])
        order = np.lexsort((name, -value, which))
        which = which[order]
        first = np.searchsorted(which, changed)
        take = order[(first[:, None] + np.arange(self.k)).ravel()].reshape(len(changed), self.k)
        self.scores[rows[changed]], self.ids[rows[changed]] = value[take], name[take]


def search(queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, data_rows: np.ndarray, data_ids: np.ndarray,
           k: int) -> Best:
    """The k highest inner products of each query with other rows, as whole numbers; a row is known by its number.

    ``pairs`` of the result counts the node pairs looked at, and ``skipped`` those left out with all below them.
    """
    size = np.sqrt((queries.astype(float) ** 2).sum(axis=1).max() * (data.astype(float) ** 2).sum(axis=1).max())
    kind = np.float64 if size < _EXACT else np.longdouble  # 53 or 64 bits of whole numbers
    if size >= 2.0 ** 63:
        raise OverflowError("scores do not fit a long")
    order = np.argsort(data_ids, kind="stable")
    data, data_ids, data_rows = data[order].astype(kind), data_ids[order], data_rows[order]
    queries = queries.astype(kind)
    best = Best(len(queries), k, kind)
    top, below = build(queries.astype(float)), build(data.astype(float))
    heap, count = [(-bound(top, below), 0, top, below)], 1
    while heap:
        high, _, q, d = heapq.heappop(heap)
        best.pairs += 1
        if -high < q.worst:
            best.skipped += 1
            continue
        if q.rows is not None and d.rows is not None:
            rows = np.sort(d.rows)
            scores = queries[q.rows] @ data[rows].T
            scores[query_rows[q.rows][:, None] == data_rows[rows][None, :]] = -np.inf
            best.offer(q.rows, scores, data_ids[rows])
            q.worst = float(best.scores[q.rows, -1].min())
            continue
        # the larger ball is opened, or the one that can be
        open_q = q.rows is None and (d.rows is not None or q.radius * d.norm > d.radius * q.norm)
        if q.rows is None:
            q.worst = min(c.worst for c in q.children)
        for a in q.children if open_q else [q]:
            for b in [d] if open_q else d.children:
                if (high := bound(a, b)) >= a.worst:
                    heapq.heappush(heap, (-high, count, a, b))
                    count += 1
                else:
                    best.pairs, best.skipped = best.pairs + 1, best.skipped + 1
    return best


def scaled(vector: Column, times: int = 1024) -> Column:
    """Each component times a number, rounded down."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(times)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, and all components finite numbers."""
    inf = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query row with all rows but itself.

    Components are multiplied by 1024 and rounded down, scores are whole numbers, ties go to the smaller id. With fewer
    other rows all of them are listed.

    Vectors that are NULL, empty or hold NULL or non-finite components take no part, nor do rows without an id. Vectors
    meet those of their own length only. Repeated rows are rows of their own: each is a query with a list, in which the
    others are candidates. Scores beyond a long are an error. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("_v"), is_query.alias("_q"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("_v")))
    # a row's number is one that stays, because the numbered rows are written
    rows, seen = materialize_measured(rows.select("id", scaled(F.col("_v")).alias("v"), F.coalesce("_q", F.lit(False)).alias("q"),
                                                  F.monotonically_increasing_id().alias("row")), queries=F.count_if("q"))
    data_blocks, query_blocks = max(1, -(-seen["rows"] // DATA_BLOCK)), max(1, -(-(seen["queries"] or 0) // QUERY_BLOCK))
    queries = rows.filter("q")

    def cells(df: DataFrame, own: str, n: int, other: str, others: int) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.select("id", "row", "v", F.size("v").alias("width"), block, every)

    data = cells(rows, "d", data_blocks, "q", query_blocks)
    asked = cells(queries, "q", query_blocks, "d", data_blocks)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "query", "vec_id", "score"]
        if not len(a) or not len(b):
            return pd.DataFrame({n: np.zeros(0, np.int64) for n in names})
        ids, own = a["id"].to_numpy(), a["row"].to_numpy()
        best = search(np.stack(a["v"]), own, np.stack(b["v"]), b["row"].to_numpy(), b["id"].to_numpy(), k)
        found = best.scores > -np.inf
        at = np.nonzero(found)[0]
        return pd.DataFrame({"query_id": ids[at], "query": own[at], "vec_id": best.ids[found],
                             "score": best.scores[found].astype(np.int64)})

    key = ["width", "q", "d"]
    found = asked.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(
        compare, "query_id long, query long, vec_id long, score long")
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
