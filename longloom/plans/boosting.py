"""Second-order boosted trees for two classes, grown from histograms of a binned matrix.

Values are replaced by bins of equal numbers of rows once; a stored row is one byte for each column. Every level of a tree
is one pass over these rows: each adds its gradient and hessian to the cells (node, column, bin), cells are added up inside
tasks and then by Spark, and of the sums, at most nodes x columns x bins of them however many rows there are, the best split
of each node comes back. A node whose rows take at most ``NODE_BYTES`` is not passed over level by level: its rows meet in one
task that grows all that is below it, by the same rule. Nothing but the trees themselves is kept by the driver. Every
``KEEP_TREES`` trees the rows are stored with their margins, to which a task adds the trees since then, so that a lost executor
costs no more than its tasks and a tree no more than the ones before it.

The objective is the logistic loss. With G and H the sums of gradients and hessians and T(G) = sign(G) max(|G| - alpha, 0),
a node is worth T(G)^2 / (H + lam), a split gains what its sides are worth more than the node, and a leaf's weight is
-T(G) / (H + lam). Rows without a value go to the side that gains more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import known_id, uniform
from ..functions.numeric import clean_features
from ..operators import metrics
from ..operators.numbering import ordered_index
from ..operators.split import stratified_folds
from ..session import materialize, materialize_measured

BINS = 64
MOST_BINS = 255  # a bin is a byte, 0 a missing value
CELLS = 4_000_000  # of a task's histogram at a time
NODE_BYTES = 16 << 20
KEEP_TREES = 20
FEW_ROWS = 1000  # up to which one sum over all columns beats a sum for each
LEAST_GAIN = 1e-6
_TREE = ("tree int, node int, feature int, bin int, threshold double, missing_left boolean, left int, right int, "
         "weight double, gain double")


# ---------------------------------------------------------------- bins

def quantile_cuts(m: DataFrame, bins: int = BINS, features: str = "features") -> DataFrame:
    """``idx, cuts``: for each column the values at ranks ``ceil(q n / bins)``, without repeats and the lowest value.

    Values are ranked by range partitions of all cells, so that the ranks are exact for any number of rows. NULL and NaN
    are no values; a column without any has no row.
    """
    cells = m.select(F.posexplode(features).alias("idx", "x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    numbered = ordered_index(cells, "idx", "x", out="number")
    columns = numbered.groupBy("idx").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"), F.min("x").alias("low"))
    # one row per column
    ranked = numbered.join(F.broadcast(columns), "idx").withColumn("rank", F.col("number") - F.col("first") + 1)
    quantile = f"(rank - 1) * {bins} div n + 1"
    cut = ranked.filter(F.expr(f"{quantile} <= rank * {bins} div n AND {quantile} < {bins} AND x > low"))
    return cut.groupBy("idx").agg(F.array_sort(F.collect_set("x")).alias("cuts"))


def collect_cuts(cuts: DataFrame, width: int) -> list[np.ndarray]:
    """The cuts of each column, at most ``MOST_BINS`` numbers for each."""
    found = {r["idx"]: np.array(r["cuts"], dtype=float) for r in cuts.collect()}
    return [found.get(i, np.zeros(0)) for i in range(width)]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    values = column.flatten()
    if len(values) != width * len(column):
        raise ValueError(f"every row needs {width} features")
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), width)


def binned(m: DataFrame, cuts: list[np.ndarray], features: str = "features", keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """Rows with ``bins``, a byte for each column: 0 for a missing value, else 1 and the number of cuts up to the value."""
    width = len(cuts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(keep)), width)
            out = np.empty(x.shape, np.uint8)
            for i in range(width):
                out[:, i] = np.searchsorted(cuts[i], x[:, i], side="right") + 1
            out[np.isnan(x)] = 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in out], pa.binary())],
                                             names=[*keep, "bins"])

    schema = T.StructType([*[m.schema[c] for c in keep], T.StructField("bins", T.BinaryType())])
    return m.select(*keep, F.col(features).cast("array<double>")).mapInArrow(each, schema)


# ---------------------------------------------------------------- trees

@dataclass
class Tree:
    """Nodes by number, 0 the root. A node with ``feature`` -1 is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    weight: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, threshold: float, missing_left: bool, gain: float) -> tuple[int, int]:
        ends = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.threshold[node] = feature, bin, threshold
        self.missing_left[node], self.gain[node] = missing_left, gain
        self.left[node], self.right[node] = ends
        for own, empty in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.missing_left, False), (self.left, -1),
                           (self.right, -1), (self.weight, 0.0), (self.gain, 0.0)):
            own += [empty, empty]
        return ends

    def prune(self, gamma: float, node: int = 0) -> bool:
        """Take back splits that gain less than ``gamma``, from the leaves up; whether the node is a leaf then."""
        if self.feature[node] < 0:
            return True
        ends = [self.prune(gamma, self.left[node]), self.prune(gamma, self.right[node])]
        if all(ends) and self.gain[node] < gamma:
            self.feature[node] = -1
        return self.feature[node] < 0

    def leaves(self, is_left, rows: int) -> np.ndarray:
        """The leaf of each row; ``is_left(row numbers, their nodes)`` tells which go left."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        node, moving = np.zeros(rows, np.int64), np.arange(rows)
        while True:
            moving = moving[feature[node[moving]] >= 0]
            if not len(moving):
                return node
            at = node[moving]
            node[moving] = np.where(is_left(moving, at), left[at], right[at])

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, missing = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)

        def is_left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            own = bins[rows, feature[nodes]]
            return np.where(own == 0, missing[nodes], own <= cut[nodes])

        return self.leaves(is_left, len(bins))

    def of_values(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, missing = np.array(self.feature), np.array(self.threshold), np.array(self.missing_left)

        def is_left(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            own = x[rows, feature[nodes]]
            return np.where(np.isnan(own), missing[nodes], own < threshold[nodes])

        return self.leaves(is_left, len(x))


def margins(trees: list[Tree], leaves) -> np.ndarray | float:
    return sum((np.array(t.weight)[leaves(t)] for t in trees), 0.0)


def chance(margin: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-margin))


# ---------------------------------------------------------------- growing

@dataclass(frozen=True)
class Boosting:
    """The usual names; ``alpha`` and ``lam`` are the L1 and L2 penalties, ``gamma`` the least gain of a split that stays.

    ``colsample`` is the share of columns that a tree may use and ``subsample`` the share of rows that it learns from, drawn
    by hashes of column numbers and row ids. ``min_child_weight`` is the least hessian of either side.
    """

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 10
    subsample: float = 0.8
    colsample: float = 0.8
    gamma: float = 0.1
    min_child_weight: float = 1.0
    alpha: float = 6.0
    lam: float = 1.0
    bins: int = BINS
    seed: int = 123

    def columns(self, tree: int, width: int) -> np.ndarray:
        """The columns of a tree: the first by hash."""
        if self.colsample >= 1:
            return np.arange(width)
        salt = f"{self.seed}:columns:{tree}"
        order = sorted(range(width), key=lambda i: (hashlib.md5(f"{i}:{salt}".encode()).hexdigest()[:8], i))
        return np.sort(order[:max(1, int(self.colsample * width))])

    def rows(self, df: DataFrame, tree: int) -> DataFrame:
        """The rows that a tree learns from."""
        return df if self.subsample >= 1 else df.filter(uniform(known_id("id"), f"{self.seed}:rows:{tree}") < F.lit(float(self.subsample)))

    def shrunk(self, g: float) -> float:
        return (abs(g) - self.alpha) * (1 if g > 0 else -1) if abs(g) > self.alpha else 0.0

    def weight(self, g: float, h: float) -> float:
        return -self.learning_rate * self.shrunk(g) / (h + self.lam)

    def worth(self, g: Column, h: Column) -> Column:
        over = F.greatest(F.abs(g) - F.lit(float(self.alpha)), F.lit(0.0))
        return over * over / (h + F.lit(float(self.lam)))


def _bytes(column: pa.BinaryArray) -> np.ndarray:
    """The rows of a column whose values all have one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _added(margin: np.ndarray, trees: list[Tree], bins: np.ndarray) -> np.ndarray:
    """Margins with those of more trees, added one by one."""
    for t in trees:
        margin = margin + np.array(t.weight)[t.of_bins(bins)]
    return margin


def _active(batch: pa.RecordBatch, trees: list[Tree], grown: Tree, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bins, node places, gradients and hessians of the rows whose node has a place."""
    own = _bytes(batch.column(0))
    at = place[grown.of_bins(own)]
    own, at, label, margin = own[at >= 0], at[at >= 0], batch.column(1).to_numpy()[at >= 0], batch.column(2).to_numpy()[at >= 0]
    p = chance(_added(margin, trees, own))
    return own, at, p - label, p * (1 - p)


def with_margins(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """Binned rows whose ``margin`` has these trees, too, stored."""
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margin = _added(batch.column("margin").to_numpy(), trees, _bytes(batch.column("bins")))
                yield batch.set_column(names.index("margin"), "margin", pa.array(margin))

    return materialize(rows.mapInArrow(each, rows.schema))


def histograms(rows: DataFrame, trees: list[Tree], grown: Tree, nodes: list[int], columns: np.ndarray, bins: int) -> DataFrame:
    """``node, feature, bin, g, h, n``: sums of gradients and hessians and number of rows in nodes of the growing tree."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(grown.feature), -1)
        place[nodes] = np.arange(len(nodes))
        for batch in batches:
            if not batch.num_rows:
                continue
            own, at, g, h = _active(batch, trees, grown, place)
            step = max(1, CELLS // max(len(nodes) * (bins + 1), len(own), 1))
            for i in range(0, len(columns), step):
                some = columns[i:i + step]
                cell = (at[:, None] * len(some) + np.arange(len(some))) * (bins + 1) + own[:, some]
                sums = [np.bincount(cell.ravel(), np.repeat(s, len(some)), len(nodes) * len(some) * (bins + 1)) for s in (g, h, np.ones(len(own)))]
                full = np.flatnonzero(sums[2])
                node, rest = np.divmod(full, len(some) * (bins + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(nodes)[node].astype(np.int32)), pa.array(some[rest // (bins + 1)].astype(np.int32)),
                     pa.array((rest % (bins + 1)).astype(np.int32)), *[pa.array(s[full]) for s in sums]],
                    names=["node", "feature", "bin", "g", "h", "n"])

    parts = rows.select("bins", F.col("label").cast("double"), "margin").mapInArrow(each, "node int, feature int, bin int, g double, h double, n double")
    # one exchange serves the sums of cells and the running sums over a column's bins
    return parts.repartition("node", "feature").groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def best_splits(cells: DataFrame, own: Boosting) -> DataFrame:
    """``node, g, h, n`` and its best split: ``gain, feature, bin, missing_left, g_left, h_left, n_left``; no gain without any.

    Rows in bins up to ``bin`` go left. Of equal gains the lower column counts, then the lower bin, then missing values to
    the right.
    """
    column, names = W.partitionBy("node", "feature"), ("g", "h", "n")
    upto = column.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    missing = F.col("bin") == 0
    sums = cells.select(
        "node", "feature", "bin", *[F.sum(c).over(column).alias(c) for c in names],
        *[F.sum(F.when(~missing, F.col(c)).otherwise(0.0)).over(upto).alias(f"{c}_upto") for c in names],
        *[F.sum(F.when(missing, F.col(c)).otherwise(0.0)).over(column).alias(f"{c}_missing") for c in names])

    def side(to_left: bool) -> Column:
        left = [F.col(f"{c}_upto") + F.col(f"{c}_missing") if to_left else F.col(f"{c}_upto") for c in names]
        right = [F.col(c) - x for c, x in zip(names, left)]
        gain = own.worth(*left[:2]) + own.worth(*right[:2]) - own.worth(F.col("g"), F.col("h"))
        may = ((F.col("bin") > 0) & (left[1] >= own.min_child_weight) & (right[1] >= own.min_child_weight) & (left[2] > 0)
               & (right[2] > 0) & (gain > LEAST_GAIN))
        return F.struct(F.when(may, gain).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"),
                        F.lit(not to_left).alias("right"), *[x.alias(f"{c}_left") for c, x in zip(names, left)])

    either = sums.select("node", "g", "h", "n", F.greatest(side(False), side(True)).alias("s"))
    best = either.groupBy("node").agg(F.min(F.struct("g", "h", "n")).alias("all"), F.max("s").alias("s"))
    return best.select("node", "all.g", "all.h", "all.n", "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"),
                       (~F.col("s.right")).alias("missing_left"), "s.g_left", "s.h_left", "s.n_left")


def _sums(own: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> list[np.ndarray]:
    """Gradients, hessians and rows by column and bin, added up in the order of the rows."""
    n = own.shape[1]
    if len(own) <= FEW_ROWS:
        cell = (np.arange(n) * (bins + 1) + own).ravel()
        return [np.bincount(cell, np.repeat(s, n), n * (bins + 1)).reshape(n, bins + 1) for s in (g, h, np.ones(len(own)))]
    sums = [np.empty((n, bins + 1)) for _ in range(3)]
    for i in range(n):
        cell = own[:, i].astype(np.intp)
        for s, weights in zip(sums, (g, h, None)):
            s[i] = np.bincount(cell, weights, bins + 1)
    return sums


def best_split(own: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, boosting: Boosting) -> tuple[float, int, int, bool] | None:
    """The gain, column, bin and side of missing values of one node's best split, if it has any; ``best_splits`` of its rows."""
    most = max(g[g > 0].sum(), -g[g < 0].sum())  # no side has a larger sum of gradients
    if most < boosting.alpha * (1 - 1e-9) or h.sum() < 2 * boosting.min_child_weight * (1 - 1e-9):
        return None
    width = own.shape[1]
    best, step = None, max(1, CELLS // max(bins + 1, len(own)))
    for i in range(0, width, step):
        sums = _sums(own[:, i:i + step], g, h, bins)
        left = [np.cumsum(s[:, 1:], axis=1)[:, :, None] + s[:, :1, None] * np.array([0.0, 1.0]) for s in sums]
        right = [s.sum(axis=1)[:, None, None] - x for s, x in zip(sums, left)]

        def worth(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.maximum(np.abs(a) - boosting.alpha, 0.0) ** 2 / (b + boosting.lam)

        gain = worth(*left[:2]) + worth(*right[:2]) - worth(*[s.sum(axis=1)[:, None, None] for s in sums[:2]])
        may = ((left[1] >= boosting.min_child_weight) & (right[1] >= boosting.min_child_weight) & (left[2] > 0) & (right[2] > 0)
               & (gain > LEAST_GAIN) & (sums[2][:, 1:, None] > 0))
        gain = np.where(may, gain, -np.inf)
        at = int(gain.argmax())
        if gain.flat[at] > (best[0] if best else -np.inf):
            feature, bin, side = np.unravel_index(at, gain.shape)
            best = float(gain.flat[at]), i + int(feature), int(bin) + 1, bool(side)
    return best


def _order(own: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order of rows by their bytes, gradients and hessians: bytes are compared eight at a time."""
    words = np.zeros((len(own), -(-own.shape[1] // 8) * 8), np.uint8)
    words[:, :own.shape[1]] = own
    return np.lexsort((h, g, *words.view(">u8").astype(np.uint64).T[::-1]))


def finished(rows: DataFrame, trees: list[Tree], grown: Tree, nodes: dict[int, int], columns: np.ndarray, bins: int, own: Boosting) -> DataFrame:
    """What grows below nodes of few rows, by node and the levels it may have: ``node, at, feature, bin, missing_left, left,
    right, gain, g, h``, ``at`` and the children counting from the node itself."""
    order = list(nodes)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(grown.feature), -1)
        place[order] = np.arange(len(order))
        for batch in batches:
            if batch.num_rows:
                bytes_, at, g, h = _active(batch, trees, grown, place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(order, np.int32)[at]), pa.array([r.tobytes() for r in bytes_[:, columns]], pa.binary()), pa.array(g), pa.array(h)],
                    names=["node", "bins", "g", "h"])

    def below(group: pd.DataFrame) -> pd.DataFrame:
        all_bins, g, h = np.frombuffer(b"".join(group["bins"]), np.uint8).reshape(len(group), len(columns)), group["g"].to_numpy(), group["h"].to_numpy()
        order = _order(all_bins, g, h)  # sums don't depend on the order of arrival
        all_bins, g, h = all_bins[order], g[order], h[order]
        node, out, work = int(group["node"].iloc[0]), [], [(0, np.arange(len(group)), 0)]
        count = 1
        while work:
            at, mine, depth = work.pop(0)
            split = best_split(all_bins[mine], g[mine], h[mine], bins, own) if depth < nodes[node] else None
            line = [node, at, -1, 0, False, -1, -1, None, g[mine].sum(), h[mine].sum()]
            if split:
                gain, feature, bin, missing_left = split
                values = all_bins[mine, feature]
                left = np.where(values == 0, missing_left, values <= bin)
                line[2:8] = int(columns[feature]), bin, missing_left, count, count + 1, gain
                work += [(count, mine[left], depth + 1), (count + 1, mine[~left], depth + 1)]
                count += 2
            out.append(line)
        return pd.DataFrame(out, columns=["node", "at", "feature", "bin", "missing_left", "left", "right", "gain", "g", "h"])

    parts = rows.select("bins", F.col("label").cast("double"), "margin").mapInArrow(placed, "node int, bins binary, g double, h double")
    return parts.groupBy("node").applyInPandas(
        below, "node int, at int, feature int, bin int, missing_left boolean, left int, right int, gain double, g double, h double")


def grow(rows: DataFrame, n_rows: int, trees: list[Tree], number: int, cuts: list[np.ndarray], own: Boosting) -> Tree:
    """The next tree: a job for each level that has large nodes, and one for all small nodes. ``trees`` are those that the rows'
    margins lack."""
    tree, sums, sizes, open_nodes, small = Tree(), {}, {0: n_rows}, [0], {}
    columns, sample, bins = own.columns(number, len(cuts)), own.rows(rows, number), max(map(len, cuts), default=0) + 1
    few = NODE_BYTES // max(1, len(columns))

    def split(node: int, feature: int, bin: int, missing_left: bool, gain: float) -> tuple[int, int]:
        ends = [*cuts[feature].tolist(), float("inf")]  # behind the last bin there are missing values only
        return tree.split(node, feature, bin, ends[bin - 1], missing_left, gain)

    for depth in range(own.max_depth):
        small.update({n: own.max_depth - depth for n in open_nodes if sizes[n] <= few})
        open_nodes = [n for n in open_nodes if sizes[n] > few]
        if not open_nodes:
            break
        found = best_splits(histograms(sample, trees, tree, open_nodes, columns, bins), own).collect()  # a row for each open node
        open_nodes = []
        for s in sorted(found, key=lambda s: s["node"]):
            sums[s["node"]] = s["g"], s["h"]
            if s["gain"] is not None:
                left, right = split(s["node"], s["feature"], s["bin"], s["missing_left"], s["gain"])
                sums[left], sums[right] = (s["g_left"], s["h_left"]), (s["g"] - s["g_left"], s["h"] - s["h_left"])
                sizes[left], sizes[right] = s["n_left"], s["n"] - s["n_left"]
                open_nodes += [left, right]
    if small:
        lines = finished(sample, trees, tree, small, columns, bins, own).collect()  # as many rows as the tree gets nodes
        names = {}
        for s in sorted(lines, key=lambda s: (s["node"], s["at"])):
            own_node = names.setdefault((s["node"], s["at"]), s["node"])
            sums[own_node] = s["g"], s["h"]
            if s["feature"] >= 0:
                names[s["node"], s["left"]], names[s["node"], s["right"]] = split(own_node, s["feature"], s["bin"], s["missing_left"], s["gain"])
    tree.prune(own.gamma)
    for node, (g, h) in sums.items():
        tree.weight[node] = own.weight(g, h)
    return tree


@dataclass
class Boosted:
    """A fitted model."""

    trees: list[Tree]
    width: int

    def score(self, m: DataFrame, features: str = "features") -> DataFrame:
        """The rows without their features, with ``prediction`` and ``probability``, one number per class."""
        trees, width = self.trees, self.width
        keep = [c for c in m.columns if c != features]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(len(keep)), width)
                p = chance(margins(trees, lambda t: t.of_values(x)) + np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array((p > 0.5).astype(np.int32)), pa.array(np.stack([1 - p, p], axis=1).tolist(), pa.list_(pa.float64()))],
                    names=[*keep, "prediction", "probability"])

        schema = T.StructType([*[m.schema[c] for c in keep], T.StructField("prediction", T.IntegerType()),
                               T.StructField("probability", T.ArrayType(T.DoubleType()))])
        return m.select(*keep, F.col(features).cast("array<double>")).mapInArrow(each, schema)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The nodes of all trees as rows."""
        return spark.createDataFrame([
            (t, i, tree.feature[i], tree.bin[i], tree.threshold[i], tree.missing_left[i], tree.left[i], tree.right[i], tree.weight[i], tree.gain[i])
            for t, tree in enumerate(self.trees) for i in range(len(tree.feature))], _TREE)

    def importance(self, spark: SparkSession) -> DataFrame:
        """``feature, splits, gain``: how often a column splits a node, and what that gained on average."""
        reached, work = [], [(t, 0) for t in range(len(self.trees))]
        while work:  # pruned nodes still have rows
            t, i = work.pop()
            tree = self.trees[t]
            if tree.feature[i] >= 0:
                reached.append((tree.feature[i], tree.gain[i]))
                work += [(t, tree.left[i]), (t, tree.right[i])]
        return spark.createDataFrame(reached, "feature int, gain double").groupBy("feature").agg(
            F.count(F.lit(1)).alias("splits"), F.avg("gain").alias("gain"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.nodes(spark).withColumn("width", F.lit(self.width)).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Boosted:
    rows, trees, width = spark.read.parquet(path).orderBy("tree", "node").collect(), [], 0
    for r in rows:
        if r["node"] == 0:
            trees.append(Tree(*[[] for _ in range(8)]))
        tree, width = trees[-1], r["width"]
        for name in ("feature", "bin", "threshold", "missing_left", "left", "right", "weight", "gain"):
            getattr(tree, name).append(r[name])
    return Boosted(trees, width)


def prepared(m: DataFrame, bins: int = BINS) -> tuple[DataFrame, int, list[np.ndarray]]:
    """The stored binned rows, their number and the cuts of every column."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"2 to {MOST_BINS} bins, not {bins}")
    m = clean_features(m.filter("label IS NOT NULL"))
    width = m.agg(F.max(F.size("features"))).first()[0] or 0
    cuts = collect_cuts(quantile_cuts(m, bins), width)
    rows, seen = materialize_measured(binned(m, cuts))
    return rows, seen["rows"], cuts


def boost(rows: DataFrame, n_rows: int, cuts: list[np.ndarray], own: Boosting) -> Boosted:
    """A model from binned rows, of which there are ``n_rows``."""
    trees: list[Tree] = []
    rows, known = rows.withColumn("margin", F.lit(0.0)), 0
    for number in range(int(own.n_estimators)):
        if number - known >= KEEP_TREES:
            rows, known = with_margins(rows, trees[known:]), number
        trees.append(grow(rows, n_rows, trees[known:], number, cuts, own))
    return Boosted(trees, len(cuts))


def fit(train: DataFrame, own: Boosting = Boosting()) -> Boosted:
    """A model from ``(id, label, features)`` rows with labels 0 and 1.

    Features may be missing (NULL or NaN); rows without a label are not learnt from, a NULL id is an error if rows are
    sampled. Without rows the model says one half for every row, which is class 0.
    """
    return boost(*prepared(train, own.bins), own)


# ---------------------------------------------------------------- search

# The search grid.
GRID = {"max_depth": [3, 10], "min_child_weight": [1, 6], "gamma": [0.0, 0.2, 0.4], "alpha": [6, 8, 10, 12],
        "n_estimators": [100, 1000]}


@dataclass
class Searched:
    """Every tried setting with its mean score, and the first of the best."""

    tried: list[tuple[dict, float]]

    @property
    def best(self) -> dict:
        return max(enumerate(self.tried), key=lambda x: (x[1][1], -x[0]))[1][0]


def grid_search(train: DataFrame, grid: dict[str, list] | None = None, folds: int = 5, base: Boosting = Boosting(),
                parallelism: int = 4) -> Searched:
    """Stratified cross-validation by weighted F1.

    Rows are binned once for all fits. Settings that differ in ``n_estimators`` only are one fit, since the trees of the
    shorter model are the first of the longer one. A row's fold decides, not its order.
    """
    grid = grid or GRID
    rows, n_rows, cuts = prepared(train, base.bins)
    rows = materialize(stratified_folds(rows, folds))
    counts = sorted(grid.get("n_estimators", [base.n_estimators]))
    others = [dict(zip([n for n in grid if n != "n_estimators"], x)) for x in product(*[v for n, v in grid.items() if n != "n_estimators"])]

    def tried(job: tuple[dict, int]) -> list[float]:
        setting, fold = job
        model = boost(rows.filter(F.col("fold") != fold), n_rows, cuts, Boosting(**{**vars(base), **setting, "n_estimators": int(counts[-1])}))
        held = rows.filter(F.col("fold") == fold)
        return [metrics.f1_weighted(_said(held, model.trees[:int(n)])).first()["f1_weighted"] or 0.0 for n in counts]

    jobs = [(s, f) for s in others for f in range(folds)]
    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(train.sparkSession)(tried), jobs, chunksize=1)
    scores = {(i // folds, k): [] for i in range(len(jobs)) for k in range(len(counts))}
    for i, one in enumerate(found):
        for k, f1 in enumerate(one):
            scores[i // folds, k].append(f1)
    return Searched([({**others[i], "n_estimators": counts[k]}, sum(v) / len(v)) for (i, k), v in sorted(scores.items())])


def _said(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """``label, prediction`` of binned rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.stack([np.frombuffer(b.as_buffer(), np.uint8) for b in batch.column(1)])
                said = margins(trees, lambda t: t.of_bins(own)) + np.zeros(len(own)) > 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said.astype(np.int32))], names=["label", "prediction"])

    return rows.select(F.col("label").cast("int").alias("label"), "bins").mapInArrow(each, "label int, prediction int")
