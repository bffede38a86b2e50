"""A wide and a deep part trained together: a linear model over buckets of the features, and a feed-forward net over the features.

All training is one barrier stage. Each of its tasks holds a share of the rows and takes mini-batches from it; every
``between`` steps the tasks send each other their parameters and go on from the average, weighted by rows. (A message round of
a barrier stage takes about a second whatever its size, so that gradients of every step cannot be exchanged.) What passes
between tasks is as large as the model, never the data, and a lost task starts the stage again with the same random numbers.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import known_id
from ..functions.numeric import clean_features
from ..session import materialize
from .boosting import _matrix, binned, collect_cuts, quantile_cuts

HIDDEN = (100, 70, 50, 25)
BUCKETS = 10


@dataclass
class Shape:
    """``features`` numbers go into the net, ``buckets`` columns of ``BUCKETS`` and one for missing values into the linear part."""

    features: int
    classes: int
    hidden: tuple[int, ...]
    wide: bool
    deep: bool
    bucket_cells: int

    def sizes(self) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [(self.classes,)]
        if self.wide:
            out.append((self.features * self.bucket_cells, self.classes))
        if self.deep:
            layers = [self.features, *self.hidden, self.classes]
            out += [s for a, b in zip(layers, layers[1:]) for s in ((a, b), (b,))]
        return out

    def start(self, seed: int) -> list[np.ndarray]:
        rng = np.random.default_rng(seed)
        out = [np.zeros(s) for s in self.sizes()]
        for i in range(2 if self.wide else 1, len(out), 2):
            out[i] = rng.normal(0, (2 / max(1, out[i].shape[0])) ** 0.5, out[i].shape)
        return out

    def logits(self, own: list[np.ndarray], x: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Class scores and the values of the net's layers."""
        out, layers = np.tile(own[0], (len(x), 1)), []
        if self.wide:
            out = out + own[1][cells].sum(axis=1)
        if self.deep:
            value = x
            net = own[2 if self.wide else 1:]
            for i in range(0, len(net), 2):
                layers.append(value)
                value = value @ net[i] + net[i + 1]
                if i + 2 < len(net):
                    value = np.maximum(value, 0)
            out = out + value
        return out, layers

    def gradient(self, own: list[np.ndarray], x: np.ndarray, cells: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy."""
        scores, layers = self.logits(own, x, cells)
        d = _softmax(scores)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        out = [d.sum(axis=0)]
        if self.wide:
            wide = np.zeros_like(own[1])
            np.add.at(wide, cells.ravel(), np.repeat(d, cells.shape[1], axis=0))
            out.append(wide)
        if self.deep:
            net, back = own[2 if self.wide else 1:], []
            for i in range(len(net) - 2, -1, -2):
                back += [d.sum(axis=0), layers[i // 2].T @ d]
                if i:
                    d = (d @ net[i].T) * (layers[i // 2] > 0)
            out += back[::-1]
        return out


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class WideDeep:
    """A fitted model; ``scale`` has mean and deviation of each feature, a missing value is the mean."""

    shape: Shape
    weights: list[np.ndarray]
    cuts: list[np.ndarray]
    scale: np.ndarray

    def score(self, m: DataFrame, features: str = "features") -> DataFrame:
        """The rows without their features, with ``prediction`` and ``probability``, one number per class."""
        shape, weights, cuts, scale = self.shape, self.weights, self.cuts, self.scale
        keep = [c for c in m.columns if c != features]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(len(keep)), shape.features)
                bins = np.stack([np.searchsorted(c, x[:, i], side="right") + 1 for i, c in enumerate(cuts)], axis=1) if cuts else np.zeros((len(x), 0), int)
                bins[np.isnan(x)] = 0
                p = _softmax(shape.logits(weights, _scaled(x, scale), _cells(bins, shape))[0])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))],
                                                 names=[*keep, "prediction", "probability"])

        schema = T.StructType([*[m.schema[c] for c in keep], T.StructField("prediction", T.IntegerType()),
                               T.StructField("probability", T.ArrayType(T.DoubleType()))])
        return m.select(*keep, F.col(features).cast("array<double>")).mapInArrow(each, schema)

    def loss(self, m: DataFrame) -> float:
        """The mean cross entropy of labelled rows."""
        p = F.get("probability", F.col("label").cast("int"))
        return self.score(m).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12))))).first()[0]


def _scaled(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.nan_to_num((x - scale[0]) / scale[1], nan=0.0)


def _cells(bins: np.ndarray, shape: Shape) -> np.ndarray:
    return bins.astype(np.int64) + np.arange(shape.features) * shape.bucket_cells


def _scale(m: DataFrame, width: int) -> np.ndarray:
    """Mean and deviation of each feature, 0 and 1 where there is none."""
    rows = m.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).collect()
    out = np.stack([np.zeros(width), np.ones(width)])  # a row for each feature comes back
    for r in rows:
        out[:, r["i"]] = r["mean"] or 0.0, r["std"] or 1.0
    return out


def fit(train: DataFrame, steps: int = 1000, batch: int = 40, hidden: tuple[int, ...] = HIDDEN, rate: float = 0.05, wide: bool = True,
        deep: bool = True, tasks: int = 2, between: int = 100, seed: int = 123) -> WideDeep:
    """Train on ``(id, label, features)`` rows, labels 0 and up, by Adagrad.

    A step takes ``batch`` rows, divided among the tasks, of which the cluster must have room for ``tasks`` at once; each holds
    its share of the rows as numbers. Features may be missing. Rows without a label are not learnt from, a NULL id is an
    error; without rows the model knows no difference between classes.
    """
    if not (wide or deep):
        raise ValueError("a model needs a wide or a deep part")
    m = materialize(clean_features(train.filter("label IS NOT NULL")))
    seen = m.agg(F.max(F.size("features")).alias("width"), F.max(F.col("label").cast("int")).alias("top")).first()
    width, classes = seen["width"] or 0, max(2, (seen["top"] or 0) + 1)
    cuts, scale = collect_cuts(quantile_cuts(m, BUCKETS), width), _scale(m, width)
    shape = Shape(width, classes, tuple(hidden), wide, deep, BUCKETS + 2)
    rows = binned(m.withColumn("x", F.col("features").cast("array<double>")).withColumn("id", known_id("id")), cuts, keep=("id", "label", "x"))
    placed = rows.repartition(tasks, "id").sortWithinPartitions("id").select(F.col("label").cast("int").alias("label"), "x", "bins")
    share = -(-batch // tasks)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), _scaled(_matrix(b.column(1), width), scale).astype(np.float32),
                  np.stack([np.frombuffer(r.as_buffer(), np.uint8) for r in b.column(2)])) for b in batches if b.num_rows]
        own, context = shape.start(seed), BarrierTaskContext.get()
        y, x, bins = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.zeros(0, int), None, None)
        rng, squares = np.random.default_rng([seed, context.partitionId()]), [np.full(w.shape, 0.1) for w in own]
        for done in range(0, steps, between):
            for _ in range(min(between, steps - done) if len(y) else 0):
                some = rng.integers(0, len(y), share)
                for w, s, g in zip(own, squares, shape.gradient(own, x[some].astype(float), _cells(bins[some], shape), y[some])):
                    s += g * g
                    w -= rate * g / np.sqrt(s)
            if tasks > 1:
                own, squares = _averaged(context, own, squares, len(y))
        if context.partitionId() == 0:
            flat = np.concatenate([w.ravel() for w in own])
            yield pa.RecordBatch.from_arrays([pa.array([flat.astype("<f8").tobytes()], pa.binary())], names=["weights"])

    found = placed.mapInArrow(work, "weights binary", barrier=True).collect()  # one row, the model; none without rows
    weights = _split(np.frombuffer(found[0]["weights"], "<f8"), shape.sizes()) if found else shape.start(seed)
    return WideDeep(shape, weights, cuts, scale)


def _split(flat: np.ndarray, sizes: list[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([0, *(int(np.prod(s)) for s in sizes)])
    return [flat[a:b].reshape(s).copy() for a, b, s in zip(ends, ends[1:], sizes)]


def _averaged(context: BarrierTaskContext, own: list[np.ndarray], squares: list[np.ndarray], n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All tasks' parameters, weighted by their numbers of rows."""
    flat = np.concatenate([w.ravel() for w in [*own, *squares]])
    sent = base64.b64encode(np.concatenate([[n], flat]).astype("<f8").tobytes()).decode()
    every = np.stack([np.frombuffer(base64.b64decode(m), "<f8") for m in context.allGather(sent)])
    weight = every[:, 0] if every[:, 0].any() else np.ones(len(every))
    mean = weight @ every[:, 1:] / weight.sum()
    both = _split(mean, [w.shape for w in [*own, *squares]])
    return both[:len(own)], both[len(own):]


def save(model: WideDeep, spark: SparkSession, path: str) -> None:
    """One row with the model's numbers."""
    flat = np.concatenate([w.ravel() for w in model.weights])
    shape = model.shape
    spark.createDataFrame(
        [(shape.features, shape.classes, list(shape.hidden), shape.wide, shape.deep, shape.bucket_cells, flat.tolist(), [c.tolist() for c in model.cuts], model.scale.tolist())],
        "features int, classes int, hidden array<int>, wide boolean, deep boolean, cells int, weights array<double>, cuts array<array<double>>, scale array<array<double>>",
    ).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> WideDeep:
    r = spark.read.parquet(path).first()
    shape = Shape(r["features"], r["classes"], tuple(r["hidden"]), r["wide"], r["deep"], r["cells"])
    return WideDeep(shape, _split(np.array(r["weights"]), shape.sizes()), [np.array(c, dtype=float) for c in r["cuts"]], np.array(r["scale"]))
