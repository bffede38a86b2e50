"""A quality classifier: ordinal regression with a cumulative link on hashed text.

Ratings are grades ``0 .. K - 1``. One weight vector over hashed words and word shapes gives a text a score s, and K - 1
ordered thresholds cut the scores: ``P(grade <= k) = 1 / (1 + exp(s - t_k))``. From these come the expected grade and the
probability of the tail ``P(grade >= cut)``, by which documents are selected.

The model is fitted on a bounded sample of the rated documents (``sample_rows``, chosen by a hash of the id), which the
driver holds as hashed numbers; every document is scored in Arrow batches in its partition, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .worker import kept

DIM = 1 << 18
SAMPLE_ROWS = 8_000  # rated documents that the model is fitted on, at most
CACHE_WORDS = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class WordFeatures(dict):
    """Word -> the hashed features of its lower-cased form and of its shape, packed into one number."""

    def __missing__(self, word: str) -> int:
        # the shape: a run of letters becomes one that tells its case, everything else stays
        shape = _LETTERS.sub(lambda m: "a" if m[0].islower() else "A" if len(m[0]) > 1 and m[0].isupper() else "Aa", word)
        value = self[word] = (zlib.crc32(b"w" + word.lower().encode("utf-8", "replace")) % DIM) << 20 | (
            zlib.crc32(b"s" + shape.encode("utf-8", "replace")) % DIM)
        return value


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different hashed features of a text and their values, a vector of length 1.

    Besides words and shapes there are the length of the text (as a power of two) and how much of it repeats the word
    before or an earlier word.
    """
    words = [w for w in _SPACE.split(text or "") if w]
    cache = kept("quality words", WordFeatures)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    packed = np.fromiter((cache[w] for w in words), dtype=np.int64, count=len(words))
    twice = int((packed[1:] == packed[:-1]).sum()) if len(packed) else 0
    different = len(np.unique(packed))
    share = lambda n: int(8 * n / max(1, len(words)))
    extra = [f"length {len(words).bit_length()}", f"next {share(twice)}", f"new {share(different)}"]
    ids, counts = np.unique(np.concatenate([packed >> 20, packed & (DIM - 1)]), return_counts=True)
    values = np.log1p(counts)
    values /= max(1e-12, np.sqrt((values ** 2).sum()))
    own = np.array([zlib.crc32(e.encode()) % DIM for e in extra], dtype=np.int64)
    return np.concatenate([ids, own]), np.concatenate([values, np.full(len(own), 0.3)])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[ids] @ values)

    def below(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade <= k)`` for k = 0 .. K - 1, a column each."""
        inner = _logistic(self.thresholds[None, :] - np.asarray(scores, dtype=float)[:, None])
        return np.hstack([inner, np.ones((len(inner), 1))])

    def expected_grade(self, scores: np.ndarray) -> np.ndarray:
        return (1.0 - self.below(scores)[:, :-1]).sum(axis=1)

    def tail(self, scores: np.ndarray, cut: int) -> np.ndarray:
        """``P(grade >= cut)``."""
        return 1.0 - self.below(scores)[:, cut - 1] if cut > 0 else np.ones(len(scores))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, steps: int = 200, rate: float = 0.2,
        penalty: float = 1e-4) -> OrdinalModel:
    """Full-batch Adam on the mean negative log likelihood. Thresholds stay ordered: all but the first are sums of
    exponentials. Without rows, or with one grade only, what is left is the smoothed share of each grade.
    """
    counts = np.bincount(grades, minlength=n_grades) + 1.0
    upto = np.cumsum(counts)[:-1] / counts.sum()
    start = np.log(upto / (1 - upto))
    params = np.concatenate([np.zeros(DIM), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    if not rows:
        return OrdinalModel(params[:DIM].astype(np.float32), start)
    sizes = np.array([len(i) for i, _ in rows])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids, values = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    used, ids = np.unique(ids, return_inverse=True)
    mean, square = np.zeros(len(used) + n_grades - 1), np.zeros(len(used) + n_grades - 1)
    live = np.concatenate([params[used], params[DIM:]])
    at = np.arange(len(rows))
    for step in range(1, steps + 1):
        weights, free = live[:len(used)], live[len(used):]
        cuts = np.concatenate([[-np.inf], free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]), [np.inf]])
        scores = np.add.reduceat(weights[ids] * values, begins)
        cum = np.hstack([np.zeros((len(rows), 1)), _logistic(cuts[None, 1:-1] - scores[:, None]), np.ones((len(rows), 1))])
        slope = cum * (1 - cum)
        p = np.maximum(cum[at, grades + 1] - cum[at, grades], 1e-9)
        d_score = (slope[at, grades + 1] - slope[at, grades]) / p / len(rows)  # of the negative log likelihood
        d_cuts = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_cuts[k] = -(slope[grades == k, k + 1] / p[grades == k]).sum() / len(rows) + (
                slope[grades == k + 1, k + 1] / p[grades == k + 1]).sum() / len(rows)
        tails = np.cumsum(d_cuts[::-1])[::-1]
        d_free = np.concatenate([tails[:1], tails[1:] * np.exp(free[1:])])
        d_weights = np.bincount(ids, weights=np.repeat(d_score, sizes) * values, minlength=len(used)) + penalty * weights
        grad = np.concatenate([d_weights, d_free])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        live = live - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    weights = np.zeros(DIM, dtype=np.float32)
    weights[used] = live[:len(used)]
    free = live[len(used):]
    return OrdinalModel(weights, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def fit_grades(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
               text_col: str = "text", grade_col: str = "grade") -> OrdinalModel:
    """Fit on at most ``sample_rows`` ratings, those with the lowest hashes of their ids.

    Ratings without a grade or id, and grades outside ``0 .. n_grades - 1``, are no ratings; several of one document all
    count.
    """
    grade = F.col(grade_col).cast("int")
    rated = ratings.filter(F.col(id_col).isNotNull() & grade.between(0, n_grades - 1))
    key = F.xxhash64(F.lit(7), id_col)
    sample = rated.orderBy(key, id_col).limit(sample_rows).select(F.col(id_col).alias("_id"), grade.alias("_grade"))
    sample = F.broadcast(materialize(sample))  # sample_rows rows at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                rows = [features(t) for t in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                     pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32())), some.column(1)],
                    names=["ids", "values", "grade"])

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("grade", T.IntegerType())])
    rows = texts.join(sample, "_id").select("_text", "_grade").mapInArrow(hashed, schema).toArrow()
    grades = rows.column("grade").to_numpy().astype(np.int64)
    pairs = [(rows.column("ids")[i].values.to_numpy(), rows.column("values")[i].values.to_numpy().astype(float))
             for i in range(rows.num_rows)]
    return fit(pairs, grades, n_grades)


def grade_documents(docs: DataFrame, model: OrdinalModel, cut: int, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows with one more column ``graded``: ``expected_grade``, ``tail_probability`` and ``selected``.

    ``tail_probability`` is that of a grade of at least ``cut``; a document is selected if it is ``least`` or more. A
    NULL text is graded as an empty one, which has features of its own (its length). Repeated rows, NULL in other
    columns and other columns' names make no difference, but a column ``graded`` is replaced; an empty table gives an
    empty one.
    """
    @F.pandas_udf("expected_grade double, tail_probability double, selected boolean")
    def graded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            scores = np.array([model.score(*features(t)) for t in part], dtype=float)  # DIM weights go with the task
            tail = model.tail(scores, cut)
            yield pd.DataFrame({"expected_grade": model.expected_grade(scores), "tail_probability": tail,
                                "selected": tail >= least})

    return docs.withColumn("graded", graded(F.col(text_col)))
