import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from longloom.llm import bond as b

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, positives=5, negatives=10, every=100):
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, y) in enumerate(good):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z) for m, (j, w, z) in enumerate(good) if m != n and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == y)[:positives]:
            fit = sorted(s for s in scored if s[2] != y and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(i, p, r, j, -ps, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


def results(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def vectors(n=400, width=24, seed=2, steps=8):
    """Coarse values, so that many scores tie."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (4, width))
    labels = rng.integers(0, 4, n)
    values = np.round((centers[labels] + rng.normal(0, 1, (n, width))) * steps) / steps
    return [(int(i), v.tolist(), int(y)) for i, v, y in zip(rng.permutation(n * 3)[:n], values, labels)]


@pytest.mark.parametrize("anchors, size", [(1024, 16 << 20), (3, 50 * 24 * 8)])
def test_against_brute_force(spark, monkeypatch, anchors, size):
    monkeypatch.setattr(b, "ANCHOR_BLOCK", anchors)
    monkeypatch.setattr(b, "BLOCK_BYTES", size)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", row int, anchor string").repartition(5)
    got = results(b.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert got == brute_force(rows, every=10) and len(got) > 200


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 2), (100, [-1.0, 0.0], 1), (200, [0.0, 0.0], 1), (300, [1.0], 1),
            (1, [1.0, 0.5], 1), (2, [0.4, 0.5], 2), (2, [0.4, 0.5], 2), (3, [0.4, 0.5], 0), (4, [0.0, 0.0], 5), (5, [None, 1.0], 1),
            (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, None, 2), (9, [], 2), (10, [1.0, 1.0], None), (None, [0.5, 0.5], 2),
            (400, None, 1), (11, [0.6], 2), (12, [1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = results(b.hard_negatives(df, F.col("vec_id") % 100 == 0))
    assert got == brute_force(rows)
    assert (0, 0, 1, 2, 81920, 42496) in got and sum(r[:3] == (0, 0, 1) for r in got) == 2  # either of the repeated anchors
    assert (300, 12, 1, 11, 65536, 39168) in got
    assert results(b.hard_negatives(df.filter("vec_id < 0"), F.col("vec_id") % 100 == 0)) == []
    assert results(b.hard_negatives(df, F.lit(None).cast("boolean"))) == []


def test_windows():
    for score in (-7, -1, 0, 1, 3, 10, 33, 100, 101, 12345):
        least, most = b.window_of(score, 30, 90)
        fits = [n for n in range(-20_000, 20_000) if 30 * score <= 100 * n <= 90 * score]
        assert fits == list(range(least, most + 1))


def test_the_bitmap_shrinks():
    """Candidates are given up before all columns are read, and the result is that of all of them."""
    rng = np.random.default_rng(1)
    data = (rng.normal(0, 1, (3000, 64)) * 100 / np.arange(1, 65)).astype(np.int64)
    anchor, ids = (rng.normal(0, 1, 64) * 100 / np.arange(1, 65)).astype(np.int64), rng.permutation(3000)
    columns = b.Columns(data)
    at, scores = b.highest(columns, anchor, np.ones(3000, bool), ids, 5)
    order = np.lexsort((ids, -(data @ anchor)))
    assert ids[at].tolist() == ids[order[:5]].tolist() and scores.tolist() == (data @ anchor)[order[:5]].tolist()
    assert columns.read < 0.5 * data.size
    columns = b.Columns(data)
    all_scores, windows = data @ anchor, [(100, 9000), (-50, -40), (5, 4), (-10 ** 9, 10 ** 9)]
    for (least, most), (at, scores) in zip(windows, b.in_windows(columns, anchor, ids % 3 > 0, ids, 10, windows)):
        fits = [i for i in order.tolist() if ids[i] % 3 > 0 and least <= all_scores[i] <= most][:10]
        assert ids[at].tolist() == ids[fits].tolist() and scores.tolist() == all_scores[fits].tolist()


def test_too_large_scores_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9], 1), (1, [1e9, 1e9], 1)], SCHEMA)
    with pytest.raises(Exception, match="do not fit"):
        b.hard_negatives(df, F.col("vec_id") == 0).collect()
