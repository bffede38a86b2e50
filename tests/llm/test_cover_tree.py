import numpy as np
import pytest
from pyspark.sql import functions as F

from longloom.llm import cover_tree as c


def covered(node, points):
    rows = node.rows if node.rows is not None else np.concatenate([covered(x, points) for x in node.children])
    assert (np.sqrt(((points[rows] - node.center) ** 2).sum(axis=1)) <= node.radius + 1e-9).all()
    for i, x in enumerate(node.children):
        for y in node.children[:i]:
            assert np.sqrt(((x.center - y.center) ** 2).sum()) > node.radius / 2.01 or node.radius > 0
    return rows


@pytest.mark.parametrize("kind", ["clusters", "uniform", "same", "line"])
def test_search_is_exact(monkeypatch, kind):
    monkeypatch.setattr(c, "LEAF", 8)
    rng = np.random.default_rng(1)
    n = 900
    points = {"clusters": lambda: rng.normal(size=(12, 6))[rng.integers(0, 12, n)] * 500 + rng.normal(size=(n, 6)) * 9,
              "uniform": lambda: rng.uniform(-99, 99, size=(n, 20)), "same": lambda: np.ones((n, 3)) * 5,
              "line": lambda: np.arange(n)[:, None] * np.ones((1, 2))}[kind]()
    points = np.floor(points).astype(np.int64)
    tree = c.build(points.astype(float))
    assert sorted(covered(tree, points.astype(float))) == list(range(n))
    ids = rng.permutation(n) + 5
    asked = np.flatnonzero(ids % 10 == 0)
    rows = np.arange(n)
    best = c.search(points[asked], rows[asked], points, rows, ids, 7)
    for row, q in enumerate(asked):
        scores = points @ points[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:7]
        assert best.ids[row].tolist() == ids[order].tolist()
        assert best.scores[row].astype(np.int64).tolist() == scores[order].tolist()


def test_pruning_leaves_most_pairs_out(monkeypatch):
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(30, 4))[rng.integers(0, 30, 6000)] * 5000 + rng.normal(size=(6000, 4)) * 9).astype(np.int64)
    seen = []
    offer = c.Best.offer
    monkeypatch.setattr(c.Best, "offer", lambda self, r, s, i: (seen.append(s.size), offer(self, r, s, i))[1])
    ids = np.arange(6000)
    best = c.search(points[::20], ids[::20], points, ids, ids, 10)
    assert best.skipped > 100
    assert sum(seen) < 0.5 * 300 * 6000


def test_large_numbers():
    q, d = np.array([[3_000_000_001, 1]]), np.array([[3_000_000_001, 7], [3_000_000_000, 5], [3_000_000_001, 6]])
    best = c.search(q, np.array([9]), d, np.array([1, 2, 3]), np.array([1, 2, 3]), 2)
    assert best.scores.astype(np.int64).tolist() == [[3_000_000_001 ** 2 + 7, 3_000_000_001 ** 2 + 6]]
    with pytest.raises(OverflowError):
        c.search(q * 4, np.array([9]), d, np.array([1, 2, 3]), np.array([1, 2, 3]), 2)


@pytest.mark.parametrize("blocks", [(4096, 8192), (3, 17)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(c, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(c, "DATA_BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)], "s") for i in range(120)]
    rows += [(200, None, "s"), (201, [1.0, None, 2.0, 3.0], "s"), (210, [float("nan")] * 4, "s"), (220, [float("inf"), 1.0, 1.0, 1.0], "s"),
             (None, [9.0] * 4, "s"), (230, [1.0, 2.0], "s"), (231, [3.0, 2.0], "s"), (240, [], "s"), (110, rows[110][1], "s"), (5, rows[5][1], "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r[n] for n in ("query_id", "rank", "vec_id", "score")) for r in c.top_k(df, F.col("vec_id") % 10 == 0, 5).collect())
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for at, (i, v) in enumerate(good):
        if i % 10 == 0:
            others = sorted((-int(w @ v), j) for other, (j, w) in enumerate(good) if other != at and len(w) == len(v))[:5]
            expected += [(i, n, j, -s) for n, (s, j) in enumerate(others, 1)]
    assert got == sorted(expected)
    assert sum(q == 110 and v == 110 for q, _, v, _ in got) == 2  # either of two rows finds the other
    assert c.top_k(df.filter("vec_id > 500"), F.lit(True)).count() == 0
