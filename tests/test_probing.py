import numpy as np
import pytest

from longloom.operators import probing as p
from longloom.operators.impute import impute_knn
from longloom.operators.neighbours import nearest


@pytest.fixture(scope="module")
def rows(spark):
    """Forty loose groups in twelve dimensions, with gaps."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 4, (40, 12))[rng.integers(0, 40, 1500)] + rng.normal(0, 1, (1500, 12))
    x[rng.random(x.shape) < 0.03] = np.nan
    data = [(i, [None if v != v else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "id long, features array<double>").repartition(4).cache()


def lists(df):
    return {(r["id"], r["idx"]): [b["donor"] for b in r["best"]] for r in df.collect()}


def test_recall(spark, rows):
    asking = rows.filter("exists(features, x -> x IS NULL)")
    exact = lists(nearest(asking, rows, {None: (asking.count(), 1500)}, 5, per_gap=True))
    found, seen = p.nearest_probed(asking, rows, 5, True, 256, 512, recall=0.95)
    found = lists(found)
    assert set(found) <= set(exact)
    held = sum(len(set(v) & set(found.get(key, []))) for key, v in exact.items()) / sum(map(len, exact.values()))
    assert held >= 0.9 and seen["recall"] >= 0.95 and 1 < seen["probes"] < seen["cells"] / 2  # most cells are never met
    all_of_it, seen = p.nearest_probed(asking, rows, 5, True, 256, 512, recall=1.1)
    assert lists(all_of_it) == exact and seen["probes"] == seen["cells"]


def test_filled_like_the_exact_way(spark, rows):
    one = {r["id"]: r["features"] for r in impute_knn(rows).collect()}
    two = {r["id"]: r["features"] for r in impute_knn(rows, recall=0.95).collect()}
    assert set(one) == set(two) and all(v is not None for r in two.values() for v in r)
    gaps = [(a, b, o) for r in rows.collect() for a, b, o in zip(one[r["id"]], two[r["id"]], r["features"])]
    assert all(a == b == o for a, b, o in gaps if o is not None)
    filled = [abs(a - b) < 1e-9 for a, b, o in gaps if o is None]
    assert len(filled) > 300 and sum(filled) > 0.8 * len(filled)


def test_few_and_odd_rows(spark):
    kinds = "id string, features array<double>"
    m = spark.createDataFrame([("a", [1.0, None]), ("b", [1.1, 5.0]), ("c", [None, None]), ("d", [9.0, 1.0])], kinds)
    found, seen = p.nearest_probed(m.filter("id IN ('a', 'c')"), m, 1, True, 64, 64)
    assert lists(found) == {("a", 1): ["b"]}
    nothing, seen = p.nearest_probed(m, m.limit(0), 2, True, 64, 64)
    assert lists(nothing) == {} and seen["cells"] == 0
    assert lists(p.nearest_probed(m.limit(0), m, 2, True, 64, 64)[0]) == {}
