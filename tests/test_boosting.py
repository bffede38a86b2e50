import numpy as np
import pytest
from pyspark.sql import functions as F

from longloom.functions.hashing import uniform
from longloom.plans import boosting as b


def data(n=300, width=6, seed=1, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, width)), 2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0.2) ^ (rng.random(n) < 0.05)).astype(int)
    x[rng.random(x.shape) < gaps] = np.nan
    return x, y


def frame(spark, x, y, parts=4):
    rows = [(i, None if label is None else int(label), [None if v != v else float(v) for v in r]) for i, (r, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(parts)


def plain_cuts(x, bins):
    out = []
    for column in x.T:
        v = np.sort(column[~np.isnan(column)])
        ranks = {-(-q * len(v) // bins) for q in range(1, bins)} if len(v) else set()
        out.append(sorted({v[r - 1] for r in ranks} - {v[0]} if len(v) else set()))
    return out


def plain_boost(x, y, own, in_sample):
    """Trees as nested tuples, every split tried on the values themselves."""
    cuts, margin, trees = plain_cuts(x, own.bins), np.zeros(len(y)), []

    def worth(g, h):
        return max(abs(g) - own.alpha, 0) ** 2 / (h + own.lam)

    def build(rows, depth, g, h, columns):
        total = g[rows].sum(), h[rows].sum()
        best = None
        if depth < own.max_depth:
            for f in columns:
                for c in [*cuts[f], np.inf]:
                    for missing_left in (False, True):
                        left = np.where(np.isnan(x[rows, f]), missing_left, x[rows, f] < c)
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        gain = worth(gl, hl) + worth(total[0] - gl, total[1] - hl) - worth(*total)
                        if min(hl, total[1] - hl) >= own.min_child_weight and gain > b.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, c, missing_left, left
        if best:
            gain, f, c, missing_left, left = best
            ends = build(rows[left], depth + 1, g, h, columns), build(rows[~left], depth + 1, g, h, columns)
            if gain >= own.gamma or any(len(e) > 1 for e in ends):
                return f, c, missing_left, *ends
        return (own.weight(*total),)

    def value(tree, row):
        while len(tree) > 1:
            f, c, missing_left, left, right = tree
            tree = left if (missing_left if np.isnan(row[f]) else row[f] < c) else right
        return tree[0]

    for t in range(own.n_estimators):
        p = 1 / (1 + np.exp(-margin))
        tree = build(np.flatnonzero(in_sample[t]), 0, p - y, p * (1 - p), own.columns(t, x.shape[1]))
        margin += np.array([value(tree, r) for r in x])
        trees.append(tree)
    return margin, trees


@pytest.mark.parametrize("node_bytes", [0, 250, 8 << 20])
@pytest.mark.parametrize("own", [
    b.Boosting(n_estimators=3, max_depth=3, bins=16, alpha=0.5, gamma=0.0, subsample=1, colsample=1),
    b.Boosting(n_estimators=3, max_depth=4, bins=8, alpha=2.0, gamma=1.5, min_child_weight=4, learning_rate=0.4)])
def test_against_plain_trees(spark, monkeypatch, own, node_bytes):
    """Level by level, the lower nodes in tasks of their own, and whole trees in one."""
    monkeypatch.setattr(b, "NODE_BYTES", node_bytes)
    x, y = data()
    m = frame(spark, x, y)
    in_sample = [np.ones(len(y), bool) if own.subsample == 1 else np.array(
        [r[0] for r in m.orderBy("id").select(uniform("id", f"{own.seed}:rows:{t}") < own.subsample).collect()]) for t in range(own.n_estimators)]
    margin, trees = plain_boost(x, y, own, in_sample)
    model = b.fit(m, own)
    got = {r["id"]: r["probability"][1] for r in model.score(m).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-9)
    assert all(len(t) > 1 for t in trees)
    assert {f for t in model.trees for f in t.feature if f >= 0} <= set(range(6))


def test_cuts_are_quantiles(spark):
    x, y = data(n=157)
    x[:, 4] = np.nan
    x[:, 5] = 7.0
    found = b.collect_cuts(b.quantile_cuts(frame(spark, x, y), 10), 6)
    assert [c.tolist() for c in found] == plain_cuts(x, 10)
    assert found[4].size == 0 and found[5].size == 0


def test_bins(spark):
    m = spark.createDataFrame([(1, [0.5, None]), (2, [1.0, 5.0]), (3, [float("nan"), -1.0]), (4, [9.0, float("inf")])], "id int, features array<double>")
    cuts = [np.array([0.5, 1.0, 2.0]), np.array([])]
    got = {r["id"]: list(r["bins"]) for r in b.binned(m, cuts, keep=("id",)).collect()}
    assert got == {1: [2, 0], 2: [3, 1], 3: [0, 1], 4: [4, 1]}


def test_learns_and_is_kept(spark, tmp_path):
    x, y = data(n=800, seed=4)
    m = frame(spark, x, y)
    model = b.fit(m.filter("id < 600"), b.Boosting(n_estimators=12, max_depth=4, alpha=1.0, learning_rate=0.5))
    test = m.filter("id >= 600").withColumn("extra", F.lit("e"))
    scored = model.score(test)
    assert scored.columns == ["id", "label", "extra", "prediction", "probability"]
    assert scored.filter("label = prediction").count() > 140
    model.save(spark, str(tmp_path / "m"))
    again = b.load(spark, str(tmp_path / "m"))
    assert again == model and sorted(again.score(test).collect()) == sorted(scored.collect())
    used = {r["feature"]: r["splits"] for r in model.importance(spark).collect()}
    assert set(used) >= {0, 1, 2} and sum(used.values()) >= 12


def test_odd_inputs(spark):
    own = b.Boosting(n_estimators=2, max_depth=2, alpha=0.0, subsample=1)
    x, y = data(n=60)
    m = frame(spark, x, [*y[:50], *[None] * 10])
    assert b.fit(m, own).trees == b.fit(m.filter("label IS NOT NULL"), own).trees
    same = spark.createDataFrame([(i, 1, [1.0, None]) for i in range(20)], "id long, label int, features array<double>")
    model = b.fit(same, own)  # nothing to split by, and one class
    assert all(t.feature == [-1] for t in model.trees) and model.score(same).first()["prediction"] == 1
    empty = b.fit(m.filter("id < 0"), own)
    assert empty.trees[0].weight == [0.0] and empty.width == 0
    twice = m.unionByName(m)
    assert b.fit(twice, own).trees[0].feature[0] >= 0
    with pytest.raises(ValueError):
        b.fit(m, b.Boosting(bins=400))
    with pytest.raises(Exception, match="features"):
        model.score(m).collect()


def test_columns_and_pruning():
    own = b.Boosting(colsample=0.5)
    assert [len(own.columns(t, 9)) for t in range(3)] == [4, 4, 4] and own.columns(0, 9).tolist() != own.columns(1, 9).tolist()
    tree = b.Tree()
    left, right = tree.split(0, 1, 1, 0.5, False, 0.1)
    tree.split(right, 2, 1, 0.5, False, 3.0)
    tree.split(left, 2, 1, 0.5, False, 0.2)
    tree.prune(1.0)
    assert tree.feature[:3] == [1, -1, 2]  # a weak split stays above a strong one
    tree.prune(5.0)
    assert tree.feature[0] == -1


def test_grid_search(spark):
    x, y = data(n=150, seed=6)
    found = b.grid_search(frame(spark, x, y), {"max_depth": [1, 3], "alpha": [0.0, 500.0], "n_estimators": [1, 3]}, folds=3,
                          base=b.Boosting(learning_rate=0.5, bins=16))
    assert len(found.tried) == 8 and found.best["alpha"] == 0.0
    by = {tuple(s.values()): f for s, f in found.tried}
    assert by[1, 500.0, 1] == by[3, 500.0, 3]  # no tree splits under such a penalty
    assert set(found.best) == {"max_depth", "alpha", "n_estimators"}


def test_margins_are_kept(spark, monkeypatch):
    """The same trees however often the rows are stored with their margins; no tree adds up more than the ones since then."""
    x, y = data()
    own, seen, plain = b.Boosting(n_estimators=5, max_depth=3, bins=16, alpha=0.5, gamma=0.0), [], b.grow
    monkeypatch.setattr(b, "grow", lambda rows, n, trees, *rest: seen.append(len(trees)) or plain(rows, n, trees, *rest))
    models = []
    for keep in (100, 2, 1):
        monkeypatch.setattr(b, "KEEP_TREES", keep)
        models.append(b.fit(frame(spark, x, y), own).trees)
    assert seen == [0, 1, 2, 3, 4, 0, 1, 0, 1, 0, 0, 0, 0, 0, 0]
    assert models[0] == models[1] == models[2]


def test_sums_and_order_of_many_rows():
    rng = np.random.default_rng(3)
    own, g, h = rng.integers(0, 4, (b.FEW_ROWS + 500, 11)).astype(np.uint8), rng.normal(size=b.FEW_ROWS + 500).round(1), np.ones(b.FEW_ROWS + 500)
    own[::3] = own[0]  # copies are told apart by their gradients
    plain = sorted(range(len(own)), key=lambda i: (own[i].tobytes(), g[i], h[i]))
    assert list(b._order(own, g, h)) == plain
    for n in (b.FEW_ROWS, len(own)):
        sums = b._sums(own[:n], g[:n], h[:n], 3)
        assert all(np.array_equal(s[c, v], np.bincount(own[:n, c], w[:n], 4)[v]) for s, w in zip(sums, (g, h, h)) for c in range(11) for v in range(4))
