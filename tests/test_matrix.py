import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from longloom.operators import balance, impute, matrix, neighbours, scale, split
from longloom.plans import preparation

SCHEMA = "id bigint, label int, features array<double>"


def frame(spark, values, labels=None):
    labels = labels if labels is not None else [i % 2 for i in range(len(values))]
    rows = [(i, None if y is None else int(y), [None if v is None or np.isnan(v) else float(v) for v in row])
            for i, (row, y) in enumerate(zip(values, labels))]
    return spark.createDataFrame(rows, SCHEMA)


def array(df):
    rows = df.orderBy("id").collect()
    return np.array([[np.nan if v is None else v for v in r.features] for r in rows], dtype=float)


def gappy(n, d, share, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[rng.random((n, d)) < share] = np.nan
    return x


def brute_knn(x, k):
    out, d = x.copy(), x.shape[1]
    means = np.nanmean(x, axis=0)
    for i, j in zip(*np.where(np.isnan(x))):
        found = []
        for r in range(len(x)):
            both = ~np.isnan(x[i]) & ~np.isnan(x[r])
            if r != i and not np.isnan(x[r, j]) and both.any():
                dist = math.sqrt(d / both.sum() * ((x[i, both] - x[r, both]) ** 2).sum())
                found.append((round(dist, 9), r, x[r, j]))
        best = sorted(found)[:k]
        out[i, j] = np.mean([b[2] for b in best]) if best else means[j]
    return out


@pytest.mark.parametrize("blocks", [(2048, 32768), (5, 7)])
def test_knn_matches_brute_force(spark, blocks):
    x = gappy(40, 6, 0.2)
    x[3] = np.nan  # shares nothing with any row: column means
    got = impute.impute_knn(frame(spark, x), 5, block_rows=blocks[0], split_rows=blocks[1])
    assert np.allclose(array(got), brute_knn(x, 5))


def test_knn_with_copies_breaks_ties_by_id(spark):
    x = np.tile([[1.0, 2.0, 3.0]], (30, 1))
    x[:, 2] = np.arange(30)
    x[29, 2] = np.nan
    got = array(impute.impute_knn(frame(spark, x), 5, block_rows=4, split_rows=6))
    assert got[29, 2] == np.mean([0, 1, 2, 3, 4])


def test_knn_large_offset_keeps_precision(spark):
    x = gappy(25, 4, 0.15, seed=3) * 1e-3 + 1e4
    assert np.allclose(array(impute.impute_knn(frame(spark, x), 3)), brute_knn(x, 3), rtol=0, atol=1e-9)


def test_knn_fewer_donors_than_k(spark):
    x = np.array([[1.0, np.nan], [1.1, 5.0], [9.0, 7.0]])
    assert array(impute.impute_knn(frame(spark, x), 5))[0, 1] == 6.0


def test_knn_text_ids(spark):
    x = gappy(12, 3, 0.2, seed=5)
    df = frame(spark, x).withColumn("id", F.lpad(F.col("id").cast("string"), 3, "0"))
    assert np.allclose(array(impute.impute_knn(df, 2)), brute_knn(x, 2))


def test_mean_and_zero(spark):
    x = np.array([[1.0, np.nan], [3.0, np.nan], [np.nan, np.nan]])
    mean = array(impute.impute_mean(frame(spark, x)))
    assert mean[:, 0].tolist() == [1.0, 3.0, 2.0] and np.isnan(mean[:, 1]).all()
    assert array(impute.impute_zero(frame(spark, x))).tolist() == [[1, 0], [3, 0], [0, 0]]
    train = frame(spark, np.array([[10.0, 20.0]]))
    assert array(impute.impute_mean(frame(spark, x), fit_on=train))[2].tolist() == [10.0, 20.0]


def test_sparse_first_column_and_row_are_dropped(spark):
    x = np.ones((10, 4))
    x[:5, 0] = np.nan
    x[0, 1:] = np.nan
    index = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "idx int, site string")
    m, new = matrix.drop_sparse_columns(frame(spark, x), index, threshold=0.1)
    assert array(m).shape == (10, 3)
    assert [(r.idx, r.site) for r in new.orderBy("idx").collect()] == [(0, "s1"), (1, "s2"), (2, "s3")]
    rows = matrix.drop_sparse_rows(m, 0.1)
    assert sorted(r.id for r in rows.collect()) == list(range(1, 10))


def test_threshold_is_exclusive(spark):
    x = np.ones((10, 10))
    x[0, 0] = np.nan  # exactly 10 % of the column and of the row
    m, _ = matrix.drop_sparse_columns(frame(spark, x), threshold=0.1)
    assert len(m.first().features) == 10
    assert matrix.drop_sparse_rows(frame(spark, x), 0.1).count() == 10


def test_labels(spark):
    m = frame(spark, np.ones((4, 2)), [1, None, 0, 1])
    assert matrix.to_labelled_frame(m).count() == 3
    counts = matrix.class_counts(matrix.drop_unlabelled(m))
    assert matrix.majority_class(counts).first().label == 1
    tie = matrix.class_counts(frame(spark, np.ones((4, 2)), [1, 1, 0, 0]))
    assert matrix.majority_class(tie).first().label == 0


@pytest.mark.parametrize("n", [1, 2, 10, 333])
def test_split_sizes(spark, n):
    m = frame(spark, np.ones((n, 1)))
    for how in (split.split_exact, split.split_ordered):
        train, test = split.take_split(how(m))
        assert test.count() == math.ceil(0.3 * n) and train.count() == n - math.ceil(0.3 * n)
    ordered = split.split_ordered(m)
    ids = [r.id for r in ordered.filter("is_test").collect()]
    assert sorted(ids) == list(range(n - math.ceil(0.3 * n), n))


def test_split_is_repeatable_and_seeded(spark):
    m = frame(spark, np.ones((100, 1)))
    one, again, other = (split.split_exact(m, seed=s).filter("is_test").select("id") for s in (1, 1, 2))
    assert one.exceptAll(again).isEmpty() and not one.exceptAll(other).isEmpty()


def test_folds_are_stratified(spark):
    m = frame(spark, np.ones((103, 1)), [0] * 80 + [1] * 23)
    sizes = split.stratified_folds(m, 5).groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in sizes if r.label == 0) == [16] * 5
    assert sorted(r["count"] for r in sizes if r.label == 1) == [4, 4, 5, 5, 5]


def test_standardize(spark):
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(5, 3, (50, 3)), np.full((50, 1), 7.0)])
    train, test = frame(spark, x[:30]), frame(spark, x[30:])
    a, b = scale.standardize(train, test)
    mean, std = x[:30].mean(axis=0), x[:30].std(axis=0)
    std[3] = 1.0
    assert np.allclose(array(a), (x[:30] - mean) / std) and np.allclose(array(b), (x[30:] - mean) / std)


def test_zscore_features(spark):
    df = spark.createDataFrame([(1.0, 2, "a"), (None, 2, "b"), (5.0, 2, None)], "x double, c int, y string")
    got = scale.zscore_features(df, ["x", "c"], label="y").collect()
    x = np.array([1.0, 0.0, 5.0])
    assert np.allclose([r.x_xf for r in got], (x - x.mean()) / x.std())
    assert [r.c_xf for r in got] == [0, 0, 0] and [r.y_xf for r in got] == ["a", "b", None]
    assert [r.y for r in scale.fill_missing(df, ["y"]).collect()] == ["a", "b", ""]


def test_undersample(spark):
    m = frame(spark, np.ones((100, 1)), [0] * 13 + [1] * 87)
    counts = {r.label: r["count"] for r in balance.undersample(m, 0.5).groupBy("label").count().collect()}
    assert counts == {0: 13, 1: 26}
    enough = balance.undersample(m, 0.1).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in enough} == {0: 13, 1: 87}


def test_smote_counts_and_convexity(spark):
    rng = np.random.default_rng(2)
    labels = [0] * 60 + [1] * 9 + [2] * 40
    x = rng.normal(size=(109, 5))
    m = frame(spark, x, labels)
    out = balance.smote(m, 0.5, k=3, block_rows=4, split_rows=5)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 60, 1: 30, 2: 40}
    small = x[60:69]
    near = {i: np.argsort([np.inf if j == i else np.linalg.norm(small[i] - small[j]) for j in range(9)])[:3]
            for i in range(9)}
    for r in out.filter("synthetic IS NOT NULL").collect():
        p = np.array(r.features)
        on_line = False
        for i in range(9):
            for j in near[i]:
                step = small[j] - small[i]
                u = (p - small[i]) @ step / (step @ step)
                on_line |= -1e-9 <= u < 1 and np.allclose(p, small[i] + u * step)
        assert on_line


def test_smote_with_tiny_class_makes_many_rows(spark, monkeypatch):
    monkeypatch.setattr(balance, "CHUNK", 3)
    monkeypatch.setattr(balance, "BROADCAST_VALUES", 0)
    m = frame(spark, np.random.default_rng(3).normal(size=(52, 2)), [0] * 50 + [1] * 2)
    new = balance.synthetic_rows(m, 1.0)
    assert sorted(r.j for r in new.collect()) == list(range(48))


def test_smote_needs_two_members(spark):
    with pytest.raises(ValueError, match="single row"):
        balance.synthetic_rows(frame(spark, np.ones((10, 2)), [0] * 9 + [1]))
    with pytest.raises(ValueError):
        frame_one = frame(spark, np.ones((3, 2)), [0, 0, 1])
        balance.smote(frame_one, 1.0)


def test_smote_nothing_to_add(spark):
    m = frame(spark, np.ones((10, 2)), [0] * 5 + [1] * 5)
    assert balance.smote(m, 0.5).count() == 10


@pytest.mark.parametrize("fit_on", ["all", "train"])
def test_preprocess(spark, fit_on):
    x = gappy(60, 5, 0.03, seed=9)
    x[:30, 0] = np.nan
    labels = [None] + [1] * 45 + [0] * 14
    done = preparation.preprocess(frame(spark, x, labels), threshold=0.25, balance="smote", ratio=0.6, fit_on=fit_on)
    train, test = array(done.train.filter("synthetic IS NULL")), array(done.test)
    assert train.shape[1] == test.shape[1] == 4 and not np.isnan(train).any() and not np.isnan(test).any()
    assert np.allclose(train.mean(axis=0), 0) and np.allclose(train.std(axis=0), 1)
    counts = {r.label: r["count"] for r in done.train.groupBy("label").count().collect()}
    assert counts[0] == max(counts[0], int(0.6 * counts[1]))


def test_prepare_labelled(spark):
    index = spark.createDataFrame([(f"s{i}", i) for i in range(4)], "CpG_probe_id string, idx int")
    m = frame(spark, gappy(20, 4, 0.05), [1, None] * 10)
    m = m.withColumn("features", F.transform("features", lambda x, i: F.when(i != 2, x)))
    out, left = preparation.prepare_labelled(m, index, threshold=0.5, fill="mean")
    assert [tuple(r) for r in left.orderBy("idx").select("CpG_probe_id", "idx").collect()] == [("s0", 0), ("s1", 1), ("s3", 2)]
    assert out.count() == 10 and dict(out.dtypes)["label"] == "int"


def test_synthetic_rows_take_part_in_folds_and_splits(spark):
    rows = frame(spark, np.random.default_rng(1).normal(size=(40, 3)), [1] * 32 + [0] * 8)
    for kind in ("bigint", "string"):
        m = balance.smote(rows.withColumn("id", F.col("id").cast(kind)), ratio=0.6)
        n = m.count()
        assert n > 40 and m.select("id").distinct().count() == n and m.filter("id IS NULL").count() == 0
        folds = split.stratified_folds(m)
        assert folds.count() == n
        marked = split.split_ordered(m)
        assert marked.filter("is_test").count() == -(-3 * n // 10)
        assert split.split_exact(m).filter("is_test").count() == -(-3 * n // 10)


def test_ids_must_be_known(spark):
    m = spark.createDataFrame([(None, 1, [1.0]), (2, 0, [2.0])], "id bigint, label int, features array<double>")
    for way in (split.split_exact, split.split_ordered, split.split_hash, split.stratified_folds, balance.undersample):
        with pytest.raises(Exception, match="without an id"):
            way(m).collect()


def test_nan_is_filled(spark):
    m = spark.createDataFrame([(1, 0, [1.0, float("nan")]), (2, 0, [3.0, 4.0]), (3, 0, [float("nan"), 8.0])],
                              "id bigint, label int, features array<double>")
    for fill, expected in (("mean", 6.0), ("zero", 0.0), ("knn", 4.0)):
        got = {r["id"]: r["features"] for r in impute.impute(m, fill).collect()}
        assert got[1] == [1.0, expected], fill


def test_knn_work_arrays_do_not_grow_with_the_block():
    """A block of many rows is compared tile by tile: numpy's peak is far below one array of block by step."""
    x, donors = gappy(6000, 8, 0.1, seed=7), gappy(2048, 8, 0.1, seed=8)
    block = neighbours.QueryBlock(np.arange(6000), x, 3, True)
    tracemalloc.start()
    block.offer(np.arange(6000, 8048), donors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 2048 * 8
    few = neighbours.QueryBlock(np.arange(300, 340), x[300:340], 3, True)
    few.offer(np.arange(6000, 8048), donors)
    whole, part = block.answers(), few.answers()
    mine = (whole["id"] >= 300) & (whole["id"] < 340)
    assert all((whole[n][mine] == part[n]).all() for n in part)


def test_knn_blocks_are_bounded_for_any_width():
    for width in (0, 1, 64, 5000, 1_000_000):
        rows = neighbours.block_rows_for(width)
        assert rows <= neighbours.BLOCK_ROWS and (rows == 64 or rows * width * 32 <= 512 << 20)
