import numpy as np
import pytest
from pyspark.sql import functions as F

from longloom.plans import wide_deep as w


def frame(spark, x, y):
    rows = [(i, None if label is None else int(label), [None if v != v else float(v) for v in r]) for i, (r, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, label int, features array<double>").repartition(3)


@pytest.mark.parametrize("wide, deep", [(True, True), (True, False), (False, True)])
def test_gradient_is_the_slope(wide, deep):
    rng = np.random.default_rng(2)
    shape = w.Shape(4, 3, (5, 6), wide, deep, 12)
    own = [v + rng.normal(0, 0.3, v.shape) for v in shape.start(1)]
    x, y = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    cells = w._cells(rng.integers(0, 12, (7, 4)), shape)

    def loss():
        return -np.log(w._softmax(shape.logits(own, x, cells)[0])[np.arange(7), y]).mean()

    grads = shape.gradient(own, x, cells, y)
    assert [g.shape for g in grads] == [v.shape for v in own]
    for v, g in zip(own, grads):
        for at in list(np.ndindex(v.shape))[:40]:
            v[at] += 1e-6
            high = loss()
            v[at] -= 2e-6
            slope = (high - loss()) / 2e-6
            v[at] += 1e-6
            assert g[at] == pytest.approx(slope, abs=1e-5)


@pytest.fixture(scope="module")
def data(spark):
    """Labels that depend on bands of single features, which a linear part over buckets knows and a short net does not."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 5))
    y = (np.abs(x[:, 0]) < 0.6).astype(int) ^ (rng.random(600) < 0.03)
    x[rng.random(x.shape) < 0.05] = np.nan
    return frame(spark, x, y).cache()


def test_together_beats_the_deep_part_alone(spark, data, tmp_path):
    train, test = data.filter("id < 450"), data.filter("id >= 450").withColumn("extra", F.lit("e"))
    both = w.fit(train, steps=300, between=150)
    alone = w.fit(train, steps=300, between=150, wide=False)
    assert both.loss(train) < alone.loss(train) and both.loss(train) < 0.45
    scored = both.score(test)
    assert scored.columns == ["id", "label", "extra", "prediction", "probability"]
    assert scored.filter("label = prediction").count() > 115
    w.save(both, spark, str(tmp_path / "m"))
    again = w.load(spark, str(tmp_path / "m"))
    assert sorted(again.score(test).collect()) == sorted(scored.collect())


def test_runs_repeat_and_tasks_agree(spark, data):
    one, two, single = (w.fit(data, steps=40, between=20, tasks=t) for t in (2, 2, 1))
    assert all((a == b).all() for a, b in zip(one.weights, two.weights))
    assert not (one.weights[0] == single.weights[0]).all()


def test_odd_inputs(spark, data):
    three = spark.createDataFrame([(i, i % 3, [float(i % 3), None]) for i in range(30)] + [(99, None, [1.0, 1.0])], "id long, label int, features array<double>")
    model = w.fit(three, steps=150, tasks=1)
    assert model.shape.classes == 3 and model.score(three.filter("label IS NOT NULL")).filter("label = prediction").count() == 30
    few = w.fit(three.limit(1), steps=4, between=2, tasks=3)  # tasks without rows
    assert np.isfinite(few.weights[0]).all()
    empty = w.fit(three.limit(0), steps=4, tasks=1)
    assert empty.shape.features == 0
    with pytest.raises(ValueError):
        w.fit(three, wide=False, deep=False)
