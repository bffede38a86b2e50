import random
from urllib.parse import parse_qsl

import pytest
from pyspark.sql import functions as F

from longloom.operators import adlog, metrics, profile
from longloom.plans import registry, training

LOG = ("UniqueIdentifier bigint, AllRequestKv string, EventName string, AdDuration bigint, AdsSelected bigint, "
       "MaxAds bigint, MaxDuration bigint")


def brute_ids(rows):
    ids = {}
    for r in rows:
        if r[1]:
            found = dict(parse_qsl(r[1])).get("am_crmid")
            if found:
                ids[r[0]] = min(found, ids.get(r[0], found))
    return ids


def brute_metrics(rows):
    ids, sums = brute_ids(rows), {}
    for uid, _, event, duration, selected, most, length in rows:
        if uid in ids:
            add = [most, selected, duration, length, int(event == "defaultImpression"), int(event == "_q_complete")]
            old = sums.setdefault(ids[uid], [0] * 6)
            sums[ids[uid]] = [a + (b or 0) for a, b in zip(old, add)]
    return {k: (*v, 1 - v[5] / v[4] if v[4] else None, v[1] / v[0] if v[0] else None) for k, v in sums.items()}


def log_rows(n=400, hot=0.4, seed=1):
    rng = random.Random(seed)
    kvs = [None, "", "a=1", "am_crmid=", "am_crmid=u%2D1&b=2", "x=1&am_crmid=u-2", "am_crmid=u-3&am_crmid=u+4", "am_crmid"]
    number = lambda: rng.choice([None, 0, 1, 5, 30])
    return [(7 if rng.random() < hot else rng.choice([None] * 9 + list(range(10, 90))), rng.choice(kvs),
             rng.choice(["defaultImpression", "_q_complete", "click", None]), number(), number(), number(), number())
            for _ in range(n)]


def test_ad_metrics_matches_brute_force(spark):
    rows = log_rows()
    got = {r[0]: tuple(r)[1:] for r in adlog.ad_metrics(spark.createDataFrame(rows, LOG)).collect()}
    want = brute_metrics(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_first_match_keeps_every_row(spark):
    rows = log_rows()
    ids = brute_ids(rows)
    assert None in ids  # rows without a request number are one request
    joined = adlog.attach_first_id(spark.createDataFrame(rows, LOG)).collect()
    assert len(joined) == len(rows)
    assert all(r.FreewheelId == ids.get(r.UniqueIdentifier) for r in joined)


def test_request_ids_are_distinct_pairs(spark):
    rows = log_rows()
    pairs = {(r[0], dict(parse_qsl(r[1])).get("am_crmid")) for r in rows if r[1]}
    got = [tuple(r) for r in adlog.request_ids(spark.createDataFrame(rows, LOG)).collect()]
    assert len(got) == len(pairs) and set(got) == pairs


def test_zero_denominators(spark):
    rows = [(1, "am_crmid=x", "click", 1, 2, None, 3)]
    r = adlog.ad_metrics(spark.createDataFrame(rows, LOG)).first()
    assert r.MaxAds == 0 and r.PercentExitAdBreaks is None and r.AdServedVSAdRequested is None
    assert adlog.ad_metrics(spark.createDataFrame([], LOG)).count() == 0


def brute_f1(pairs, c):
    tp = sum(a == b == c for a, b in pairs)
    fp = sum(b == c != a for a, b in pairs)
    fn = sum(a == c != b for a, b in pairs)
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def test_f1_and_confusion(spark):
    rng = random.Random(4)
    pairs = [(rng.choice([0, 1, 1, 2]), rng.choice([0, 1, 3])) for _ in range(200)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    assert metrics.f1_binary(df).first().f1 == pytest.approx(brute_f1(pairs, 1))
    weighted = sum(brute_f1(pairs, c) * sum(a == c for a, _ in pairs) for c in {0, 1, 2}) / 200
    assert metrics.f1_weighted(df).first()[0] == pytest.approx(weighted)
    cells = {(r.label, r.prediction): r.rows for r in metrics.confusion(df, [0, 1, 2, 3]).collect()}
    assert len(cells) == 16 and all(cells[a, b] == pairs.count((a, b)) for a, b in cells)
    assert metrics.accuracy(df).first().accuracy == pytest.approx(sum(a == b for a, b in pairs) / 200)


def accuracy_of(spark, value):
    return spark.createDataFrame([(100, value)], "rows bigint, accuracy double")


@pytest.mark.parametrize("now,before,want", [
    (0.6, None, True), (0.59, None, False), (0.7, 0.7, True), (0.7, 0.8, False), (0.5, 0.4, False), (None, None, False)])
def test_bless(spark, now, before, want):
    baseline = None if before is None else accuracy_of(spark, before)
    assert metrics.bless(accuracy_of(spark, now), baseline).first().blessed is want


def test_profile(spark):
    df = spark.createDataFrame([(1, 2.0, "ab", True), (None, 0.0, None, False), (3, 4.0, "c", None)],
                               "i int, x double, s string, b boolean")
    got = {r.column: r for r in profile.profile(df).collect()}
    assert (got["i"].missing, got["i"].mean, got["i"].min, got["i"].max) == (1, 2.0, 1.0, 3.0)
    assert got["x"].zeros == 1 and got["s"].avg_length == 1.5 and got["s"].type == "STRING"
    assert got["b"].type == "BOOL" and got["b"].mean == 0.5


def test_quantiles_and_top_values(spark):
    df = spark.range(1001).withColumn("k", F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")))
    q = {r.probability: r.value for r in profile.profile_quantiles(df).collect()}
    assert q[0.5] == pytest.approx(500, abs=1)
    top = profile.top_values(df, ["k"], 2).orderBy("rank").collect()
    assert [(r.value, r.rows, r["rank"]) for r in top] == [("hot", 700, 1), ("1000", 1, 2)]
    assert profile.distinct_counts(df, ["id", "k"]).orderBy("column").collect()[0].distinct_values == 1001


def test_schema_and_anomalies(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"text {i}") for i in range(60)], "n int, k string, t string")
    schema = profile.infer_schema(df)
    rows = {r.column: r for r in schema.collect()}
    assert rows["k"].domain == ["a", "b"] and rows["t"].domain is None and rows["n"].required
    assert profile.anomalies(df, schema).count() == 0
    bad = df.select(F.lit("x").alias("k"), F.col("n").cast("double").alias("n"), F.lit(1).alias("extra"))
    found = {(r.column, r.anomaly, r.rows) for r in profile.anomalies(bad, schema).collect()}
    assert found == {("t", "missing_column", 0), ("extra", "new_column", 0), ("n", "type_change", 0),
                     ("k", "unexpected_value", 60)}


def two_clusters(spark, n=80):
    rng = random.Random(0)
    rows = [(i, i % 2, [rng.gauss(3 * (i % 2), 1), rng.gauss(0, 1)]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, label int, features array<double>")


def test_train_save_score_publish(spark, tmp_path):
    m = two_clusters(spark)
    model = training.fit(training.boosted_trees(n_estimators=3, max_depth=2), m)
    scored = training.score(model, m)
    assert scored.columns == ["id", "label", "prediction", "probability"]
    quality = metrics.accuracy(scored)
    assert quality.first().accuracy > 0.8
    log, path = str(tmp_path / "registry"), str(tmp_path / "serving")
    assert registry.publish_if_blessed(model, metrics.bless(quality), log, "m", path)
    refused = metrics.bless(quality.withColumn("accuracy", F.lit(0.1)))
    assert not registry.publish_if_blessed(model, refused, log, "m", str(tmp_path / "never"))
    runs = spark.read.parquet(log)
    assert runs.count() == 2 and registry.latest_blessed(runs).first().uri == path
    again = training.score(registry.load_model(path), m)
    assert again.exceptAll(scored).isEmpty()


def test_searches(spark):
    m = two_clusters(spark)
    cv = training.grid_search(m, {"max_depth": [1, 2], "n_estimators": [2]}, folds=2)
    assert len(cv.avgMetrics) == 2 and max(cv.avgMetrics) > 0.8
    draws = training.draw_params(50)
    assert draws == training.draw_params(50)
    assert all(10 <= d["n_estimators"] <= 1000 and 0.001 <= d["gamma"] <= 10 for d in draws)


def test_estimator_parameters():
    trees = training.boosted_trees(max_depth=30, min_child_weight=0.2, colsample=1)
    assert trees.getMaxDepth() == 30 and trees.getMinInstancesPerNode() == 1
    assert trees.getFeatureSubsetStrategy() == "all"
    assert training.neural_net(10).getLayers() == [10, 16, 8, 2]


def test_accuracy_counts_missing_predictions_as_wrong(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (1, 0), (1, 1)], "label int, prediction int")
    assert metrics.accuracy(df).first().asDict() == {"rows": 4, "accuracy": 0.5}


def test_profile_of_every_type(spark):
    df = spark.sql("""SELECT * FROM VALUES (DATE'1970-01-02', TIMESTAMP'1970-01-01 00:01:00', array(1, 2), map('a', 1), true),
        (DATE'1970-01-04', NULL, NULL, map(), false) AS t(d, ts, a, m, b)""")
    got = {r["column"]: r for r in profile.profile(df).collect()}
    assert (got["d"].type, got["d"].min, got["d"].max) == ("DATE", 86400.0, 259200.0)
    assert (got["ts"].type, got["ts"].mean, got["ts"].missing) == ("TIMESTAMP", 60.0, 1)
    assert (got["a"].type, got["a"].avg_length, got["m"].avg_length) == ("ARRAY", 2.0, 0.5)
    lost = profile.anomalies(df.drop("d", "m"), profile.infer_schema(df)).collect()
    assert {(r["column"], r.anomaly) for r in lost} >= {("d", "missing_column"), ("m", "missing_column")}
    quantiles = {(r["column"], r.probability): r.value for r in profile.profile_quantiles(df, (0.5,)).collect()}
    assert quantiles["d", 0.5] == 86400.0
