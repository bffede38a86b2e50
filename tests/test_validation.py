import math

import pytest
from pyspark.sql import functions as F

from longloom.operators import drift, metrics, profile, sketches


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(9000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 1000) / 8.0).otherwise(float("nan")).alias("x"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), (F.col("id") % 12).cast("string"))).alias("t"), (F.col("id") % 2 == 0).alias("b"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("d"), F.array(F.col("id")).alias("a"),
        F.lit(None).cast("double").alias("none"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("many"))


def test_merged_is_like_one(spark, rows, tmp_path):
    for i in range(3):
        sketches.sketch_columns(rows.filter(F.xxhash64("n") % 3 == i)).write.parquet(str(tmp_path / f"slice={i}"))
    sketches.sketch_columns(rows.filter(F.xxhash64("n") % 3 < 0)).write.parquet(str(tmp_path / "slice=rest"))
    merged = sketches.merge_sketches(spark.read.parquet(str(tmp_path)).drop("slice"))
    found = {r["column"]: r for r in sketches.sketched_profile(merged).collect()}
    exact = {r["column"]: r for r in profile.profile(rows.withColumn("x", F.nanvl("x", F.lit(None)))).collect()}
    for name, own in exact.items():
        got = found[name]
        assert (got["type"], got["rows"], got["missing"], got["zeros"]) == (own["type"], own["rows"], own["missing"], own["zeros"] or 0)
        for m in ("mean", "std", "min", "max"):
            assert got[m] == (None if own[m] is None else pytest.approx(own[m], rel=1e-9))
    for name in ("n", "x", "d"):
        values = sorted(r[0] for r in rows.select(profile._as_number(F.col(name), profile._kind(rows.schema[name].dataType))).collect()
                        if r[0] is not None and r[0] == r[0])
        for p, q in zip((0.25, 0.5, 0.75), found[name]["quantiles"]):
            assert sum(v < q for v in values) - 0.02 * len(values) <= p * len(values) <= sum(v <= q for v in values) + 0.02 * len(values)
        rank = sketches.rank_of(merged, name, values[len(values) // 3]).first()["rank"]
        assert rank == pytest.approx(1 / 3, abs=0.02)
    assert found["none"]["quantiles"] is None and found["a"]["quantiles"] is None and found["t"]["quantiles"] is None
    assert found["many"]["distinct_values"] == pytest.approx(9000, rel=0.05) and found["t"]["distinct_values"] == 12
    top = {x["item"]: x["count"] for x in sketches.sketched_profile(merged, top=20).filter("column = 't'").first()["top_values"]}
    assert top == {r["t"]: r["count"] for r in rows.filter("t IS NOT NULL").groupBy("t").count().collect()}
    schema = {r["column"]: (r["type"], r["required"], r["domain"]) for r in sketches.sketched_schema(merged).collect()}
    plain = {r["column"]: (r["type"], r["required"], r["domain"]) for r in profile.infer_schema(rows).collect()}
    assert schema.pop("x") == ("FLOAT", False, None) and plain.pop("x") and schema == plain


def test_sketches_of_nothing(spark, rows):
    empty = sketches.merge_sketches(sketches.sketch_columns(rows.limit(0)))
    found = {r["column"]: r for r in sketches.sketched_profile(empty).collect()}
    assert found["x"]["rows"] == 0 and found["x"]["quantiles"] is None and found["t"]["distinct_values"] == 0
    one, two = (sketches.sketch_columns(rows.select(F.col("n").cast(k).alias("n"))) for k in ("string", "long"))
    mixed = sketches.sketched_profile(sketches.merge_sketches(one.unionByName(two))).first()
    assert mixed["type"] == "INT|STRING" and mixed["rows"] == 18_000 and mixed["distinct_values"] == pytest.approx(9000, rel=0.05)


def plain_distance(a, b, kind, bins=4):
    a, b = ([v for v in x if v is not None and v == v] for x in (a, b))
    if kind == "texts":
        return max(abs(a.count(v) / len(a) - b.count(v) / len(b)) for v in {*a, *b})
    low, high = min(a + b), max(a + b)
    def share(x):
        cells = [min(bins - 1, math.floor((v - low) / (high - low) * bins)) if high > low else 0 for v in x]
        return [cells.count(i) / len(x) for i in range(bins)]
    total = 0.0
    for p, q in zip(share(a), share(b)):
        m = (p + q) / 2
        total += sum(s * math.log2(s / m) / 2 for s in (p, q) if s)
    return total


def test_distances(spark):
    left = [(1.0, "a", True, 3), (2.0, "a", False, 3), (None, None, True, 3), (9.0, "b", True, 3), (float("nan"), "c", None, 3)]
    right = [(1.0, "a", True, 3), (8.5, "b", True, 3), (10.0, "d", True, 3)]
    kinds = "x double, t string, b boolean, same int"
    one, two = spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds)
    schema = drift.with_thresholds(profile.infer_schema(one), {"x": 0.2, "t": 0.9, "b": 0.1, "same": 0.0})
    got = {r["column"]: r for r in drift.drift(one, two, schema, bins=4).collect()}
    for i, (name, kind) in enumerate((("x", "numbers"), ("t", "texts"), ("b", "texts"), ("same", "numbers"))):
        expected = plain_distance([r[i] for r in left], [r[i] for r in right], kind)
        assert got[name]["distance"] == pytest.approx(expected) and got[name]["drifted"] == (expected > got[name]["threshold"])
    assert not got["same"]["drifted"] and got["b"]["comparator"] == "l_infinity"
    nothing = {r["column"]: r for r in drift.drift(one, two.limit(0), schema).collect()}
    assert all(r["distance"] is None and r["drifted"] for r in nothing.values())
    assert drift.drift(one, two, drift.with_thresholds(profile.infer_schema(one), {"x": 1.0})).count() == 1
    assert drift.distances(one, two, {}).count() == 0
    with pytest.raises(ValueError, match="no column"):
        drift.with_thresholds(schema, {"zz": 0.1})
    with pytest.raises(ValueError, match="both sides"):
        drift.drift(one, two.drop("t"), schema)
    with pytest.raises(ValueError, match="cannot be compared"):
        drift.with_thresholds(profile.infer_schema(one.select(F.array("x").alias("a"))), {"a": 0.1})


def test_accuracy_of_several_slicings(spark):
    rows = spark.createDataFrame([(1, 1, "en", "a"), (1, None, "en", "b"), (0, 1, "fr", "a"), (0, 0, None, "a"), (None, 0, "en", "a")],
                                 "label int, prediction int, lang string, source string")
    got = {(r["slicing"], r["lang"], r["source"]): (r["rows"], round(r["accuracy"], 4)) for r in
           metrics.accuracy_slices(rows, [[], ["lang"], ["lang", "source"]]).collect()}
    assert got[("overall", None, None)] == (5, 0.4) and got[("lang", "en", None)] == (3, 0.3333) and got[("lang", None, None)] == (1, 1.0)
    assert got[("lang,source", "en", "b")] == (1, 0.0) and len(got) == 1 + 3 + 4
    assert metrics.accuracy_slices(rows, [[]]).collect()[0][1:] == (5, 0.4)
    plan = metrics.accuracy_slices(rows, [[], ["lang"]])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_f1_counts_missing_predictions(spark):
    rows = spark.createDataFrame([(1, 1), (1, None), (0, 1), (0, 0)], "label int, prediction int")
    got = metrics.f1_binary(rows).first()
    assert (got["tp"], got["fp"], got["fn"], got["f1"]) == (1, 1, 1, 0.5)
    missing_label = metrics.f1_binary(spark.createDataFrame([(None, 1), (1, 1)], "label int, prediction int")).first()
    assert (missing_label["tp"], missing_label["fp"], missing_label["fn"]) == (1, 1, 0)
