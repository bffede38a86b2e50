from urllib.parse import parse_qsl

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from longloom.functions import hashing, kv, labels, numeric


def values(df):
    return [tuple(r) for r in df.collect()]


def test_sample_status_covers_every_code(spark):
    codes = ["00", "01", "09", "10", "19", "20", "0A", "99"]
    df = spark.createDataFrame([(f"TCGA-HC-0001-{c}A",) for c in codes] + [(None,), ("short",)], "b string")
    got = {r[0]: r[1] for r in df.select("b", labels.sample_status(F.col("b"))).collect()}
    want = dict(zip(codes, ["control", "tumor", "tumor", "normal", "normal", "control", "control", "control"]))
    assert {c: got[f"TCGA-HC-0001-{c}A"] for c in codes} == want
    assert got[None] == got["short"] == "control"


@pytest.mark.parametrize("text,want", [
    ("a=1&am_crmid=x=y", "x=y"), ("am_crmid=", None), ("am_crmid=o&am_crmid=u%2D7", "u-7"), ("am_crmid", None),
    ("am_crmid=z&am_crmid=", "z"), (None, None), ("", None), ("am_crmid=100%&b=1", "100%"), ("am_crmid=a+b", "a b"),
    ("am%5Fcrmid=k", "k"), ("am_crmid=%zz%41", "%zzA"), ("am_crmid=1&am%5Fcrmid=2", "2"), ("xam_crmid=1", None),
    ("am%5Fcrmid=1&am_crmid=2", "2"), ("a=am_crmid=3", None), ("am_crmid=l1%0Al2&z", "l1\nl2"), ("&&am_crmid=5&", "5"),
    ("am_crmid=\n&b=1", "\n"), ("b+c=1&am_crmid=6", "6"), ("am_crmid==", "="), ("am_crmid=%C3%A9", "é"),
])
def test_query_param(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(kv.query_param(F.col("t"), "am_crmid")).first()[0] == want
    assert dict(parse_qsl(text or "")).get("am_crmid") == want


def test_truthy(spark):
    df = spark.createDataFrame([("x",), ("",), (None,)], "t string")
    assert [r.t for r in df.filter(kv.truthy(F.col("t"))).collect()] == ["x"]


def test_null_safe_arithmetic(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (3, None)], "a bigint, b bigint")
    got = values(df.select(numeric.ratio(F.col("a"), F.col("b")), numeric.one_minus_ratio(F.col("a"), F.col("b"))))
    assert got == [(0.5, 0.5), (None, None), (None, None), (None, None)]
    sums = df.groupBy().agg(numeric.null_skipping_sum(F.col("a"))).first()[0]
    assert sums == 5
    assert df.filter("a IS NULL").agg(numeric.null_skipping_sum(F.col("a"))).first()[0] == 0


def test_event_indicator_and_nan(spark):
    df = spark.createDataFrame([("k",), ("x",), (None,)], "e string")
    assert [r[0] for r in df.select(numeric.event_indicator(F.col("e"), "k")).collect()] == [1, 0, 0]
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in nan.select(numeric.nan_to_null(F.col("x"))).collect()] == [None, 1.0, None]
    assert numeric.derived_names(["a", "b"]) == ["a_xf", "b_xf"]


def test_stage_classes():
    assert labels.stage_classes("pathologic_M") == ["stage_0", "stage_1"]
    assert labels.stage_classes("pathologic_stage") == [f"stage_{i}" for i in range(6)]


def test_stage_class_and_override(spark):
    df = spark.createDataFrame([("01", "Stage IIIC"), ("11", "Stage IV"), ("0A", "Stage I"), ("09", None),
                                ("02", "Stage ?")], "code string, stage string")
    stage = labels.stage_class(labels.stage_of_sample(F.col("code"), F.col("stage")), "pathologic_stage")
    assert [r[0] for r in df.select(stage).collect()] == ["stage_3", "stage_0", "stage_0", None, None]


def test_encode_label_policies(spark):
    df = spark.createDataFrame([("tumor",), ("normal",), ("control",), (None,)], "s string")
    classes = {"tumor": 1, "normal": 0}
    assert [r.label for r in labels.encode_label(df, "s", classes).collect()] == [1, 0]
    assert [r.label for r in labels.encode_label(df, "s", classes, unknown="null").collect()] == [1, 0, None, None]
    with pytest.raises(PySparkException, match="unknown label"):
        labels.encode_label(df, "s", classes, unknown="error").collect()
    with pytest.raises(ValueError):
        labels.encode_label(df, "s", classes, unknown="other")


def test_hash_is_portable_and_uniform(spark):
    import hashlib
    want = int(hashlib.md5(b"42:123").hexdigest()[:8], 16)
    df = spark.range(20000)
    assert df.filter("id = 42").select(hashing.hash32("id", 123)).first()[0] == want
    kept = hashing.hash_sample(df, "id", 0.25).count()
    assert abs(kept - 5000) < 300
    assert hashing.hash_sample(df, "id", 0.25).exceptAll(hashing.hash_sample(df, "id", 0.25)).isEmpty()


def test_moments_and_shares(spark):
    from datetime import datetime

    from longloom.functions.dates import exceeds_share, moment_parts

    df = spark.createDataFrame([(datetime(2024, 3, 3, 23, 59, 59, 900000), 21.0, 100.0), (datetime(1969, 12, 31, 0, 0, 1), 20.0, 100.0),
                                (None, None, 1.0)], "t timestamp, a double, b double")
    got = df.select(*[c.alias(n) for n, c in moment_parts(F.col("t")).items()], exceeds_share(F.col("a"), F.col("b"), 0.2).alias("x")).collect()
    assert [tuple(r) for r in got] == [(3, 23, 1, 1709510399, 1), (12, 0, 4, -86399, 0), (None, None, None, None, 0)]
