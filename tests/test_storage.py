import re

import pytest
from pyspark.sql import functions as F

from longloom.operators import joins, ranking, slices
from longloom.sources import keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows have one key, some have none."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 7, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
        (F.col("id") * 7 % 1000).alias("x"), F.col("id"))
    return rows


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_keyed_join_is_the_join(spark, facts, how):
    stored = keyed.store_by_key(facts, "k", 8)
    lookup = spark.createDataFrame([("hot", 1), ("hot", 2), ("k5", 3), ("k6", None), ("k6", 4), ("zz", 5), (None, 6)], "k string, y int")
    got, expected = stored.join(lookup, how), facts.join(lookup, "k", how)
    assert sorted(got.columns) == sorted(expected.columns)
    assert got.select(expected.columns).exceptAll(expected).isEmpty() and expected.exceptAll(got.select(expected.columns)).isEmpty()
    assert stored.rows().exceptAll(facts).isEmpty() and stored.rows().count() == 6000


def test_facts_are_not_shuffled(spark, facts):
    stored = keyed.store_by_key(facts, "k", 8)
    joined = stored.join(facts.select("k").distinct().withColumn("y", F.lit(1)))
    text = plan(joined)
    assert "SortMergeJoin" in text and "Exchange" not in text and "SelectedBucketsCount" in text
    files = spark.table(stored.name).groupBy(F.input_file_name().alias("file")).agg(F.count_if(F.col("k") == "hot").alias("hot")).collect()
    assert len(files) <= 8 and max(r["hot"] for r in files) < 1000  # the frequent key, of 2000 rows, is in several buckets
    assert {r["k"] for r in stored.spread.collect()} >= {"hot"} and stored.spread.count() < 8


def test_keyed_odd_tables(spark):
    empty = keyed.store_by_key(spark.createDataFrame([], "k string, x int"), "k", 4)
    lookup = spark.createDataFrame([("a", 1)], "k string, y int")
    assert empty.join(lookup).count() == 0 and empty.join(lookup, "left").columns == ["k", "x", "y"]
    nulls = keyed.store_by_key(spark.createDataFrame([(None, i) for i in range(40)], "k string, x int"), "k", 4)
    assert nulls.join(lookup, "left").count() == 40 and nulls.join(lookup).count() == 0
    with pytest.raises(ValueError):
        empty.join(lookup, "full")
    with pytest.raises(ValueError):
        keyed.store_by_key(lookup.withColumn("_salt", F.lit(1)), "k")


def test_many_copies_of_a_row(spark):
    rows = spark.createDataFrame([("a", 1_000_000), ("b", 1), ("c", 1024), ("d", 1025), ("e", 0)], "k string, copies long")
    out = joins.fan_out(rows)
    assert out.columns == ["k"]
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"a": 1_000_000, "b": 1, "c": 1024, "d": 1025}


def test_bitmaps_count_exactly(spark):
    df = spark.range(200_000).select((F.col("id") * 7 % 70_001).alias("n"), (F.col("id") % 3).cast("string").alias("g"))
    df = df.withColumn("n", F.when(F.col("n") % 10 != 3, F.col("n")))
    maps = slices.bitmaps(df, "n", ["g"])
    got = {r["g"]: r["distinct_count"] for r in slices.count_bitmaps(maps, ["g"]).collect()}
    assert got == {r["g"]: r["c"] for r in df.groupBy("g").agg(F.count_distinct("n").alias("c")).collect()}
    assert slices.count_bitmaps(maps).first()[0] == df.agg(F.count_distinct("n")).first()[0]  # shared numbers count once
    assert slices.count_bitmaps(slices.bitmaps(df.limit(0), "n")).first()[0] == 0
    edge = spark.createDataFrame([(0,), (32_767,), (32_768,), (65_536,), (0,)], "n long")
    assert slices.count_bitmaps(slices.bitmaps(edge, "n")).first()[0] == 4


def test_what_a_bitmap_count_shuffles(spark):
    """The exchange below the count carries buckets and bitmaps, no samples."""
    df = spark.range(100_000).select((F.col("id") % 5000).alias("n"))
    text = plan(slices.count_bitmaps(slices.bitmaps(df, "n")))
    assert re.search(r"hashpartitioning\(bucket|hashpartitioning\(_groupingexpression", text) and "hashpartitioning(n" not in text


def test_numbers_stay(spark):
    first = slices.number_values(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "s string"), "s")
    assert {r["s"]: r["number"] for r in first.collect()} == {"a": 0, "b": 1}
    more = slices.number_values(spark.createDataFrame([("c",), ("a",), ("0",)], "s string"), "s", first)
    assert {r["s"]: r["number"] for r in more.collect()} == {"a": 0, "b": 1, "0": 2, "c": 3}
    none = slices.number_values(spark.createDataFrame([], "s string"), "s", more)
    assert none.count() == 4


def betas(spark, seed=0, n=4000):
    return spark.range(n).select(
        F.concat(F.lit("s"), (F.col("id") % 23).cast("string")).alias("aliquot_barcode"), F.concat(F.lit("cg"), (F.col("id") % 31).cast("string")).alias("CpG_probe_id"),
        F.element_at(F.array(F.lit("tumor"), F.lit("normal"), F.lit("control")), (F.col("id") % 23 % 3 + 1).cast("int")).alias("sample_status"),
        F.when(F.col("id") % 11 != 0, F.round(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000, 3)).otherwise(F.when(F.col("id") % 2 == 0, float("nan"))).alias("beta_value"))


def test_states_rank_like_all_rows(spark, tmp_path):
    rows, store = betas(spark), slices.RankingStore(spark, str(tmp_path / "s"))
    numbers = slices.number_values(rows, "aliquot_barcode")
    for i in range(3):
        store.add(f"part-{i}", rows.filter(F.xxhash64("aliquot_barcode") % 3 == F.lit(i)), numbers)
    store.add("rest", rows.filter(F.xxhash64("aliquot_barcode") % 3 < 0), numbers)
    full = ranking.rank_sites(rows, 20, 0.5)
    assert store.rank(20, 0.5).collect() == full.collect() and full.count() == 20
    means = {r["CpG_probe_id"]: r for r in ranking.group_means(rows, ["tumor", "normal"]).collect()}
    for r in slices.state_means(store.state()).collect():
        own = means[r["CpG_probe_id"]]
        assert r["cpg_count"] == own["cpg_count"] and r["mean_tumor"] == pytest.approx(own["mean_tumor"])


def test_a_slice_is_replaced_and_others_are_not_read(spark, tmp_path):
    store = slices.RankingStore(spark, str(tmp_path / "s"))
    one, wrong, two = betas(spark, 1), betas(spark, 9, 500), betas(spark, 2).withColumn("aliquot_barcode", F.concat("aliquot_barcode", F.lit("x")))
    one.write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    numbers = slices.number_values(one.unionByName(two), "aliquot_barcode")
    store.add("one", one, numbers)
    store.add("two", wrong, numbers)
    store.add("two", two, numbers)
    assert store.rank(10, 0.5).collect() == ranking.rank_sites(one.unionByName(two), 10, 0.5).collect()
    assert not any("/one/" in f and "slice=" not in f for f in store.rank().inputFiles())
    assert store.sample_count().first()[0] == 46
    with pytest.raises(ValueError):
        store.add("a/b", one, numbers)
