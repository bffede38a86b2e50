import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from longloom.catalog import inputs
from longloom.operators import joins, measurements, numbering, pivot, ranking

METH = "case_barcode string, aliquot_barcode string, probe_id string, beta_value double"


@pytest.fixture
def tables(spark):
    meth = spark.createDataFrame([
        ("TCGA-AA-0002", "TCGA-AA-0002-01A", "cg1", 0.5), ("TCGA-AA-0001", "TCGA-AA-0001-11A", "cg1", 0.1),
        ("TCGA-AA-0001", "TCGA-AA-0001-11A", "cg2", None), ("TCGA-AA-0003", "TCGA-AA-0003-20A", "cg9", 0.9),
        (None, None, "cg2", 0.7)], METH)
    annotation = spark.createDataFrame([("cg1",), ("cg2",), ("cg2",), ("cg3",)], "Name string")
    gdc = spark.createDataFrame([("cg1",), ("cg1",), ("cg1",), ("cg2",)], "CpG_probe_id string")
    return meth, annotation, gdc


def test_betas_equal_the_three_way_join(tables):
    meth, annotation, gdc = tables
    plain = annotation.join(meth, annotation.Name == meth.probe_id).join(gdc, gdc.CpG_probe_id == annotation.Name)
    got = measurements.build_betas(*tables)
    columns = ["case_barcode", "aliquot_barcode", "CpG_probe_id", "beta_value"]
    assert got.select(columns).exceptAll(plain.select(columns)).isEmpty()
    assert got.count() == plain.count() == 3 + 3 + 2 + 2


def test_numbers_cover_unannotated_participants_and_null(tables):
    rows = measurements.build_betas(*tables).select("case_barcode", "row_number", "sample_status").distinct().collect()
    # NULL is numbered first and never joined
    assert {(r[0], r[1], r[2]) for r in rows} == {
        ("TCGA-AA-0001", 2, "normal"), ("TCGA-AA-0002", 3, "tumor"), (None, None, "control")}


def test_empty_measurements(spark, tables):
    empty = spark.createDataFrame([], METH)
    betas = measurements.build_betas(empty, *tables[1:])
    assert betas.count() == 0
    assert ranking.rank_sites(betas).count() == 0


def test_large_lookup_is_not_broadcast(spark):
    df = spark.range(10)
    assert "broadcast" in joins.broadcast_if_small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.broadcast_if_small(df, 9)._jdf.queryExecution().logical().toString().lower()


@pytest.mark.parametrize("partitions", [1, 7])
def test_ordered_index_is_dense_and_sorted(spark, partitions):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad("id", 5, "0")).alias("k")).repartition(partitions)
    got = numbering.ordered_index(df, "k").orderBy("k").collect()
    assert [r.row_number for r in got] == list(range(1, 1001))


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_hash_rank_is_dense_within_skewed_groups(spark, bits):
    df = spark.range(900).withColumn("g", F.when(F.col("id") < 600, "hot").when(F.col("id") < 890, "cold"))
    got = numbering.hash_rank(df, "id", "s", by="g", bits=bits)
    spans = got.groupBy("g").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.count("*")).collect()
    assert {tuple(r) for r in spans} == {("hot", 1, 600, 600, 600), ("cold", 1, 290, 290, 290), (None, 1, 10, 10, 10)}


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_hash_cut_takes_exact_quota(spark, bits):
    from longloom.functions.hashing import hash32
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    quota = spark.createDataFrame([(0, 50), (1, 0), (2, 166)], "g bigint, quota bigint")
    cuts = {r.g: (r.cut_hash, r.cut_id) for r in numbering.hash_cut(df, "id", "s", quota, by="g", bits=bits).collect()}
    rows = [(r.g, r.h, r.id) for r in df.withColumn("h", hash32("id", "s")).collect()]
    assert set(cuts) == {0, 2}
    for g, n in ((0, 50), (2, 166)):
        assert sum((h, i) <= cuts[g] for g2, h, i in rows if g2 == g) == n


BETAS = "CpG_probe_id string, aliquot_barcode string, sample_status string, beta_value double"


def betas_frame(spark):
    rows = []
    for i, status in enumerate(["tumor"] * 4 + ["normal"] * 3 + ["control"]):
        rows += [("full", f"a{i}", status, 0.1 * i), ("flat", f"a{i}", status, 0.5)]
        rows.append(("gappy", f"a{i}", status, None if i % 2 else 0.3))
        if status != "normal":
            rows.append(("no_normal", f"a{i}", status, 0.2 * i))
    return spark.createDataFrame(rows, BETAS)


def brute_scores(rows, classes):
    scores = {}
    for site in {r[0] for r in rows}:
        def mean(keep):
            found = [r[3] for r in rows if r[0] == site and r[3] is not None and keep(r)]
            return sum(found) / len(found) if found else None
        overall = mean(lambda r: True)
        means = [mean(lambda r, c=c: r[2] == c) for c in classes]
        scores[site] = round(sum((m - overall) ** 2 for m in means if m is not None), 9)
    return scores


def test_rank_sites_matches_brute_force(spark):
    df = betas_frame(spark)
    rows = [tuple(r) for r in df.collect()]
    got = {r[0]: r[1] for r in ranking.rank_sites(df, min_coverage=0.0).collect()}
    assert got == pytest.approx(brute_scores(rows, ["tumor", "normal"]))


def test_coverage_counts_values_or_rows(spark):
    df = betas_frame(spark)
    kept = lambda **o: {r[0] for r in ranking.rank_sites_grouped(df, ["tumor", "normal"], **o).collect()}
    assert {r[0] for r in ranking.rank_sites(df).collect()} == {"full", "flat"}
    assert kept() == {"full", "flat", "gappy"}
    assert kept(count_nulls=False, min_coverage=0.5) == {"full", "flat", "no_normal"}
    assert kept(count_nulls=False, min_coverage=0.5, inclusive=True) == {"full", "flat", "gappy", "no_normal"}


def test_rank_order_ties_and_limit(spark):
    df = betas_frame(spark)
    got = [r[0] for r in ranking.rank_sites(df, min_coverage=0.0).collect()]
    assert got[-2:] == ["flat", "gappy"]  # both 0, by name
    assert [r[0] for r in ranking.rank_sites(df, k=2, min_coverage=0.0).collect()] == got[:2]


def test_participants_override(spark):
    df = betas_frame(spark)
    few = spark.createDataFrame([("x",), ("y",)], "aliquot_barcode string")
    assert ranking.rank_sites(df, participants=few).count() == 4


def test_weight_equals_repeated_rows(spark):
    df = betas_frame(spark).withColumn("copies", F.when(F.col("aliquot_barcode") == "a1", 3).otherwise(1).cast("bigint"))
    options = dict(classes=["tumor", "normal"], count_nulls=False)
    weighted = ranking.group_means(df, weight="copies", **options)
    repeated = ranking.group_means(joins.fan_out(df), **options)
    a = {r[0]: [x if x is None else round(x, 9) for x in r[1:]] for r in weighted.collect()}
    b = {r[0]: [x if x is None else round(x, 9) for x in r[1:]] for r in repeated.collect()}
    assert a == b


def test_ranking_plan(spark, sf_dir):
    plan = ranking.rank_sites(inputs.labelled(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SortMergeJoin" not in plan


def test_pivots_agree_with_long_form(spark):
    df = betas_frame(spark).filter("CpG_probe_id <> 'gappy'")
    sites = spark.createDataFrame([("full",), ("no_normal",), ("unseen",)], "CpG_probe_id string")
    index = pivot.site_index(sites)
    long = {(r[1], r[0]): r[3] for r in df.collect()}
    names = {r.idx: r.CpG_probe_id for r in index.collect()}
    assert names == {0: "full", 1: "no_normal", 2: "unseen"}
    for r in pivot.pivot_vector(df, index).collect():
        assert r.features == [long.get((r.aliquot_barcode, names[i])) for i in range(3)]
    wide = pivot.pivot_wide(df, sites)
    assert wide.columns == ["aliquot_barcode", "full", "no_normal", "unseen"]
    for r in wide.collect():
        assert [r.full, r.no_normal, r.unseen] == [long.get((r.aliquot_barcode, names[i])) for i in range(3)]


def test_strict_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([("s", "a", "tumor", 0.5), ("s", "a", "tumor", 0.7)], BETAS)
    index = pivot.site_index(df.select("CpG_probe_id").distinct())
    with pytest.raises(PySparkException, match="duplicate cell"):
        pivot.pivot_vector(df, index).collect()
    assert pivot.pivot_vector(df, index, on_duplicate="sum").first().features == [1.2]
    assert pivot.pivot_vector(df, index, on_duplicate="avg").first().features == [0.6]
    assert pivot.pivot_sum(df, ["aliquot_barcode"], "CpG_probe_id", "beta_value").first().s == 1.2


def test_two_labels_give_two_rows(spark):
    df = spark.createDataFrame([("s", "a", "tumor", 0.5), ("t", "a", "normal", 0.7)], BETAS)
    rows = pivot.pivot_vector(df, pivot.site_index(df.select("CpG_probe_id"))).collect()
    assert sorted((r.sample_status, tuple(r.features)) for r in rows) == [
        ("normal", (0.5, 0.7)), ("tumor", (0.5, 0.7))]
    wide = pivot.pivot_sum(df, ["aliquot_barcode"], "CpG_probe_id", "beta_value")
    assert pivot.labelled_pivot(wide, df).count() == 2


def test_wide_pivot_has_a_column_for_each_of_many_sites(spark):
    sites = spark.range(1500).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("CpG_probe_id"))
    sites = sites.unionByName(betas_frame(spark).select("CpG_probe_id").distinct())
    out = pivot.pivot_wide(betas_frame(spark), sites)
    assert len(out.columns) == 1 + sites.count()


def test_pivot_sum_has_all_columns_unless_told(spark):
    df = spark.range(150).select(F.lit("r").alias("r"), F.format_string("c%03d", "id").alias("c"), F.lit(1.0).alias("x"))
    assert len(pivot.pivot_sum(df, ["r"], "c", "x").columns) == 151


def test_vector_pivot_uses_plain_aggregates_for_cells(spark, capsys):
    df = betas_frame(spark)
    pivot.pivot_vector(df, pivot.site_index(df.select("CpG_probe_id").distinct()), on_duplicate="avg").explain()
    assert capsys.readouterr().out.count("ObjectHashAggregate") <= 2  # the two halves of collecting a row's cells


def test_nan_is_missing(spark):
    df = betas_frame(spark)
    worse = df.withColumn("beta_value", F.when(F.col("beta_value").isNull(), F.lit(float("nan"))).otherwise(F.col("beta_value")))
    a, b = (ranking.group_means(d, ["tumor", "normal"]).orderBy("CpG_probe_id").collect() for d in (df, worse))
    assert a == b


def test_pivot_sum_takes_first_columns_and_limit(spark):
    out = pivot.pivot_sum(betas_frame(spark), ["aliquot_barcode"], "CpG_probe_id", "beta_value", max_columns=2, limit=3)
    assert out.columns == ["aliquot_barcode", "flat", "full"]
    assert out.count() == 3
