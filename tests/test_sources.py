import pytest
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longloom import session
from longloom.sources import matrix_csv, tables


def test_parse_schema_and_conform(spark):
    schema = tables.parse_schema("a:STRING, b:FLOAT, c:INTEGER")
    assert [f.dataType for f in schema] == [T.StringType(), T.DoubleType(), T.LongType()]
    df = spark.createDataFrame([("1", 2, "3.5")], "c string, a int, b string")
    assert tables.conform(df, schema).first() == ("2", 3.5, 1)
    with pytest.raises(ValueError, match="DATE"):
        tables.parse_schema("a:DATE")
    with pytest.raises(PySparkException):
        tables.conform(spark.createDataFrame([("x", 1, "1")], "c string, a int, b string"), schema).collect()


def test_replace_and_new(spark, tmp_path):
    target = str(tmp_path / "t")
    tables.replace_table(spark.range(5), target)
    assert tables.replace_table(spark.range(3), target).count() == 3
    with pytest.raises(AnalysisException):
        tables.write_new(spark.range(1), target)
    assert tables.scan_table(spark, target).count() == 3


def test_template_names_are_bound(spark):
    spark.range(4).createOrReplaceTempView("numbers")
    sql = "SELECT count(*) AS n FROM IDENTIFIER(:t) WHERE id >= :low"
    assert tables.query_template(spark, sql, {"t": "numbers"}, {"low": 2}).first().n == 2
    with pytest.raises(PySparkException):
        tables.query_template(spark, sql, {"t": "numbers; DROP TABLE x"}, {"low": 2}).collect()


def test_range_bucket_bounds(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (100,), (101,), (10900,), (10901,), (12000,)], "n bigint")
    assert [r[0] for r in df.select(tables.range_bucket(F.col("n"))).collect()] == [
        None, None, 0, 0, 1, 108, None, None]


def test_bucketed_slices(spark, tmp_path):
    target = str(tmp_path / "b")
    bounds = {"start": 1, "end": 50, "size": 10}
    df = spark.range(-3, 80).select(F.when(F.col("id") != 5, F.col("id")).alias("row_number"), F.lit("x").alias("v"))
    tables.write_bucketed(df, target, **bounds)
    for low, high in [(1, 10), (7, 23), (-5, 3), (38, 60), (41, 41), (70, 90), (-9, 99)]:
        got = sorted(r.row_number for r in tables.read_slice(spark, target, low, high, **bounds).collect())
        assert got == [i for i in range(-3, 80) if low <= i <= high and i != 5]
    plan = tables.read_slice(spark, target, 7, 23, **bounds)._jdf.queryExecution().executedPlan().toString()
    assert "rn_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_append_slices_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2)], "s string, i int")
    assert {tuple(r) for r in tables.append_slices([a, b]).collect()} == {(1, "x"), (2, "y")}


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "i int, s string")
    tables.write_text(df, str(tmp_path / "t"), files=2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1,", "2,b"]


def test_run_step_and_query_step(spark):
    out = tables.run_step(lambda: spark.range(3), None, lambda df: df)
    assert out.count() == 3
    doubled = tables.run_step(lambda: spark.range(3), lambda df: df.withColumn("id", F.col("id") * 2), lambda df: df)
    assert sorted(r.id for r in doubled.collect()) == [0, 2, 4]
    spark.sql("DROP TABLE IF EXISTS longloom_test.t")
    found = tables.run_query_step(spark, "longloom_test", "t", "SELECT id FROM range(:n)", {"n": 4})
    assert found == {"output_dataset": "longloom_test", "output_table": "longloom_test.t"}
    assert spark.table("longloom_test.t").count() == 4
    spark.sql("DROP DATABASE longloom_test CASCADE")


def wide(spark):
    return spark.createDataFrame([("a", 1.5, None, "0"), ("b", float("nan"), 2.0, "1")],
                                 "id string, f1 double, f2 double, label string")


def test_matrix_csv_roundtrip(spark, tmp_path):
    target = str(tmp_path / "m")
    matrix_csv.write_matrix_csv(wide(spark), target)
    back = matrix_csv.read_matrix_csv(spark, target, "id", ("label",))
    vectors, names = matrix_csv.wide_to_vectors(back, "id", ("label",))
    assert names == ["f1", "f2"]
    assert {r.id: r.features for r in vectors.collect()} == {"a": [1.5, None], "b": [None, 2.0]}


def test_matrix_parts(spark, tmp_path):
    for name, order in (("p0", ["id", "f1", "f2", "label"]), ("p1", ["label", "f2", "f1", "id"])):
        wide(spark).select(order).coalesce(1).write.option("header", True).csv(str(tmp_path / name))
    (tmp_path / "p2.csv").write_text("id,other\nz,1\n")
    paths = [str(tmp_path / n) for n in ("p3-absent", "p2.csv", "p1", "p0")]
    rows = matrix_csv.read_matrix_parts(spark, paths, "id", ("label",))
    assert sorted((r.id, r.f2) for r in rows.collect()) == [("a", None), ("a", None), ("b", 2.0), ("b", 2.0)]
    assert matrix_csv.read_matrix_parts(spark, paths, "id", ("label",), max_files=1).count() == 2
    picked = matrix_csv.read_matrix_parts(spark, paths, "id", (), project="1", project_col="label")
    assert {r.id for r in picked.collect()} == {"b"}
    with pytest.raises(AnalysisException):
        matrix_csv.read_matrix_parts(spark, [str(tmp_path / "absent")], "id", ("label",))


def test_shared_dir_follows_the_session(spark, tmp_path):
    old = spark.conf.get("spark.checkpoint.dir", None)
    assert old is None or session.shared_dir(spark).startswith(old)
    df, seen = session.materialize_measured(spark.range(7), top=F.max("id"))
    assert df.count() == 7 and seen == {"rows": 7, "top": 6}


def test_lines_that_do_not_fit_are_listed(spark, tmp_path):
    (tmp_path / "p0.csv").write_text("id,f1,f2,label\nx,1,2,a\ny,3\nz,4,oops,b\nw,1,2,c,9\n\"q,q\",5,nan,d\n")
    (tmp_path / "p1.csv").write_text("label,f2,f1,id\ne,7,8,v\n")
    paths = [str(tmp_path / f"p{i}.csv") for i in range(2)]
    rows = matrix_csv.read_matrix_parts(spark, paths, "id", ("label",))
    vectors, _ = matrix_csv.wide_to_vectors(rows, "id", ("label",))
    assert {r.id: (r.features, r.label) for r in vectors.collect()} == {
        "x": ([1.0, 2.0], "a"), "y": ([3.0, None], None), "q,q": ([5.0, None], "d"), "v": ([8.0, 7.0], "e")}
    assert {r.line for r in matrix_csv.rejected_lines(spark, paths, "id", ("label",)).collect()} == {"z,4,oops,b", "w,1,2,c,9"}


def test_files_of_one_matrix_have_one_order(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "a.csv").write_text("id,f1,f2,label\nx,1,2,a\n")
    (folder / "b.csv").write_text("id,f2,f1,label\ny,1,2,a\n")
    with pytest.raises(Exception):
        matrix_csv.read_matrix_csv(spark, str(folder), "id", ("label",)).collect()


def test_vectors_to_wide_csv(spark, tmp_path):
    width = 5000
    m = spark.createDataFrame([("a", [float(i) for i in range(width)], "0"), ("b,c", [None] * width, 'say "1"')],
                              "id string, features array<double>, label string")
    target = str(tmp_path / "wide")
    matrix_csv.write_vectors_csv(m, [f"f{i}" for i in range(width)], target)
    lines = [x for p in sorted((tmp_path / "wide").glob("*.csv")) for x in p.read_text().splitlines()]
    assert lines[0].startswith("id,f0,f1,") and lines[0].endswith(",f4999,label")
    back = matrix_csv.wide_to_vectors(matrix_csv.read_matrix_csv(spark, target, "id", ("label",)), "id", ("label",))[0]
    assert {r.id: (r.features, r.label) for r in back.collect()} == {r.id: (r.features, r.label) for r in m.collect()}


def test_slices_and_unnumbered_rows_add_up(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (None, "c"), (20000, "d")], "row_number bigint, v string")
    target = str(tmp_path / "bucketed")
    tables.write_bucketed(df, target)
    parts = [tables.read_slice(spark, target, 1, 4), tables.read_slice(spark, target, 5, 1 << 40),
             tables.read_unnumbered(spark, target)]
    assert sorted(r.v for r in tables.append_slices(parts).collect()) == ["a", "b", "c", "d"]


def test_one_folder_per_session(spark):
    a, b = session.shared_dir(spark), session.shared_dir(spark)
    assert a != b and a.rpartition("/")[0] == b.rpartition("/")[0]
