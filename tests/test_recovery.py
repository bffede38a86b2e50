import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from longloom.operators.ranking import rank_sites
from longloom.plans.ledger import Ledger, fingerprint, run_pipeline
from longloom.sources import routines, tables, versions
from tests.test_storage import betas


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(1000))
    # some tasks write their rows before one fails
    bad = table.read().repartition(8).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(PySparkException, match="lost"):
        table.replace(bad)
    assert table.read().count() == 1000 and table.version() == 1
    assert table.replace(table.read().filter("id < 10")).count() == 10 and table.version() == 2


def test_a_crash_before_the_marker_changes_nothing(spark, tmp_path, monkeypatch):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(5))
    monkeypatch.setattr(table, "_mark", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        table.replace(spark.range(7))
    monkeypatch.undo()
    assert versions.VersionedTable(spark, table.path).read().count() == 5
    assert versions.replace_safely(spark.range(6), table.path).count() == 6


def test_readers_keep_their_version_and_writers_conflict(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    old = table.replace(spark.range(3))
    other = versions.VersionedTable(spark, table.path)
    real = other.version()
    other.version = lambda: real  # it began before the next replacement
    table.replace(spark.range(4))
    assert old.count() == 3 and table.read().count() == 4
    with pytest.raises(versions.Conflict):
        other.replace(spark.range(9))
    assert table.read().count() == 4
    for n in range(5, 8):
        table.replace(spark.range(n))
    assert table.read().count() == 7 and len(table._names("current")) == versions.KEPT and len(table._names("versions")) == versions.KEPT


def test_declared_schema(spark, tmp_path):
    got = versions.replace_safely(spark.createDataFrame([("1", 2)], "b string, a int"), str(tmp_path / "t"), "a:STRING, b:INTEGER")
    assert got.dtypes == [("a", "string"), ("b", "bigint")] and got.first() == ("2", 1)


def steps(spark, path, factor=2):
    return [("one", lambda: spark.read.parquet(f"{path}/in").withColumn("y", F.col("x") * factor), []),
            ("two", lambda one: one.groupBy("g").agg(F.sum("y").alias("s")), ["one"]),
            ("three", lambda one, two: one.join(two, "g").select("g", "y", "s"), ["one", "two"])]


def test_a_second_run_starts_nothing(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(20).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    rows.write.parquet(f"{path}/in")
    results, starts = [], []
    for factor in (2, 2, 3, 2):
        ledger = Ledger(spark, f"{path}/ledger")
        out = run_pipeline(ledger, steps(spark, path, factor))
        results.append(sorted(map(tuple, out["three"].collect())))
        starts.append(ledger.started)
    assert starts == [["one", "two", "three"], [], ["one", "two", "three"], []]
    assert results[0] == results[1] == results[3] != results[2]
    rows.limit(5).write.mode("append").parquet(f"{path}/in")
    ledger = Ledger(spark, f"{path}/ledger")
    assert run_pipeline(ledger, steps(spark, path))["one"].count() == 25 and ledger.started == ["one", "two", "three"]
    assert Ledger(spark, f"{path}/ledger").entries().count() == 9


def test_a_failed_step_is_started_again(spark, tmp_path):
    path = str(tmp_path)
    spark.range(6).select(F.lit(1).alias("g"), F.col("id").alias("x")).write.parquet(f"{path}/in")
    broken = steps(spark, path)
    broken[1] = ("two", lambda one: one.select(F.raise_error(F.lit("no")).alias("g")), ["one"])
    with pytest.raises(PySparkException):
        run_pipeline(Ledger(spark, f"{path}/ledger"), broken)
    ledger = Ledger(spark, f"{path}/ledger")
    run_pipeline(ledger, steps(spark, path))
    assert ledger.reused == ["one"] and ledger.started == ["two", "three"]
    with pytest.raises(ValueError, match="no step before"):
        run_pipeline(ledger, steps(spark, path)[1:])
    with pytest.raises(ValueError, match="two steps"):
        run_pipeline(ledger, [steps(spark, path)[0]] * 2)


def test_fingerprints(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "a"))
    def make(n):
        return spark.read.parquet(str(tmp_path / "a")).filter(F.col("id") > n)
    assert fingerprint(make(1)) == fingerprint(make(1)) != fingerprint(make(2))
    assert fingerprint(make(1), also="v2") != fingerprint(make(1), also="v1")


def test_routines(spark):
    rows = betas(spark)
    rows.createOrReplaceTempView("routine_betas")
    clean = rows.withColumn("beta_value", F.nanvl("beta_value", F.lit(None)))
    clean.createOrReplaceTempView("routine_betas")
    name = routines.create_ranking(spark, "best_sites", "routine_betas")
    got = tables.query_template(spark, "SELECT * FROM IDENTIFIER(:f)(:k, :least)", {"f": name}, {"k": 7, "least": 0.5}).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rank_sites(rows, 7, 0.5).collect()))
    assert spark.sql("SELECT count(*) FROM best_sites()").first()[0] <= 5000
    pivot = routines.create_labelled_pivot(spark, "pivoted", "routine_betas")
    cells = {r["aliquot_barcode"]: r["cells"] for r in spark.sql(f"SELECT * FROM {pivot}(3, 'COUNT')").collect()}
    names = sorted({r[0] for r in rows.select("CpG_probe_id").distinct().collect()})[:3]
    assert len(cells) == 23 and {k for c in cells.values() for k in c} <= set(names)
    plain = {(r[0], r[1]): r[2] for r in clean.filter(F.col("CpG_probe_id").isin(names)).groupBy("aliquot_barcode", "CpG_probe_id").agg(F.count("beta_value")).collect()}
    assert {(a, k): v for a, c in cells.items() for k, v in c.items()} == plain
    with pytest.raises(ValueError, match="not a name"):
        routines.create_ranking(spark, "x", "a; DROP TABLE b")
