from pyspark.ml import Estimator, Transformer

from longloom.catalog import other_queries
from longloom.plans import training


class Passing(Transformer):
    def _transform(self, dataset):
        return dataset


class Seeing(Estimator):
    """Notes what it is fitted on."""

    def _fit(self, dataset):
        self.partitions, self.labels, self.plan = dataset.rdd.getNumPartitions(), sorted(r["label"] for r in dataset.collect()), dataset.storageLevel
        return Passing()


def rows(spark, n, parts):
    data = [(i, i % 2, [float(i), 1.0, -2.5]) for i in range(n)]
    return spark.createDataFrame(data, "id long, label int, features array<double>").repartition(parts, "id")


def test_fits_do_not_run_over_a_shuffles_partitions(spark):
    """Every step of a fit is a job over all partitions; sixty-four for a handful of rows were sixty-four tasks a step."""
    seeing = Seeing()
    training.fit(seeing, rows(spark, 90, 64))
    assert seeing.partitions <= spark.sparkContext.defaultParallelism
    assert seeing.labels == [0.0] * 45 + [1.0] * 45 and seeing.plan.useMemory


def test_many_values_keep_partitions(spark, monkeypatch):
    monkeypatch.setattr(training, "PARTITION_VALUES", 30)
    kept = training.kept(training.with_vectors(rows(spark, 90, 16)).select("label", "input"))
    assert kept.count() == 90 and 1 <= kept.rdd.getNumPartitions() <= 9
    none = training.kept(training.with_vectors(rows(spark, 90, 16).limit(0)).select("label", "input"))
    assert none.count() == 0


def test_mlp_train_is_given_all_steps(spark, monkeypatch):
    """It was given 300 of the 1,000 steps; here one is run, on rows of its own."""
    asked, whole = [], training.fit

    def short(net, train):
        asked.append((net.getMaxIter(), net.getLayers(), train.count()))
        return whole(net.copy({net.maxIter: 1}), train)

    data = [(i, i % 2, [float((i * j) % 7) for j in range(64)]) for i in range(30)]
    m = spark.createDataFrame(data, "id long, label int, features array<double>")
    monkeypatch.setattr(other_queries, "_parts", lambda *_: (m.filter("id < 20"), m.filter("id >= 20")))
    monkeypatch.setattr(training, "fit", short)
    out = other_queries.mlp_train(spark, "").collect()
    assert asked == [(1000, [64, 16, 8, 2], 20)]
    assert len(out) == 10 and all(r.known_class and r.most_likely and r.adds_up for r in out)
