import math

import pytest
from pyspark.sql import functions as F

from longloom.llm.mixing import SLICE_ROWS, draw_copies, mix_sources, source_targets


def shared_by_weight(sizes, weights=(1, 2, 3), most=3):
    """Resharing the excess, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in names)
        target = {s: min(target[s], most * sizes[s]) for s in names}
        open_ = {s for s in open_ if target[s] < most * sizes[s]}
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 10, "d": 3}, {"z": 5, "é": 50, "B": 500, None: 7, "": 4},
    {"a": 0, "b": 0}, {"a": 0, "b": 9}, {"one": 12}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(shared_by_weight(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def corpus(spark, n=6000):
    i = F.col("id")
    source = F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise(F.concat(F.lit("s"), (i % 7).cast("string")))
    words = F.pmod(F.xxhash64(i), F.lit(60)) + F.when(i % 211 == 0, 2000).otherwise(1)
    return spark.range(n).select(i.alias("doc_id"), F.repeat(F.lit("w "), words.cast("int")).alias("text"),
                                 source.alias("source"), F.lit("x").alias("key"), F.lit(1).alias("copies"))


def test_draw(spark):
    rows = draw_copies(corpus(spark)).collect()
    sizes, taken, most = {}, {}, {}
    for r in rows:
        assert 0 <= r["copies"] <= 3
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    targets = shared_by_weight(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 3, (s, taken[s], targets[s])
    again = draw_copies(corpus(spark).repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_order_is_pareto(spark):
    """Within a source longer than a slice, what is drawn has the lowest ranks, but for the last slice."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text"),
                                    F.when(F.col("id") < 4500, "a").otherwise("b").alias("source"))
    rows = [r for r in draw_copies(docs).collect() if r["source"] == "a"]
    whole = math.floor(rows[0]["target"] / rows[0]["source_size"])
    order = sorted(rows, key=lambda r: (r["key"] % (1 << 64)) >> 12)
    extra = [r["copies"] - whole for r in order]
    drawn = sum(extra)
    assert 0 < drawn < len(rows)
    assert sum(extra[:drawn]) == drawn and SLICE_ROWS < len(rows)


def test_mix_repeats_rows(spark):
    docs = corpus(spark, 400)
    want = {r["id"]: r["copies"] for r in draw_copies(docs).collect()}
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "a b", "s"), (None, "a b", "s"), (1, None, "s"), (2, "", None), (3, "x y z", None), (3, "x y", "")],
        "doc_id long, text string, source string")
    rows = draw_copies(docs).collect()
    assert len(rows) == 6 and {r["size"] for r in rows} == {0, 2, 3}
    empty = spark.createDataFrame([], docs.schema)
    assert draw_copies(empty).count() == 0 and mix_sources(empty).count() == 0
    assert draw_copies(docs.filter("doc_id = 1")).collect()[0]["target"] == 0
