"""Queries on boosted trees and the wide and deep model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.split import split_exact, take_split
from ..plans import boosting, wide_deep
from ..session import shared_dir
from . import inputs
from .other_queries import _TEST_ROWS, _checked
from .registry import h32, query

FIRST = boosting.Boosting(n_estimators=1, max_depth=3, gamma=0.0, alpha=0.5)

_BINNED = f"""
    , vals AS (SELECT idx, x FROM two_class WHERE x IS NOT NULL),
    ranked AS (
      SELECT idx, x, row_number() OVER (PARTITION BY idx ORDER BY x) AS r, count(*) OVER (PARTITION BY idx) AS n,
        min(x) OVER (PARTITION BY idx) AS low FROM vals),
    cuts AS (
      SELECT DISTINCT idx, x AS cut FROM ranked
      WHERE (r - 1) * {FIRST.bins} // n + 1 <= r * {FIRST.bins} // n AND (r - 1) * {FIRST.bins} // n + 1 < {FIRST.bins} AND x > low),
    cut_lists AS (SELECT idx, list(cut ORDER BY cut) AS cs FROM cuts GROUP BY idx),
    tree_columns AS (
      SELECT idx FROM (SELECT DISTINCT idx FROM two_class)
      QUALIFY row_number() OVER (ORDER BY {h32("idx || ':123:columns:0'")}, idx) <= floor({FIRST.colsample} * count(*) OVER ())),
    sampled AS (
      SELECT id, t.idx, 0.5 - label::DOUBLE AS g, 0.25::DOUBLE AS h,
        CASE WHEN x IS NULL THEN 0 ELSE 1 + len(list_filter(cs, lambda c: c <= x)) END AS bin
      FROM two_class t JOIN tree_columns USING (idx) JOIN cut_lists USING (idx)
      WHERE {h32("id || ':123:rows:0'")} / 4294967296.0 < {FIRST.subsample}),
    nodes0 AS (SELECT DISTINCT id, 0 AS node FROM sampled)"""


def _worth(g: str, h: str) -> str:
    over = f"greatest(abs({g}) - {FIRST.alpha}::DOUBLE, 0::DOUBLE)"
    return f"({over} * {over} / ({h} + {FIRST.lam}::DOUBLE))"


def _level(k: int, splits_before: str) -> str:
    """Histograms, candidate splits and the best of them for the nodes of a level, and where its rows go."""
    sides = " UNION ALL ".join(
        f"SELECT node, idx, bin, g, h, {left} AS missing_left, g_upto + {m} * g_missing AS gl, h_upto + {m} * h_missing AS hl "
        f"FROM sums{k} WHERE bin > 0" for left, m in (("false", 0), ("true", 1)))
    return f""",
    cells{k} AS (SELECT node, idx, bin, sum(g) AS g, sum(h) AS h FROM sampled JOIN nodes{k} USING (id) GROUP BY ALL),
    sums{k} AS (
      SELECT node, idx, bin, sum(g) OVER own AS g, sum(h) OVER own AS h,
        sum(CASE WHEN bin > 0 THEN g ELSE 0 END) OVER upto AS g_upto, sum(CASE WHEN bin > 0 THEN h ELSE 0 END) OVER upto AS h_upto,
        sum(CASE WHEN bin = 0 THEN g ELSE 0 END) OVER own AS g_missing, sum(CASE WHEN bin = 0 THEN h ELSE 0 END) OVER own AS h_missing
      FROM cells{k} WINDOW own AS (PARTITION BY node, idx),
        upto AS (PARTITION BY node, idx ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    sides{k} AS ({sides}),
    best{k} AS (
      SELECT node, idx, bin, missing_left, {_worth("gl", "hl")} + {_worth("(g - gl)", "(h - hl)")} - {_worth("g", "h")} AS gain,
        -{FIRST.learning_rate} * sign(g) * greatest(abs(g) - {FIRST.alpha}, 0) / (h + {FIRST.lam}) AS weight
      FROM sides{k} WHERE hl >= {FIRST.min_child_weight} AND h - hl >= {FIRST.min_child_weight}
      QUALIFY gain > {boosting.LEAST_GAIN} AND row_number() OVER (PARTITION BY node ORDER BY gain DESC, idx, bin, missing_left) = 1),
    placed{k} AS (SELECT *, 1 + 2 * ({splits_before} + row_number() OVER (ORDER BY node) - 1) AS to_left FROM best{k}),
    nodes{k + 1} AS (
      SELECT s.id, CASE WHEN (s.bin = 0 AND p.missing_left) OR (s.bin > 0 AND s.bin <= p.bin) THEN to_left ELSE to_left + 1 END AS node
      FROM sampled s JOIN nodes{k} n USING (id) JOIN placed{k} p ON n.node = p.node AND s.idx = p.idx)"""


@query("boosting_first_tree", _BINNED + _level(0, "0") + _level(1, "(SELECT count(*) FROM best0)")
       + _level(2, "(SELECT count(*) FROM best0) + (SELECT count(*) FROM best1)") + " UNION ALL ".join(f"""
    SELECT b.node, b.idx AS feature, round(coalesce(cs[b.bin], 'Infinity'::DOUBLE), 9) AS threshold, missing_left, round(gain, 6) AS gain, round(weight, 9) AS weight
    FROM best{k} b JOIN cut_lists USING (idx)""" for k in range(3)), steps=("two_class",))
def boosting_first_tree(spark, sf_dir):
    """The splits of the first tree down to three levels, from its rows and columns, over the whole matrix."""
    model = boosting.fit(inputs.matrix(spark, sf_dir), FIRST)
    return model.nodes(spark).filter("feature >= 0").select(
        F.col("node").cast("bigint"), F.col("feature").cast("bigint"), F.round("threshold", 9).alias("threshold"), "missing_left",
        F.round("gain", 6).alias("gain"), F.round("weight", 9).alias("weight"))


@query("boosting_train", _TEST_ROWS, steps=("split_of",))
def boosting_train(spark, sf_dir):
    """The default model, trained on rows with gaps, saved, loaded and asked about the test rows."""
    train, test = take_split(split_exact(inputs.matrix(spark, sf_dir)))
    path = f"{shared_dir(spark)}/boosted"
    boosting.fit(train).save(spark, path)
    return _checked(boosting.load(spark, path).score(test))


@query("wide_deep_train", _TEST_ROWS, steps=("split_of",))
def wide_deep_train(spark, sf_dir):
    """The wide and deep model at its defaults: 1,000 steps of 40 rows."""
    train, test = take_split(split_exact(inputs.matrix(spark, sf_dir)))
    return _checked(wide_deep.fit(train).score(test))
