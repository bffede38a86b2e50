"""Stored routines: SQL table functions for ranking and for the labelled pivot, called by name from any query or template."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# The tables and views that routines read are named when they are made; what is asked of them is an argument.
RANK = """
    WITH means AS (
      SELECT CpG_probe_id, count(beta_value) AS cpg_count, avg(beta_value) AS a,
        avg(beta_value) FILTER (WHERE sample_status = 'tumor') AS t, avg(beta_value) FILTER (WHERE sample_status = 'normal') AS n
      FROM {source} GROUP BY CpG_probe_id),
    scored AS (
      SELECT CpG_probe_id, round(power(coalesce(t, a) - a, 2) + power(coalesce(n, a) - a, 2), 9) AS score FROM means
      WHERE cpg_count >= min_coverage * (SELECT count(DISTINCT aliquot_barcode) FROM {source}))
    SELECT CpG_probe_id, score FROM (
      SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, CpG_probe_id) AS place FROM scored) WHERE place <= k"""

PIVOT = """
    WITH listed AS (
      SELECT {column} AS name FROM (
        SELECT {column}, row_number() OVER (ORDER BY {column}) AS place FROM (
          SELECT DISTINCT {column} FROM {source} WHERE {column} IS NOT NULL)) WHERE place <= max_columns),
    cells AS (
      SELECT s.{row}, s.{column} AS name, CASE aggregation WHEN 'SUM' THEN sum(s.{value}) WHEN 'AVG' THEN avg(s.{value})
          WHEN 'MIN' THEN min(s.{value}) WHEN 'MAX' THEN max(s.{value}) WHEN 'COUNT' THEN CAST(count(s.{value}) AS DOUBLE)
          ELSE raise_error('unknown aggregation') END AS x
      FROM {source} s JOIN listed l ON s.{column} = l.name GROUP BY s.{row}, s.{column}),
    every_row AS (SELECT DISTINCT {row}, {label} FROM {source})
    SELECT r.{row}, r.{label}, coalesce(map_from_entries(array_sort(collect_list(struct(c.name, c.x)) FILTER (WHERE c.name IS NOT NULL))), map()) AS cells
    FROM every_row r LEFT JOIN cells c ON r.{row} <=> c.{row} GROUP BY r.{row}, r.{label}"""


def _name(text: str) -> str:
    """A table, view, column or function name, which is part of the routine's text."""
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*){0,2}", text):
        raise ValueError(f"not a name: {text!r}")
    return text


def _create(spark: SparkSession, name: str, temporary: bool, arguments: str, returns: str, body: str) -> str:
    kind = "TEMPORARY FUNCTION" if temporary else "FUNCTION"
    spark.sql(f"CREATE OR REPLACE {kind} {_name(name)}({arguments}) RETURNS TABLE({returns}) RETURN {body}")
    return name


def create_ranking(spark: SparkSession, name: str, source: str, temporary: bool = True) -> str:
    """``name(k, min_coverage)``: the best covered sites of a labelled measurement table, ``CpG_probe_id, score``.

    It ranks as ``rank_sites`` does. The list is put in order in one task, scores only, one for each covered site.
    """
    return _create(spark, name, temporary, "k INT DEFAULT 5000, min_coverage DOUBLE DEFAULT 0.9", "CpG_probe_id STRING, score DOUBLE",
                   RANK.format(source=_name(source)))


def create_labelled_pivot(spark: SparkSession, name: str, source: str, row: str = "aliquot_barcode", column: str = "CpG_probe_id",
                          value: str = "beta_value", label: str = "sample_status", temporary: bool = True) -> str:
    """``name(max_columns, aggregation)``: a row for each sample and label with a map from column names to values.

    The first ``max_columns`` names are taken; cells are combined by SUM, AVG, MIN, MAX or COUNT. A function's columns are
    fixed, so that the pivot's columns are the keys of the map; names without a value have no key. A sample without any listed
    name has an empty map.
    """
    names = {k: _name(v) for k, v in {"source": source, "row": row, "column": column, "value": value, "label": label}.items()}
    return _create(spark, name, temporary, "max_columns INT DEFAULT 100, aggregation STRING DEFAULT 'SUM'",
                   f"{row} STRING, {label} STRING, cells MAP<STRING, DOUBLE>", PIVOT.format(**names))
