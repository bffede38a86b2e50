"""Registration of runnable queries with the SQL another engine must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sample codes of the barcode format.
_STATUS = """CASE WHEN substr({b},14,2) IN ('10','11','12','13','14','15','16','17','18','19') THEN 'normal'
   WHEN substr({b},14,2) IN ('01','02','03','04','05','06','07','08','09') THEN 'tumor' ELSE 'control' END"""


def h32(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


# Shared steps on top of the input views: name -> (views needed, steps needed, SQL)
STEPS: dict[str, tuple[list[str], list[str], str]] = {
    "dna": (["fx_methylation", "fx_annotation", "fx_gdc_annotation"], [], """
        SELECT m.case_barcode, m.beta_value, g.CpG_probe_id, m.aliquot_barcode
        FROM fx_annotation a JOIN fx_methylation m ON a.Name = m.probe_id
        JOIN fx_gdc_annotation g ON g.CpG_probe_id = a.Name"""),
    "numbered": (["fx_methylation"], [], """
        SELECT case_barcode, row_number() OVER (ORDER BY case_barcode NULLS FIRST) AS row_number
        FROM (SELECT DISTINCT case_barcode FROM fx_methylation)"""),
    "betas": ([], ["dna", "numbered"], f"""
        SELECT d.case_barcode, d.beta_value, d.CpG_probe_id, d.aliquot_barcode,
          substr(d.aliquot_barcode,14,2) AS sample_id, {_STATUS.format(b='d.aliquot_barcode')} AS sample_status,
          n.row_number
        FROM dna d LEFT JOIN numbered n ON d.case_barcode = n.case_barcode"""),
    "means": ([], ["betas"], """
        SELECT CpG_probe_id, count(beta_value) AS cpg_count, count(*) AS all_count, avg(beta_value) AS a,
          avg(beta_value) FILTER (WHERE sample_status = 'tumor') AS t,
          avg(beta_value) FILTER (WHERE sample_status = 'normal') AS n,
          (SELECT count(DISTINCT aliquot_barcode) FROM betas) AS samples
        FROM betas GROUP BY CpG_probe_id"""),
    "scores": ([], ["means"], """
        SELECT *, round(power(coalesce(t,a)-a,2) + power(coalesce(n,a)-a,2), 9) AS score FROM means"""),
    "top_sites": ([], ["scores"], """
        SELECT CpG_probe_id FROM scores WHERE cpg_count / samples >= 0.9 ORDER BY score DESC, CpG_probe_id LIMIT 5000"""),
    "cells": ([], ["betas"], """
        SELECT aliquot_barcode, CpG_probe_id, avg(beta_value) AS beta_value FROM betas GROUP BY ALL"""),
    "site_idx": ([], ["top_sites"], """
        SELECT CpG_probe_id, row_number() OVER (ORDER BY CpG_probe_id) - 1 AS idx FROM top_sites"""),
    "two_class": (["fx_matrix"], [], """
        SELECT id, idx, CASE WHEN label = 3 THEN 0 ELSE 1 END AS label, x FROM fx_matrix"""),
    "filled": ([], ["two_class"], """
        SELECT b.id, b.idx, b.label, coalesce(b.x, s.mean) AS x
        FROM two_class b JOIN (SELECT idx, avg(x) AS mean FROM two_class GROUP BY idx) s ON b.idx = s.idx"""),
    "rows_of": ([], ["two_class"], "SELECT DISTINCT id, label FROM two_class"),
    "split_of": ([], ["rows_of"], f"""
        SELECT id, label, row_number() OVER (ORDER BY {h32("id || ':123'")}, id)
          <= ceil(0.3 * (SELECT count(*) FROM rows_of)) AS is_test FROM rows_of"""),
    "ad_first": (["fx_ad_log"], [], """
        SELECT UniqueIdentifier, min(fid) AS FreewheelId FROM (
          SELECT UniqueIdentifier, list_filter(list_transform(string_split(AllRequestKv, '&'),
            lambda p: [url_decode(split_part(p,'=',1)), url_decode(substr(p, strpos(p,'=')+1))]),
            lambda e: e[1] = 'am_crmid' AND length(e[2]) > 0)[-1][2] AS fid
          FROM fx_ad_log WHERE AllRequestKv IS NOT NULL AND length(AllRequestKv) > 0)
        GROUP BY UniqueIdentifier"""),
    "preds": ([], [], "SELECT quality AS label, toxic AS prediction, doc_id FROM labels"),
}


def _needs(step: str) -> tuple[list[str], list[str]]:
    views, steps, _ = STEPS[step]
    all_views, all_steps = list(views), []
    for other in steps:
        v, s = _needs(other)
        all_views += v
        all_steps += [*s, other]
    return all_views, all_steps


def oracle(body: str, views: tuple[str, ...] = (), steps: tuple[str, ...] = ()) -> str:
    """The full SQL text: input views, shared steps, then the query itself."""
    need_views, need_steps = list(views), []
    for step in steps:
        v, s = _needs(step)
        need_views += v
        need_steps += [*s, step]
    items = fixtures.ctes(*need_views)
    items += [f"{s} AS ({STEPS[s][2]})" for s in dict.fromkeys(need_steps)]
    return f"WITH {', '.join(items)} {body}" if items else body


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (),
          steps: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, views, steps)
        return fn

    return add
