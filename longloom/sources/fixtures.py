"""Domain-shaped inputs derived from the test tables.

Each view is one SQL text that Spark and another SQL engine both run; ``{name}`` stands for a driver table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["customer", "supplier", "part", "lineitem", "orders", "events", "documents", "embeddings", "labels"]

# name -> views it builds on, in order; case numbers are six hexadecimal digits.
VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_cell": ([], """
        SELECT l_suppkey AS s, l_partkey % 200 AS p,
          round((min(l_extendedprice) - 1000*floor(min(l_extendedprice)/1000))/1000*0.6
            + CASE WHEN l_partkey % 200 % 10 = 3 AND l_suppkey % 10 NOT IN (3,7) THEN 0.3 ELSE 0 END, 6) AS b
        FROM {lineitem} GROUP BY l_suppkey, l_partkey % 200"""),
    "fx_barcode": ([], """
        SELECT s_suppkey AS s, 'TCGA-' || substr(n,1,2) || '-' || substr(n,3,4) AS case_barcode,
          'TCGA-' || substr(n,1,2) || '-' || substr(n,3,4) || '-' || CASE WHEN s_suppkey % 20 = 19 THEN '20'
            WHEN s_suppkey % 10 IN (3,7) THEN '11' ELSE '0' || CAST(1 + s_suppkey % 9 AS STRING) END
            || 'A-11D-A' || lpad(CAST(s_suppkey AS STRING),9,'0') || '-05' AS aliquot_barcode
        FROM (SELECT s_suppkey, lpad(hex(CAST(floor(s_suppkey/2) AS BIGINT)),6,'0') AS n FROM {supplier}) t"""),
    "fx_methylation": (["fx_cell", "fx_barcode"], """
        SELECT case_barcode, aliquot_barcode, 'cg' || lpad(CAST(p AS STRING),8,'0') AS probe_id,
          CASE WHEN p % 5 = 0 AND c.s % 4 = 0 THEN NULL WHEN (c.s + p) % 50 = 0 THEN NULL ELSE b END AS beta_value
        FROM fx_cell c JOIN fx_barcode f ON c.s = f.s"""),
    # Arrays also carry probes of other kinds ('ch'), which match no measurement.
    "fx_annotation": ([], """
        SELECT DISTINCT CASE WHEN p_partkey % 200 % 40 = 39 THEN 'ch' ELSE 'cg' END
          || lpad(CAST(p_partkey % 200 AS STRING),8,'0') AS Name FROM {part}"""),
    "fx_gdc_annotation": ([], """
        SELECT DISTINCT CASE WHEN p_partkey % 200 % 50 = 49 THEN 'ch' ELSE 'cg' END
          || lpad(CAST(p_partkey % 200 AS STRING),8,'0') AS CpG_probe_id FROM {part}
        UNION ALL SELECT 'cg00000007' AS CpG_probe_id"""),
    "fx_ad_log": ([], """
        SELECT CAST(floor(event_id/4) AS BIGINT) AS UniqueIdentifier,
          CASE WHEN (event_id % 4 <> 0 AND event_id % 20 <> 2) OR event_id % 28 = 0 THEN NULL
            WHEN event_id % 44 = 0 THEN 'pf=web&am_crmid=&z=1'
            WHEN event_id % 52 = 0 THEN 'pf=web&am_crmid=old&am_crmid=u%2D' || CAST(user_id AS STRING)
            ELSE 'pf=web&am_crmid=u%2D' || CAST(user_id AS STRING) || '&z=1' END AS AllRequestKv,
          CASE event_type WHEN 'view' THEN 'defaultImpression' WHEN 'purchase' THEN '_q_complete'
            ELSE event_type END AS EventName,
          CAST(floor(value) AS BIGINT) AS AdDuration,
          CASE WHEN event_id % 11 = 0 THEN NULL ELSE least(event_id % 5, event_id % 3) END AS AdsSelected,
          event_id % 5 AS MaxAds, 30 * (event_id % 4) AS MaxDuration
        FROM {events}"""),
    "fx_stage_code": ([], """
        SELECT c_custkey, lpad(hex(c_custkey),6,'0') AS n FROM {customer}"""),
    "fx_stage1": (["fx_stage_code"], """
        SELECT 'TCGA-' || substr(n,1,2) || '-' || substr(n,3,4) AS case_barcode,
          CASE c_custkey % 6 WHEN 0 THEN 'Stage I' WHEN 1 THEN 'Stage IIA' WHEN 2 THEN 'Stage IIIC'
            WHEN 3 THEN 'Stage IV' WHEN 4 THEN 'Stage X' END AS pathologic_stage,
          CASE c_custkey % 4 WHEN 0 THEN 'T1c' WHEN 1 THEN 'T2' WHEN 2 THEN 'TX' ELSE 'T4b' END AS pathologic_T,
          CASE c_custkey % 4 WHEN 0 THEN 'N0 (i-)' WHEN 1 THEN 'N1mi' WHEN 2 THEN 'NX' ELSE 'N3a' END AS pathologic_N,
          CASE c_custkey % 4 WHEN 0 THEN 'M0' WHEN 1 THEN 'cM0 (i+)' WHEN 2 THEN 'M1' ELSE 'MX' END AS pathologic_M,
          CASE WHEN c_custkey % 5 = 4 THEN 'TCGA-LUAD' ELSE 'TCGA-BRCA' END AS project_short_name
        FROM fx_stage_code"""),
    "fx_patient_stage": (["fx_stage_code", "fx_stage1"], """
        SELECT * FROM fx_stage1
        UNION ALL SELECT * FROM fx_stage1 WHERE project_short_name = 'TCGA-BRCA'"""),
    "fx_matrix": ([], """
        SELECT vec_id AS id, CAST(idx AS BIGINT) AS idx, CAST(label AS INT) AS label,
          CASE WHEN (vec_id % 10 = 0 AND (vec_id*31+idx*17) % 13 = 0) THEN NULL ELSE v END AS x
        FROM (<cells>) t"""),
    # One row per trained model version, as a registry would hold them.
    "fx_model_log": ([], """
        SELECT o_orderpriority AS model, 'models/' || CAST(o_orderkey AS STRING) AS uri, o_orderstatus = 'F' AS blessed,
          o_orderdate AS created, o_orderkey AS version FROM {orders}"""),
}

_SPARK_CELLS = ("SELECT vec_id, label, pos AS idx, CAST(val AS DOUBLE) AS v "
                "FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, val")
_DUCK_CELLS = ("SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS idx, "
               "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")


def spark_text(name: str) -> str:
    return VIEWS[name][1].replace("<cells>", _SPARK_CELLS)


def duck_text(name: str) -> str:
    sql = VIEWS[name][1].replace("<cells>", _DUCK_CELLS)
    for table in TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql


def ctes(*names: str, text=duck_text) -> list[str]:
    """``name AS (...)`` items for the views and all they build on, in order."""
    order: list[str] = []
    for name in names:
        for item in [*VIEWS[name][0], name]:
            if item not in order:
                order.append(item)
    return [f"{item} AS ({text(item)})" for item in order]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = f"WITH {', '.join(ctes(name, text=spark_text))} SELECT * FROM {name}"
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)
