"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_own_bases: dict[str, str] = {}  # temporary folders of local applications


def get_session(app: str = "longloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder every executor can reach, within one folder per application that can be removed afterwards.

    It lies under ``spark.checkpoint.dir`` as the session names it. Only a session within one process that names none
    gets a temporary folder, one for all its frames; a cluster that names none is an error, because a machine-local
    folder would lose the data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_bases.get(spark.sparkContext.applicationId)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _own_bases[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="longloom-")
    return f"{base.rstrip('/')}/longloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    This cuts lineage so that a lost executor re-reads files instead of recomputing, fixes values that depend on
    physical partitioning, and gives the optimizer true file sizes to choose join strategies by.
    """
    return materialize_measured(df)[0]


def materialize_measured(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """The written frame, its number of ``rows`` and further aggregates, all from the one job that writes it."""
    path = f"{shared_dir(df.sparkSession)}/table"
    seen = Observation()
    exprs = [F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in measures.items()]]
    df.observe(seen, *exprs).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get
