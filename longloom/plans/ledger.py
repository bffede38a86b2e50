"""Pipelines that go on where they stopped.

A step's result is stored together with a fingerprint of what it was made from: the plan of the step's frame, without the
numbers Spark gives its columns, and the names, sizes and times of all files that the plan reads. A run that meets the same
fingerprint again reads the stored result. A changed input or step changes its own fingerprint and, because its followers read
the new result's files, theirs.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_STEP = "step string, fingerprint string, path string, rows long, created timestamp"


def _file_states(df: DataFrame) -> list[str]:
    """Name, length and modification time of every file that a frame reads."""
    spark, out = df.sparkSession, []
    conf = spark._jsc.hadoopConfiguration()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return out


def fingerprint(df: DataFrame, also: object = None) -> str:
    """A hash of a frame's plan and of the files that it reads.

    Expression numbers and the order of equal plans' columns aside, two frames with one fingerprint have one result, as long as
    Python code in the plan has not changed: what is not in the plan goes into ``also``, such as a version of that code.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    plan = re.sub(r"#\d+L?|plan_id=\d+|@[0-9a-f]{6,}|\[id=\d+\]", "", plan)
    text = json.dumps([plan, _file_states(df), repr(also)])
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Ledger:
    """The finished steps under a path, a row for each: ``step, fingerprint, path, rows, created``."""

    spark: SparkSession
    path: str
    started: list[str] = field(default_factory=list)  # steps that this run has computed
    reused: list[str] = field(default_factory=list)

    def entries(self) -> DataFrame:
        steps = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/steps")
        if not steps.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(steps):
            return self.spark.createDataFrame([], _STEP)
        return self.spark.read.schema(_STEP).parquet(f"{self.path}/steps")

    def _done(self, step: str, mark: str) -> str | None:
        found = self.entries().filter((F.col("step") == step) & (F.col("fingerprint") == mark))
        newest = found.orderBy("created", ascending=False).select("path").first()
        return newest["path"] if newest else None

    def run(self, step: str, make: Callable[[], DataFrame], also: object = None) -> DataFrame:
        """The stored result of a step, computed if no finished run of it had the same inputs.

        The step is recorded once its result is complete, so that one which fails is started again.
        """
        df = make()
        mark = fingerprint(df, also)
        path = self._done(step, mark)
        if path is None:
            self.started.append(step)
            path, seen = f"{self.path}/results/{step}-{uuid.uuid4().hex}", Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            row = self.spark.sql("SELECT :step AS step, :mark AS fingerprint, :path AS path, CAST(:rows AS BIGINT) AS rows, current_timestamp() AS created",
                                 args={"step": step, "mark": mark, "path": path, "rows": seen.get["rows"]})
            row.coalesce(1).write.mode("append").parquet(f"{self.path}/steps")
        else:
            self.reused.append(step)
        return self.spark.read.schema(df.schema).parquet(path)


def run_pipeline(ledger: Ledger, steps: list[tuple[str, Callable[..., DataFrame], list[str]]]) -> dict[str, DataFrame]:
    """Run steps in order, each ``(name, function, names of the steps that it reads)``, and return every step's result.

    A step named twice and one that reads a later step are errors.
    """
    results: dict[str, DataFrame] = {}
    for name, make, reads in steps:
        if name in results:
            raise ValueError(f"two steps are named {name}")
        missing = [r for r in reads if r not in results]
        if missing:
            raise ValueError(f"{name} reads {', '.join(missing)}, which no step before it makes")
        results[name] = ledger.run(name, lambda make=make, reads=reads: make(*[results[r] for r in reads]))
    return results
