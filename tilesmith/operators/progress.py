"""Counts of a job's rows as they pass, and the table of them: what was planned, read, dropped and lost.

Counts ride on the job that is run anyway (``observe``), so no row is read twice for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "job string, step string, place int, n_rows long, n_failed long, n_dropped long"


class Ledger:
    """Steps of one job, in the order in which they are watched.

    Wrap the DataFrame of each step by ``watch``, run one action over the last, and ask for ``table``. A step that filters is
    compared with the one watched before it: what came and went missing was dropped.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.job, self.steps = spark, job, []

    def watch(self, rows: DataFrame, step: str, failed: Column | None = None) -> DataFrame:
        """rows, counted under the step's name; failed: which are lost, by default those with an error, if there is such a column."""
        if any(step == name for name, _ in self.steps):
            raise ValueError(f"a step {step!r} is watched already")
        if failed is None:
            failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
        seen = Observation(f"{self.job}: {step}")
        self.steps.append((step, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(failed).alias("n_failed"))

    def table(self) -> DataFrame:
        """(job, step, place, n_rows, n_failed, n_dropped), a row for each step; waits for the action. n_dropped of the first is null."""
        out, before = [], None
        for place, (step, seen) in enumerate(self.steps):
            got = seen.get
            out.append((self.job, step, place, got["n_rows"], got["n_failed"], None if before is None else before - got["n_rows"]))
            before = got["n_rows"]
        return self.spark.createDataFrame(out, SCHEMA)

    def write(self, path: str) -> None:
        """Append the table to one of many jobs."""
        self.table().write.mode("append").parquet(path)
