"""Run history: append-only Parquet tables, a directory per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from semaspark.operators.verify import latest_baseline, next_run_id

TABLES = {
    "runs": "run_id string, seq int, as_of date, runner string, runner_version string",
    "inputs": "input_id string, kind string, version string, owner string, path string",
    "elements": "element_id string, kind string, facet string, version string, input_id string, location string, params map<string,string>",
    "results": "agent string, test_id string, status string, truth_hash string, answer_hash string, tags array<string>, rule_ids array<string>",
    "deps": "agent string, test_id string, element_id string, facets array<string>, role string, rank int",
    "baselines": "test_id string, seq int, truth_hash string",
}
SCHEMA_VERSION = 1


class History:
    """Runs under one directory, each appended as a partition."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/v{SCHEMA_VERSION}"

    def _all(self, table: str) -> DataFrame:
        schema = TABLES[table] if table in ("runs", "baselines") else f"{TABLES[table]}, run_id string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def record(self, frames: dict[str, DataFrame], as_of: str, runner: str, runner_version: str, rebaseline: bool = False) -> str:
        """Append a run; tests without a baseline, or all of them, get one."""
        runs = self._all("runs")
        run_id = next_run_id(runs)
        seq = int(run_id.rpartition("-")[2])
        for table in ("inputs", "elements", "results", "deps"):
            if table in frames:
                # What a run that broke off has left under this id is overwritten.
                frames[table].write.mode("overwrite").parquet(f"{self.root}/{table}/run_id={run_id}")
        # The run's own row makes the run; baselines only come from runs that are there.
        self.spark.createDataFrame([(run_id, seq, as_of, runner, runner_version)], "run_id string, seq int, as_of string, runner string, runner_version string").withColumn("as_of", F.to_date("as_of")).write.mode("append").parquet(f"{self.root}/runs")
        results = self.load(run_id, "results").select("test_id", F.lit(seq).alias("seq"), "truth_hash").where("truth_hash IS NOT NULL")
        new = results if rebaseline else results.join(self.baselines(), "test_id", "left_anti")
        new.write.mode("append").parquet(f"{self.root}/baselines")
        return run_id

    def all_results(self) -> DataFrame:
        """Results of all recorded runs."""
        return self._all("results").join(self._all("runs").select("run_id"), "run_id", "left_semi")

    def load(self, run_id: str, table: str) -> DataFrame:
        return self._all(table).where(F.col("run_id") == run_id)

    def runs(self) -> DataFrame:
        return self._all("runs").orderBy("seq")

    def baselines(self) -> DataFrame:
        return latest_baseline(self._all("baselines"))
