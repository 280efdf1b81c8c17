"""Beyond batch runs: watch ground truth drift as new rows arrive.

Each micro-batch is added to a table, the truth is computed anew, and its
fingerprint is appended to a log when it has moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.utils import AnalysisException

from semaspark.operators.verify import fingerprint


def watch(stream: DataFrame, table: str, log: str, truth: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start watching. Batches are written under their number, so a batch that
    is run again after a failure replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        now = fingerprint(truth(spark.read.parquet(table))).first()
        try:
            last = spark.read.parquet(log).orderBy("batch", ascending=False).select("fingerprint").first()
        except AnalysisException:
            last = None
        if last is None or last[0] != now["fingerprint"]:
            spark.createDataFrame([(number, now["fingerprint"], now["n_rows"])], "batch long, fingerprint string, n_rows long").coalesce(1).write.mode("append").parquet(log)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
