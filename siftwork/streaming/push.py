"""Rows sent one by one to a receiver, with counters, progress rows and sinks that cannot harm each other."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

COUNTERS = ("files", "files_sent", "files_rejected", "errors", "bytes_sent")
EVERY = 10


def sent(files: DataFrame, send: Callable[[dict], str], size: str) -> DataFrame:
    """Adds status: sent, if send(row) returns ok; rejected, if anything else; failed, if it raises, with the kind of error.

    `send` is called once a row, on the executors. `size` names the column of a row's bytes."""
    schema = StructType([*files.schema, StructField("status", StringType()), StructField("error", StringType())])

    def run(it):
        for b in it:
            status, errors = [], []
            for row in b.to_pylist():
                try:
                    status.append("sent" if send(row) == "ok" else "rejected")
                    errors.append(None)
                except Exception as e:  # one row's fault is that row's status
                    status.append("failed")
                    errors.append(type(e).__name__)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(status, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "status", "error"])

    done = files.mapInArrow(run, schema)
    count = lambda s: F.count_if(F.col("status") == s)
    ok = F.col("status") == "sent"
    return done.observe("push", F.count("*").alias("files"), count("sent").alias("files_sent"), count("rejected").alias("files_rejected"), count("failed").alias("errors"), F.coalesce(F.sum(F.when(ok, F.col(size))), F.lit(0)).cast("long").alias("bytes_sent"))


class Counters(StreamingQueryListener):
    """Adds up what the batches of one run observed."""

    def __init__(self):
        self.total, self.run, self.ended = dict.fromkeys(COUNTERS, 0), None, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("push")
        if seen is not None and str(event.progress.runId) == self.run:
            for k in COUNTERS:
                self.total[k] += seen[k] or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended |= str(event.runId) == self.run


def progress(acknowledged: DataFrame, index: str, task: str, every: int = EVERY) -> DataFrame:
    """An event row for every tenth file (by its index from 0)."""
    rows = acknowledged.where((F.col(index) + 1) % every == 0)
    return rows.select(F.lit(task).alias("task_id"), F.lit("stage_update").alias("type"), F.lit("fetch").alias("stage"), F.lit("running").alias("status"), (F.col(index) + 1).alias("files_so_far"))


def push(stream: DataFrame, send: Callable[[dict], str], at: str, size: str, sinks: dict[str, Callable[[DataFrame, int], None]]) -> tuple[DataFrame, dict[str, int], list[tuple]]:
    """Sends a stream to its end. Returns the acknowledged rows, the run's counters and what sinks raised, as (sink, batch, kind).

    Each batch is sent once and written below `at` before anything else sees it; then every sink gets it. A sink that raises
    is noted, and neither the stream nor the other sinks notice. Started again with the same `at`, the stream goes on."""
    spark: SparkSession = stream.sparkSession
    counters, raised, written = Counters(), [], []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/acknowledged/b{number}")
        written.append(number)
        rows = spark.read.schema(batch.schema).parquet(f"{at}/acknowledged/b{number}")
        for name, sink in sinks.items():
            try:
                sink(rows, number)
            except Exception as e:
                raised.append((name, number, type(e).__name__))

    spark.streams.addListener(counters)
    try:
        out = sent(stream, send, size)
        run = out.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        query = run.start()
        counters.run = str(query.runId)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)  # what was observed arrives by the bus
    finally:
        spark.streams.removeListener(counters)
    rows = spark.read.schema(out.schema).parquet(*[f"{at}/acknowledged/b{n}" for n in written]) if written else spark.createDataFrame([], out.schema)
    return rows, counters.total, raised
