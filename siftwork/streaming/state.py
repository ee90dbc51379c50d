"""Streaming operators over events: windows, sessions, latest values, machine lifecycles, waits and replays.

Each takes a streaming (or, for tests and batch queries, a static) DataFrame with an event time and gives a
DataFrame; `collected` runs one to the end of what there is and returns the result as a table.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import is_folder, new_folder
from . import ordered

LIFETIME = 3600.0


def events(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """The events table as a stream with an event time."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return stream.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder)


def collected(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs the stream over all there is and returns what it gave, from files; nothing gathers on the driver.

    In mode `complete` that is the last batch; else all rows, or with `keys` the last row of each."""
    spark = stream.sparkSession
    at = new_folder(spark, "stream")
    written: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/b{number}")
        written.append(number)

    with rocks(spark):
        run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(*[f"{at}/b{n}" for n in (written[-1:] if mode == "complete" else sorted(set(written)))])
    if keys and len(set(written)) > 1:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "_batch").alias("r")).select(*keys, "r.*")
    return rows.select(*stream.columns)


@contextlib.contextmanager
def rocks(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which transformWithState needs; the session's setting is put back."""
    key, value = ordered.PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def tumbling(stream: DataFrame, key: str, width: str, late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")


def sessions(stream: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(stream: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each key: caches, stage states, task results."""
    return stream.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))


def in_time(messages: DataFrame, sent: Column, received: Column, age: int = 60, skew: int = 5) -> tuple[DataFrame, DataFrame]:
    """(messages within the replay window, the others); neither needs state."""
    ok = F.coalesce((received - sent <= age) & (received - sent >= -skew), F.lit(False))
    return messages.where(ok), messages.where(~ok)


def machines(stream: DataFrame, key: str, kind: str, seconds: str, begins: str, ends: str, lifetime: float = LIFETIME) -> DataFrame:
    """Lifecycles: a key begins, and ends by its end event or, when a later event of the key shows that its time is
    over, by timeout. An end before any beginning counts as a termination of unknown start; at one instant a beginning comes first.

    The first beginning, the first end and the newest event of a key decide, so that neither its number of rows nor
    the order in which they arrive matters. State is these three numbers a key; events without a key are no machine's."""
    k, s = F.col(kind), F.col(seconds).cast("double")
    seen = stream.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.min(F.when(k == begins, s)).alias("first"), F.min(F.when(k == ends, s)).alias("done"), F.max(s).alias("newest"))
    orphan = F.col("done").isNotNull() & (F.col("first").isNull() | (F.col("done") < F.col("first")))
    m = seen.withColumn("created", F.when(~orphan, F.col("first")))
    reason = F.when(orphan, "orphan").when(F.col("done") - F.col("created") <= lifetime, "requested").when(F.col("newest") - F.col("created") > lifetime, "timeout")
    m = m.withColumn("reason", reason)
    ended = F.when(F.col("reason") == "timeout", F.col("created") + lifetime).when(F.col("reason").isNotNull(), F.col("done"))
    state = F.when(ended.isNotNull(), "terminated").when(F.col("created").isNotNull(), "running").otherwise("unknown")
    return m.select("key", state.alias("state"), "created", ended.alias("ended"), "reason")


def running(states: DataFrame, now: Column) -> DataFrame:
    """Machines that run, with their age."""
    return states.where(F.col("state") == "running").withColumn("age", F.round(now - F.col("created"), 1))


def answers(requests: DataFrame, responses: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests with the response of their id that comes within `wait`; those without are expired."""
    a = requests.select("request_id", F.col("ts").alias("asked")).withWatermark("asked", late)
    b = responses.select(F.col("request_id").alias("answer_id"), "decision", F.col("ts").alias("answered")).withWatermark("answered", late)
    on = F.expr(f"request_id = answer_id AND answered >= asked AND answered <= asked + INTERVAL {wait}")
    return a.join(b, on, "leftOuter").withColumn("expired", F.col("answer_id").isNull())


def resolve(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts with the first decision for each; only pending ones change, and decisions must be known words."""
    word = F.upper(F.trim("decision"))
    first = decisions.where(word.isin("APPROVE", "REJECT", "QUARANTINE")).groupBy("alert_id").agg(F.min_by(word, "ts").alias("decision"))
    joined = alerts.join(first, "alert_id", "left")
    open_ = F.col("status") == "pending"
    return joined.withColumns({"resolved": open_ & F.col("decision").isNotNull(), "status": F.when(open_ & F.col("decision").isNotNull(), F.lit("resolved")).otherwise(F.col("status"))})


def upsert(stream: DataFrame, path: str, key: str, order: str):
    """A foreachBatch writer that keeps the newest row of each key at `path`, swapping complete versions."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{number - 1}"
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.parquet(old))
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(write).trigger(availableNow=True)


def stage_order(status: Column) -> Column:
    return F.when(status == "pending", 0).when(status == "running", 1).otherwise(2)
