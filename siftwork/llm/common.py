"""Shared helpers: table reading, keys and per-document iteration of Arrow batches."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo `folds`; null ids fall in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


#: Rows that cross to Python together: texts can be long, so far fewer than Spark's own default.
ROWS_TOGETHER = 500


def bounded(docs: DataFrame) -> DataFrame:
    """`docs`, with the session's Arrow batches kept to ROWS_TOGETHER rows.

    Plans read this setting when they run, so it stays for the session; a smaller one of the caller's is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(key)) <= ROWS_TOGETHER:
        docs.sparkSession.conf.set(key, str(ROWS_TOGETHER))
    return docs


def release() -> None:
    """Gives memory that a worker no longer needs back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def batches(it, *names):
    """Yields, for each Arrow batch, the named columns as Python lists; gives memory back at the end."""
    for b in it:
        if b.num_rows:
            yield [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]
    release()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def sampled(rows: DataFrame, label: str, per_label: int, seed: int = 7) -> DataFrame:
    """About `per_label` rows of each label, chosen by a hash of doc_id.

    The expected size is per_label x labels whatever the input's size, so it may be collected."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per_label / n))).otherwise(share)
    point = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(F.col(label).isNotNull() & (point < share))
