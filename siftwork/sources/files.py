"""Readers of files, JSON lines and repository listings, and the writers that go with them."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S

AUDIT = "seq long, ts double, ts_iso string, event string, severity string, task_id string, vm_id string, agent_role string, stage string, message string, data string, prev_hash string, chain_hash string"
TRAINING = "ir_sequence string, feature_vector array<double>, labels array<double>, risk_level double, threat_class string, sequence_length int, token_counts map<string,int>"
MOST_FILES, MOST_BYTES, MOST_MESSAGE = 500, 10 << 20, 10 << 20


def listing(entries: DataFrame, order: str, most: int = MOST_FILES, size: int = MOST_BYTES) -> DataFrame:
    """Of a tree listing (path, type, size and an order): files with a parser, not too large, the first `most`."""
    ext = S.extension(F.col("path"))
    return entries.where((F.col("type") == "blob") & ext.isin(*L.PARSERS) & (F.col("size") <= size)).orderBy(order).limit(most).withColumn("extension", ext)


def source_files(spark: SparkSession, folder: str, size: int = MOST_BYTES) -> DataFrame:
    """file_index, path, extension, file_size_bytes and content of the files below a folder; large ones are not read."""
    from ..operators import history

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= size)
    index = history.placed(files.select("path"), "path", "file_index")  # a row a file; contents are not part of the sort
    return files.join(index, "path").select("file_index", "path", S.extension(F.col("path")).alias("extension"), F.col("length").alias("file_size_bytes"), "content")


def stream_files(spark: SparkSession, folder: str, a_trigger: int = 10) -> DataFrame:
    """The same files as a stream, a few at each trigger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", a_trigger).load(folder)


def fetch_counters(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files_fetched"), F.count_if(F.col("content").isNotNull()).alias("files_encrypted"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes_fetched"), F.count_if(F.col("content").isNull()).alias("errors"))


def read_records(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """JSON lines; blank and malformed ones go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("overwrite").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, TRAINING)


def routed(messages: DataFrame, body: str = "body") -> DataFrame:
    """Adds message_type, and accepted: whether a message is small enough and names its type."""
    kind = F.get_json_object(body, "$.header.message_type")
    return messages.withColumns({"message_type": kind, "accepted": (F.octet_length(body) <= MOST_MESSAGE) & kind.isNotNull()})


def checked_extension(files: DataFrame, column: str = "file_extension") -> tuple[DataFrame, DataFrame]:
    """(rows with an allowed extension in lower case, the others)."""
    low = files.withColumn(column, F.lower(column))
    ok = F.coalesce(F.col(column).isin(*L.ALLOWED), F.lit(False))
    return low.where(ok), low.where(~ok)


def bundle_file(bundle: Column, path: str) -> Column:
    """One file of a MAP from section/path to text."""
    return F.try_element_at(bundle, F.lit(path))


def local_name(path: Column, declarative: bool = True) -> Column:
    """Where a generated file goes: declarative ones lose their folders."""
    return F.element_at(F.split(path, "/"), -1) if declarative else path


def archive(files: dict[str, str]) -> bytes:
    """A ZIP of a bundle that is on the driver already."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in sorted(files.items()):
            z.writestr(name, text)
    return out.getvalue()


def write_bundle(files: dict[str, str], folder: str) -> None:
    for name, text in files.items():
        at = os.path.join(folder, os.path.basename(name) if name.endswith(".tf") else name)
        os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)
