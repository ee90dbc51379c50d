"""Files read one by one, with a row for each that cannot be read; as an operator over a listing and as a data source.

Bodies are read by the executors through the file system that a path names (a local one if it names none). What goes
wrong with one file (it is gone, locked, too large or takes too long) is a row with `error` set and no content; the
others are read all the same. `sealed` encrypts bodies in the same stage, so that no plaintext leaves the task.
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import scalars as S

MOST_BYTES, TIMEOUT, TOGETHER = 10 << 20, 30.0, 16
FILE = "path string, file_size_bytes long, content binary, error string"
ARROW = pa.schema([("path", pa.string()), ("file_size_bytes", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def read_one(path: str, most: int = MOST_BYTES, timeout: float = TIMEOUT) -> tuple[int | None, bytes | None, str | None]:
    """size, content and error of a file; error is missing, too_large, timeout or the name of what was raised."""

    def body():
        where, at = located(path)
        with where.open_input_file(at) as f:
            size = f.size()
            return size, f.read() if size <= most else None

    pool = ThreadPoolExecutor(1)
    try:
        size, content = pool.submit(body).result(timeout)
        return size, content, None if content is not None else "too_large"
    except FileNotFoundError:
        return None, None, "missing"
    except Late:
        return None, None, "timeout"
    except Exception as e:  # one file's fault is that file's row
        return None, None, type(e).__name__
    finally:
        pool.shutdown(wait=False)


def batches(paths, most: int, timeout: float):
    """A batch a file: no two bodies are held at once."""
    for p in paths:
        size, content, error = read_one(p, most, timeout) if p is not None else (None, None, "missing")
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((p, size, content, error), ARROW)], schema=ARROW)


def fetched(listing: DataFrame, most: int = MOST_BYTES, timeout: float = TIMEOUT) -> DataFrame:
    """path, file_size_bytes, content and error of every row of a listing (path); a path that is null is missing."""

    def run(it):
        for b in it:
            yield from batches(b.column(0).to_pylist(), most, timeout)

    return listing.select(F.col("path").cast("string")).mapInArrow(run, FILE)


def sealed(files: DataFrame, dek: Column, kek: Column) -> DataFrame:
    """The files with `sealed` (see functions.scalars.seal) in place of their content; null where there is an error."""
    return files.withColumn("sealed", F.when(F.col("content").isNotNull(), S.seal(F.col("content"), dek, kek))).drop("content")


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Listed:
    """Listing of a folder: paths in the order of (time of change, path)."""

    def __init__(self, options: dict):
        self.folder, self.most, self.timeout = options["path"], int(options.get("mostBytes", MOST_BYTES)), float(options.get("timeout", TIMEOUT))
        self.endings = tuple(e for e in options.get("extensions", "").split(",") if e)

    def listed(self) -> list[tuple[int, str]]:
        where, at = located(self.folder)
        if isinstance(where, fs.LocalFileSystem):  # links that lead nowhere are files that cannot be read
            found = [(os.lstat(p).st_mtime_ns, p) for d, _, names in os.walk(at) for n in names for p in [os.path.join(d, n)]]
        else:
            scheme = self.folder.split("://")[0] + "://"
            found = [(i.mtime_ns or 0, scheme + i.path) for i in where.get_file_info(fs.FileSelector(at, recursive=True)) if i.type != fs.FileType.Directory]
        hidden = lambda p: os.path.basename(p)[:1] in "._"
        return sorted(f for f in found if not hidden(f[1]) and (not self.endings or f[1].endswith(self.endings)))

    def parts(self, paths: list[str]) -> list[Files]:
        return [Files(paths[i : i + TOGETHER]) for i in range(0, len(paths), TOGETHER)]

    def read(self, partition):
        yield from batches(partition.paths if partition else [], self.most, self.timeout)


class _Batch(_Listed, DataSourceReader):
    def partitions(self):
        return self.parts([p for _, p in self.listed()])


class _Stream(_Listed, DataSourceStreamReader):
    """Offsets are (time of change, path) of the last file: a file counts once, and again when it changes."""

    def initialOffset(self) -> dict:
        return {"at": json.dumps([0, ""])}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"at": json.dumps(files[-1] if files else [0, ""])}

    def partitions(self, start: dict, end: dict):
        low, high = tuple(json.loads(start["at"])), tuple(json.loads(end["at"]))
        return self.parts([p for t, p in self.listed() if low < (t, p) <= high])

    def commit(self, end: dict) -> None:
        pass


class TolerantFiles(DataSource):
    """Format `tolerant_files`: FILE rows of a folder (option path; extensions, mostBytes, timeout), for read and readStream."""

    @classmethod
    def name(cls) -> str:
        return "tolerant_files"

    def schema(self) -> str:
        return FILE

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TolerantFiles)
