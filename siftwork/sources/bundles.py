"""Generated files as archives: one a task, written by the executors into a shared folder, and read again."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fetch import fetched, located

WRITTEN = pa.schema([("task_id", pa.string()), ("path", pa.string()), ("files", pa.int64()), ("bytes", pa.int64()), ("error", pa.string())])
EPOCH = (1980, 1, 1, 0, 0, 0)


def section(file):
    """Where a file lies in its archive: ansible/ for playbooks, else terraform/."""
    kind = F.when(file.endswith(".yml"), "ansible/").otherwise("terraform/")
    return F.concat(kind, file)


def packed(files: list[tuple[str, str]]) -> bytes:
    """A ZIP of (name, text) in the order of names; equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in sorted(files):
            z.writestr(zipfile.ZipInfo(name, EPOCH), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def readme(task: str, method: str, names: list[str]) -> str:
    return f"# Files of task {task}\n\nMethod: {method}\n\n" + "".join(f"- {n}\n" for n in sorted(names))


def archive_name(task):
    return F.concat(F.lit("bundle-"), task.cast("string"), F.lit(".zip"))


def write_bundles(files: DataFrame, folder: str) -> DataFrame:
    """task_id, path, files, bytes and error of the archive of each task; computing the rows writes the archives.

    files: task_id, file, body, method. An archive is written under a name of its own and then renamed, so that a reader sees it
    whole or not at all, and a task that runs twice leaves one. Rows without a body are left out of it; of
    rows with one name the greatest body stays. A task whose archive cannot be written has `error`, and no archive."""
    where, at = located(folder)
    where.create_dir(at, recursive=True)

    def run(key, t):
        task = key[0].as_py()
        named = {n: b for n, b in sorted(zip(t.column("name").to_pylist(), t.column("body").to_pylist()), key=lambda r: (r[0] or "", r[1] or "")) if n is not None and b is not None}
        method = max((m for m in t.column("method").to_pylist() if m), default="unknown")
        body = packed([*named.items(), ("README.md", readme(task, method, list(named)))])
        where, at = located(folder)
        path, draft = f"{at}/bundle-{task}.zip", f"{at}/.{uuid.uuid4().hex}"
        error = None
        try:
            with where.open_output_stream(draft) as f:
                f.write(body)
            if where.get_file_info(path).type == fs.FileType.File and not isinstance(where, fs.LocalFileSystem):
                where.delete_file(path)  # only local renames replace
            where.move(draft, path)
        except Exception as e:  # one archive's fault is that archive's row
            error = type(e).__name__
        row = (task, path, len(named) + 1, len(body), error)
        return pa.table([pa.array([v], type=f.type) for v, f in zip(row, WRITTEN)], schema=WRITTEN)

    rows = files.where("task_id IS NOT NULL").select(F.col("task_id").cast("string").alias("task_id"), section(F.col("file")).alias("name"), "body", "method")
    return rows.groupBy("task_id").applyInArrow(run, "task_id string, path string, files long, bytes long, error string")


def read_bundles(listing: DataFrame) -> DataFrame:
    """path, name, body and error of each file in the archives of a listing (path); one row with an error for an archive that
    is missing or no archive."""

    def run(it):
        names = ["path", "name", "body", "error"]
        for b in it:
            for path, content, error in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("error").to_pylist()):
                rows = [(path, None, None, error)]
                if content is not None:
                    try:
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            rows = [(path, n, z.read(n).decode("utf-8", "replace"), None) for n in z.namelist()]
                    except zipfile.BadZipFile:
                        rows = [(path, None, None, "no_archive")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=names)

    return fetched(listing).mapInArrow(run, "path string, name string, body string, error string")


def archives(spark: SparkSession, tasks: DataFrame, folder: str) -> DataFrame:
    """A listing of where the archives of tasks (task_id) are, if there are any."""
    return tasks.select(F.concat(F.lit(folder + "/"), archive_name(F.col("task_id"))).alias("path"))
