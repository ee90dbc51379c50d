"""Files that cannot be read, sealed streams, archives by executors, and pushes with counters."""

import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwork.functions import scalars as S
from siftwork.sources import bundles, fetch
from siftwork.streaming import push


def folder(tmp_path):
    (tmp_path / "in/d").mkdir(parents=True)
    (tmp_path / "in/a.py").write_text("x = 1")
    (tmp_path / "in/d/b.py").write_bytes(b"\xff\x00")
    (tmp_path / "in/large.py").write_bytes(b"y" * 5000)
    (tmp_path / "in/empty.py").write_text("")
    (tmp_path / "in/gone.py").symlink_to(tmp_path / "nowhere")
    (tmp_path / "in/locked.py").symlink_to("locked.py")  # no one can open it, not even root
    (tmp_path / "in/other.txt").write_text("z")
    return str(tmp_path / "in")


WANT = {"a.py": (5, b"x = 1", None), "d/b.py": (2, b"\xff\x00", None), "large.py": (5000, None, "too_large"), "empty.py": (0, b"", None), "gone.py": (None, None, "missing"), "locked.py": (None, None, "OSError")}


def seen(df, at):
    return {os.path.relpath(r.path, at): (r.file_size_bytes, None if r.content is None else bytes(r.content), r.error) for r in df.collect()}


def test_each_unreadable_file_is_a_row(spark, tmp_path):
    at = folder(tmp_path)
    listing = spark.createDataFrame([(f"{at}/{n}",) for n in WANT] + [(f"file:{at}/a.py",), (f"{at}/d",), (f"{at}/never.py",), (None,)], "path string")
    rows = fetch.fetched(listing, most=1000).collect()
    got = {r.path: (r.file_size_bytes, None if r.content is None else bytes(r.content), r.error) for r in rows}
    assert len(rows) == len(WANT) + 4 and {n: got[f"{at}/{n}"] for n in WANT} == WANT
    assert got[f"file:{at}/a.py"] == WANT["a.py"] and got[f"{at}/never.py"][2] == "missing" and got[None][2] == "missing" and got[f"{at}/d"][1] is None and got[f"{at}/d"][2]
    fetch.register(spark)
    source = spark.read.format("tolerant_files").option("extensions", ".py").option("mostBytes", 1000)
    assert seen(source.load(at), at) == WANT
    (tmp_path / "none").mkdir()
    assert source.load(str(tmp_path / "none")).count() == 0


def test_slow_files_time_out(monkeypatch):
    monkeypatch.setattr(fetch, "located", lambda p: time.sleep(1))
    assert fetch.read_one("/x", timeout=0.05) == (None, None, "timeout")


def test_stream_commits_offsets_and_seals(spark, tmp_path):
    """Each file once, also after a restart; changed files again; bodies are sealed, errors have none."""
    at = folder(tmp_path)
    fetch.register(spark)
    dek, kek = F.lit("0" * 32).cast("binary"), F.lit("1" * 32).cast("binary")

    def run():
        out = []
        files = spark.readStream.format("tolerant_files").option("path", at).option("extensions", ".py").option("mostBytes", 1000).load()
        sealed = fetch.sealed(files, dek, kek).withColumn("again", S.unseal(F.col("sealed"), kek)).withColumn("intact", F.sha2(F.col("sealed.ciphertext"), 256) == F.col("sealed.ciphertext_sha256"))
        sealed.writeStream.foreachBatch(lambda b, i: out.extend(b.collect()) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return {os.path.relpath(r.path, at): (None if r.again is None else bytes(r.again), r.intact, r.error) for r in out}

    assert run() == {n: (c, None if c is None else True, e) for n, (_, c, e) in WANT.items()}
    assert run() == {}
    (tmp_path / "in/new.py").write_text("n")
    (tmp_path / "in/a.py").write_text("x = 2")
    assert run() == {"new.py": (b"n", True, None), "a.py": (b"x = 2", True, None)}


def test_archives(spark, tmp_path):
    """An archive a task, equal bytes for equal files, again over what is there; unreadable ones are rows."""
    rows = [(1, "main.tf", "a", "hybrid"), (1, "roles/x/main.yml", "b", "hybrid"), (1, "deploy.sh", None, "hybrid"), (2, "main.tf", "ü", None), (2, "main.tf", "t", None), (None, "main.tf", "x", None)]
    files = spark.createDataFrame(rows, "task_id int, file string, body string, method string")
    at = str(tmp_path / "out")
    for order in (1, 3):
        got = {r.task_id: r for r in bundles.write_bundles(files.repartition(order), at).collect()}
        assert {k: (r.files, r.error) for k, r in got.items()} == {"1": (3, None), "2": (2, None)}
        bytes_of = {n: (tmp_path / "out" / n).read_bytes() for n in sorted(os.listdir(at))}
        assert list(bytes_of) == ["bundle-1.zip", "bundle-2.zip"] and (order == 1 or bytes_of == before)
        before = bytes_of
    with zipfile.ZipFile(tmp_path / "out/bundle-1.zip") as z:
        assert z.namelist() == ["README.md", "ansible/roles/x/main.yml", "terraform/main.tf"] and b"Method: hybrid" in z.read("README.md")
    (tmp_path / "out/bundle-3.zip").write_text("no archive")
    tasks = spark.createDataFrame([(1,), (2,), (3,), (4,)], "task_id int")
    back = {(os.path.basename(r.path), r.name): (r.body, r.error) for r in bundles.read_bundles(bundles.archives(spark, tasks, at)).collect()}
    assert back["bundle-1.zip", "terraform/main.tf"] == ("a", None) and back["bundle-2.zip", "terraform/main.tf"] == ("ü", None)
    assert back["bundle-3.zip", None] == (None, "no_archive") and back["bundle-4.zip", None] == (None, "missing")
    assert bundles.write_bundles(files.limit(0), at).count() == 0
    (tmp_path / "out/bundle-7.zip").mkdir()
    (tmp_path / "out/bundle-7.zip/x").write_text("in the way")
    blocked = bundles.write_bundles(spark.createDataFrame([(7, "main.tf", "a", "m")], files.schema), at).first()
    assert blocked.error and blocked.task_id == "7"


def receiver(row):
    if row["k"] % 5 == 0:
        raise TimeoutError
    return "ok" if row["k"] % 3 else "no"


@pytest.mark.parametrize("batches", [1, 4])
def test_counters_equal_the_rows(spark, tmp_path, batches):
    for i in range(batches):
        spark.range(i * 30, i * 30 + 30).select(F.col("id").alias("k"), F.lit(7).alias("size")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, size int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []

    def broken(rows, number):
        raise KeyError(number)

    sinks = {"broken": broken, "rows": lambda rows, number: got.extend(rows.collect())}
    rows, counters, raised = push.push(stream, receiver, str(tmp_path / "at"), "size", sinks)
    every, n = rows.collect(), 30 * batches
    by = {s: sum(r.status == s for r in every) for s in ("sent", "rejected", "failed")}
    assert counters == {"files": n, "files_sent": by["sent"], "files_rejected": by["rejected"], "errors": by["failed"], "bytes_sent": 7 * by["sent"]}
    assert all(r.status == ("failed" if r.k % 5 == 0 else "sent" if r.k % 3 else "rejected") for r in every) and {r.error for r in every} == {None, "TimeoutError"}
    assert sorted(r.k for r in got) == list(range(n)) and raised == [("broken", i, "KeyError") for i in range(batches)]
    assert [r.files_so_far for r in push.progress(rows, "k", "t").orderBy("files_so_far").collect()] == list(range(10, n + 1, 10))
    again = push.push(stream, receiver, str(tmp_path / "at"), "size", sinks)
    assert again[0].count() == 0 and set(again[1].values()) == {0}
