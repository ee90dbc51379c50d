"""Queries that write files, read them back and send them on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dataset as G
from ..operators import records as C
from ..operators import scoring as D
from ..sources import bundles as B
from ..sources import fetch as R
from ..sources import files as W
from ..sources import tables
from ..streaming import push as P
from ..streaming import state as X
from . import decision_queries as Q
from . import record_queries as M
from . import stand_ins as T


def strategies(spark, sf_dir):
    return tables.written(D.strategy(Q.decisions(spark, sf_dir)).select("task_id", "method", "constraints"))


def written_bundles(spark, sf_dir):
    """(strategies, folder) after the executors have written an archive of each task's files there."""
    s, at = strategies(spark, sf_dir), tables.new_folder(spark, "bundles")
    tables.written(B.write_bundles(C.rendered(s).join(s.select("task_id", "method"), "task_id"), at))
    return s, at


def bundle_contents(spark, sf_dir):
    """What the archive of each task holds; a rejected task has none, which is an error of its own row."""
    s, at = written_bundles(spark, sf_dir)
    got = B.read_bundles(B.archives(spark, s, at))
    each = got.groupBy("path").agg(F.max("error").alias("error"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("files"), F.max(F.when(F.col("name") == "README.md", F.regexp_extract("body", "Method: (.*)", 1))).alias("method"))
    return each.select(F.regexp_extract("path", r"bundle-(\d+)\.zip$", 1).cast("long").alias("task_id"), "error", "files", "method")


#: Keys of the round trip; a caller's own keys are arguments of the operators.
FETCH_KEY, WRAP_KEY = "0123456789abcdef0123456789abcdef", "fedcba9876543210fedcba9876543210"


def sealed_stream(spark, sf_dir):
    """Archives as a stream that seals each body where it is read, opened again."""
    _, at = written_bundles(spark, sf_dir)
    R.register(spark)
    files = spark.readStream.format("tolerant_files").option("path", at).option("extensions", ".zip").load()
    dek, kek = F.lit(FETCH_KEY).cast("binary"), F.lit(WRAP_KEY).cast("binary")
    got = X.collected(R.sealed(files, dek, kek), "append")
    again = S.unseal(F.col("sealed"), kek)
    head = F.hex(F.substring(again, 1, 2))
    return got.select(F.regexp_extract("path", r"bundle-(\d+)\.zip$", 1).cast("long").alias("task_id"), "error", (F.octet_length(again) == F.col("file_size_bytes")).alias("whole"), head.alias("head"), (F.sha2(F.col("sealed.ciphertext"), 256) == F.col("sealed.ciphertext_sha256")).alias("intact"))


def parsed(row: dict) -> str:
    """A receiver: it fails on empty files and turns some down."""
    if not row["text"]:
        raise ValueError("nothing to parse")
    return "busy" if row["doc_id"] % 13 == 0 else "ok"


def pushed_files(spark, sf_dir):
    """Counters of documents sent to a receiver, and of the progress rows that a second sink writes beside one that fails."""
    files = X.table_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    at = tables.new_folder(spark, "push")

    def broken(rows, number):
        raise RuntimeError("the receiver of events is gone")

    def events(rows, number):
        P.progress(rows, "doc_id", "task").write.mode("overwrite").parquet(f"{at}/events/b{number}")

    rows, counters, raised = P.push(files, parsed, at, "n_chars", {"broken": broken, "events": events})
    seen = rows.agg(F.count("*").alias("acknowledged"), F.count_if(F.col("error") == "ValueError").alias("value_errors"))
    written = spark.read.parquet(f"{at}/events/*").agg(F.count("*").alias("progress_rows"), F.max("files_so_far").alias("files_so_far"))
    one = seen.crossJoin(written)  # a row each
    return one.select("*", *[F.lit(counters[k]).cast("long").alias(k) for k in P.COUNTERS], F.lit(",".join(sorted({f"{name}:{kind}" for name, _, kind in raised}))).alias("raised"))


def record_lines(spark, sf_dir):
    """Events written as JSON lines and read back beside lines that are blank or no records."""
    e = T.table(spark, sf_dir, "events")
    at = tables.new_folder(spark, "records")
    rows = e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"), F.col("user_id").cast("string").alias("task_id"))
    W.write_records(rows.where("seq % 2 = 0"), at)
    line = F.when(F.col("seq") % 7 == 1, F.lit("")).when(F.col("seq") % 11 == 1, F.concat(F.lit('{"seq": '), F.col("seq").cast("string"))).otherwise(F.to_json(F.struct("seq", "event", "severity", "task_id")))
    rows.where("seq % 2 = 1").select(line.alias("value")).write.mode("append").text(at)
    return W.read_records(spark, at).groupBy("event", "severity").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def saved_samples(spark, sf_dir):
    """Training samples saved as JSON lines and loaded again."""
    at = tables.new_folder(spark, "samples")
    g = G.samples(T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id")))
    counts = F.map_from_entries(F.transform(F.array_distinct("tokens"), lambda t: F.struct(t, F.size(F.filter("tokens", lambda x: x == t)))))
    W.write_samples(g.select(F.array_join("tokens", " ").alias("ir_sequence"), G.feature_vector(F.col("tokens")).alias("feature_vector"), "labels", "risk_level", "threat_class", F.size("tokens").alias("sequence_length"), counts.alias("token_counts")), at)
    back = W.read_samples(spark, at)
    whole = (F.size(F.split("ir_sequence", " ")) == F.col("sequence_length")) & (F.size("feature_vector") == 45) & (F.size("labels") == 6) & (F.aggregate(F.map_values("token_counts"), F.lit(0), lambda a, n: a + n) == F.col("sequence_length"))
    return back.groupBy("threat_class").agg(F.count("*").alias("n"), F.sum("sequence_length").alias("tokens"), F.bool_and(whole).alias("whole"))


def bundle_lookup(spark, sf_dir):
    """Single files of each task's bundle: one that every bundle has, one that few have, one that none has; and where a file goes."""
    s = strategies(spark, sf_dir)
    named = C.rendered(s).select("task_id", F.struct(B.section(F.col("file")), "body").alias("entry"))
    bundles = named.groupBy("task_id").agg(F.map_from_entries(F.collect_list("entry")).alias("bundle"))  # a task's files are few
    has = lambda path: W.bundle_file(F.col("bundle"), path).isNotNull()
    return bundles.select("task_id", has("terraform/main.tf").alias("main"), has("ansible/roles/hardening/tasks/main.yml").alias("role"), has("terraform/none.tf").alias("none"), W.local_name(F.lit("terraform/main.tf")).alias("local"))


def task_results(spark, sf_dir):
    """The newest event of each user, kept by a stream that replaces a user's row when a newer one comes."""
    at = tables.new_folder(spark, "results")
    stream = X.events(spark, sf_dir).select("user_id", "event_id", "event_type")
    X.upsert(stream, at, "user_id", "event_id").option("checkpointLocation", f"{at}/state").start().awaitTermination()
    return spark.read.parquet(f"{at}/v{tables.numbered(spark, at, 'v')[-1]}")


def envelopes(spark, sf_dir):
    """Messages in envelopes: ids that differ, the roles, the task, the version and a time that is now."""
    e = T.table(spark, sf_dir, "events").withColumn("m", C.envelope("FILE", "fetcher", "parser", F.col("user_id").cast("string")))
    m = tables.written(e.select("user_id", "m"))
    now = F.unix_timestamp(F.current_timestamp())
    return m.groupBy("user_id").agg(F.count_distinct("m.message_id").alias("ids"), F.max("m.task_id").alias("task_id"), F.max(F.concat_ws("/", "m.message_type", "m.sender_role", "m.recipient_role", "m.schema_version")).alias("route"), F.bool_and(F.abs(F.col("m.timestamp") - now) < 3600).alias("recent"))


def own_rules(spark, sf_dir):
    """Decisions by rules that a caller gives as data."""
    rules = [("X1", "aggregate_risk > 0.2", "high", False, "watch"), ("X2", "privileged_api_count > 60 AND high_risk_file_count = 0", "critical", True, None)]
    d = D.decide(Q.assessments(spark, sf_dir), rules)
    return d.select("task_id", "decision", "rules_triggered", F.array_join("constraints", ",").alias("constraints"))


QUERIES = {"record_lines": record_lines, "saved_samples": saved_samples, "bundle_lookup": bundle_lookup, "task_results": task_results, "envelopes": envelopes, "own_rules": own_rules, "bundle_contents": bundle_contents, "sealed_stream": sealed_stream, "pushed_files": pushed_files}
_NAME = "CASE WHEN file LIKE '%.yml' THEN 'ansible/' ELSE 'terraform/' END || file"
ORACLE_SQL = {
    "record_lines": "SELECT event_type AS event, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS severity, count(*) AS n, sum(event_id)::BIGINT AS seqs FROM events WHERE event_id % 2 = 0 OR (event_id % 7 <> 1 AND event_id % 11 <> 1) GROUP BY ALL",
    "saved_samples": f"SELECT threat_class, count(*) AS n, sum(length)::BIGINT AS tokens, true AS whole FROM ({M.ORACLE_SQL['training_samples']}) GROUP BY 1",
    "bundle_lookup": Q.STRATEGY + " SELECT task_id, true AS main, method IN ('declarative', 'hybrid') AS role, false AS none, 'main.tf' AS local FROM t1 WHERE method <> 'none'",
    "task_results": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "envelopes": "SELECT user_id, count(*) AS ids, user_id::VARCHAR AS task_id, 'FILE/fetcher/parser/1.0.0' AS route, true AS recent FROM events GROUP BY 1",
    "own_rules": Q.ASSESS + ", r AS (SELECT task_id, aggregate_risk > 0.2::DOUBLE AS a, privileged_api_count > 60 AND high_risk_file_count = 0 AS b FROM asx) SELECT task_id, CASE WHEN b THEN 'REJECT' WHEN a THEN 'APPROVE_WITH_CONSTRAINTS' ELSE 'APPROVE' END AS decision, a::INT + b::INT AS rules_triggered, CASE WHEN a THEN 'watch' ELSE '' END AS constraints FROM r",
    "bundle_contents": Q.ORACLE_SQL["generated_files"].replace(" SELECT task_id, ord, file FROM f0", f", g AS (SELECT task_id, array_to_string(list_sort(list_append(list({_NAME}), 'README.md')), ',') AS files FROM f0 GROUP BY 1) SELECT t1.task_id, CASE WHEN files IS NULL THEN 'missing' END AS error, coalesce(files, '') AS files, CASE WHEN files IS NOT NULL THEN method END AS method FROM t1 LEFT JOIN g ON g.task_id = t1.task_id"),
    "sealed_stream": Q.STRATEGY + " SELECT task_id, CAST(NULL AS VARCHAR) AS error, true AS whole, '504B' AS head, true AS intact FROM t1 WHERE method <> 'none'",
    "pushed_files": "SELECT count(*) AS acknowledged, count(*) FILTER (coalesce(text, '') = '') AS value_errors, count(*) FILTER ((doc_id + 1) % 10 = 0) AS progress_rows, max(doc_id + 1) FILTER ((doc_id + 1) % 10 = 0) AS files_so_far, count(*) AS files, count(*) FILTER (coalesce(text, '') <> '' AND doc_id % 13 <> 0) AS files_sent, count(*) FILTER (coalesce(text, '') <> '' AND doc_id % 13 = 0) AS files_rejected, count(*) FILTER (coalesce(text, '') = '') AS errors, coalesce(sum(n_chars) FILTER (coalesce(text, '') <> '' AND doc_id % 13 <> 0), 0)::BIGINT AS bytes_sent, 'broken:RuntimeError' AS raised FROM documents",
}
