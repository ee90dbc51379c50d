"""The driver's tables in the shape of files, nodes and messages, with the SQL of the same shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.scalars import choose

KINDS = {"signup": "Import", "view": "Call", "click": "Assign", "purchase": "Global", "error": "Await"}
FLAGS = ["has_exec_calls", "has_eval_calls", "has_dynamic_imports", "has_network_calls", "has_file_io", "has_privilege_calls", "has_obfuscation", "has_high_entropy", "has_injection_risk", "has_deserialisation", "has_concurrency", "has_pickle_gadgets", "has_native_lib_load", "has_tainted_exec", "has_del_hook", "has_weakref_hooks"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the nodes of a file, in time order; the tree is that of a binary heap."""
    e = events(spark, sf_dir)
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = e.select("user_id", "event_id", "k", "value", choose(F.col("event_type"), KINDS).alias("node_type"), idx.alias("idx"))
    return e.withColumns({"parent_idx": F.when(F.col("idx") > 0, F.floor((F.col("idx") - 1) / 2).cast("int")), "depth": F.col("k") % 8})


NODES_SQL = """n0 AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INT) AS k, value, event_type,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx FROM events),
n1 AS (SELECT *, CASE WHEN idx > 0 THEN (idx - 1) // 2 END AS parent_idx, k % 8 AS depth,
  CASE event_type WHEN 'signup' THEN 'IMPORT' WHEN 'view' THEN 'CALL' WHEN 'click' THEN 'ASSIGN' WHEN 'purchase' THEN 'GLOBAL' ELSE 'AWAIT' END AS ir_type,
  CASE event_type WHEN 'signup' THEN 'dependency' WHEN 'view' THEN 'execution' WHEN 'click' THEN 'data_flow' WHEN 'purchase' THEN 'scope' ELSE 'async' END AS category,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 2 WHEN 'click' THEN 0 WHEN 'purchase' THEN 9 ELSE 1 END AS risk_level FROM n0)"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with properties and types by k, so that every pattern occurs in some file."""
    d = nodes(spark, sf_dir).withColumn("m", F.pmod(F.col("k") * 7 + F.col("user_id"), F.lit(120)))
    kinds = ["IMPORT", "CALL", "ASSIGN", "GLOBAL", "AWAIT", "DYNAMIC", "NETWORK", "PRIVILEGE", "OBFUSC", "DESER", "HOOK", "CONCUR", "CATCH", "PASS", "FUNC_DEF", "TAINTED_EXEC", "IO", "NATIVE_LOAD"]
    kind = F.get(F.array(*map(F.lit, kinds)), F.col("m"))
    flag = F.get(F.array(*map(F.lit, FLAGS)), F.col("m") - 20)
    props = F.map_from_arrays(F.array(F.lit("arg_count"), F.coalesce(flag, F.lit("none"))), F.array((F.col("k") % 9).cast("string"), F.lit("true")))
    return d.select("user_id", "idx", "parent_idx", "depth", F.coalesce(kind, F.lit("CALL")).alias("ir_type"), F.when(F.col("m") == 18, "network").when(F.col("m") == 19, "io").otherwise("execution").alias("category"), F.when((F.col("m") == 5) & (F.col("k") % 2 == 0), "exec_detected").alias("source"), props.alias("props"))


MIXED_SQL = NODES_SQL + """,
m0 AS (SELECT user_id, idx, parent_idx, depth, k, (k * 7 + user_id) % 120 AS m FROM n1),
m1 AS (SELECT *, coalesce((['IMPORT','CALL','ASSIGN','GLOBAL','AWAIT','DYNAMIC','NETWORK','PRIVILEGE','OBFUSC','DESER','HOOK','CONCUR','CATCH','PASS','FUNC_DEF','TAINTED_EXEC','IO','NATIVE_LOAD'])[m + 1], 'CALL') AS t,
  CASE WHEN m = 18 THEN 'network' WHEN m = 19 THEN 'io' ELSE 'execution' END AS c, k % 9 AS args, coalesce(m = 5 AND k % 2 = 0, false) AS found,
  CASE WHEN m >= 20 THEN (['""" + "','".join(FLAGS) + """'])[m - 19] END AS f FROM m0)"""  # fmt: skip


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a user: which flags its events raise."""
    e = events(spark, sf_dir)
    return e.groupBy("user_id").agg(*[F.max((F.col("k") == i) & (F.col("event_type") == "error")).alias(k) for i, k in enumerate(FLAGS)], F.count("*").alias("events"))


FLAGS_SQL = "fl AS (SELECT user_id, count(*) AS events, " + ", ".join(f"max(CASE WHEN CAST(json_extract(props, '$.k') AS INT) = {i} AND event_type = 'error' THEN 1 ELSE 0 END) = 1 AS {k}" for i, k in enumerate(FLAGS)) + " FROM events GROUP BY user_id)"

EXTENSIONS = [*L.PARSERS, ".yaml", ".json", ".exe", ".md"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: an extension by doc_id, the user of the same number modulo as batch."""
    d = table(spark, sf_dir, "documents")
    ext = F.get(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return d.select("doc_id", "text", "lang", "source", "n_chars", ext.alias("file_extension"))


FILES_SQL = "fs AS (SELECT *, (['" + "','".join(EXTENSIONS) + f"'])[doc_id % {len(EXTENSIONS)} + 1] AS file_extension FROM documents)"
