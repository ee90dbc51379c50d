"""Queries over nodes, edges, patterns and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S
from ..operators import nodes as N
from ..operators import patterns as P
from . import stand_ins as T

KEY = ["user_id"]


def classified(spark, sf_dir):
    return N.classify(T.nodes(spark, sf_dir))


def risk_levels(spark, sf_dir):
    return classified(spark, sf_dir).select("event_id", "ir_type", "category", "risk_level")


def node_edges(spark, sf_dir):
    return N.edges(classified(spark, sf_dir), KEY)


def sibling_edges(spark, sf_dir):
    """Order lines under their orders: numbers come from window order, labels and weights from the line."""
    d = T.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("place"), F.when(F.col("l_returnflag") == "R", "GLOBAL").when(F.col("l_returnflag") == "A", "IMPORT").otherwise("CALL").alias("ir_type"), (F.col("l_linenumber") % 11).alias("risk_level"))
    d = N.number(d, ["l_orderkey"], "place").withColumn("parent_idx", F.lit(0)).withColumn("idx", F.col("idx") + 1)
    return N.edges(d, ["l_orderkey"])


def type_histogram(spark, sf_dir):
    return N.histogram(classified(spark, sf_dir), KEY)


def category_risk(spark, sf_dir):
    return N.category_risk(classified(spark, sf_dir), KEY)


def feature_vector(spark, sf_dir):
    f = N.features(classified(spark, sf_dir), KEY)
    names = [c for c in f.columns if c != "user_id"]
    return f.select("user_id", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("amount")) for c in names])))


def risk_shares(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("user_id").agg(N.at_share(F.col("risk_level"), 0.9).alias("p90"), N.at_share(F.col("risk_level"), 0.75).alias("p75"))


def first_positions(spark, sf_dir):
    got = classified(spark, sf_dir).groupBy("user_id").agg(F.slice(F.sort_array(F.collect_list(F.when(F.col("ir_type") == "GLOBAL", F.col("idx")))), 1, 3).alias("p"))
    return got.select("user_id", *[F.get("p", F.lit(i)).alias(f"p{i + 1}") for i in range(3)])


def token_sequence(spark, sf_dir):
    s = N.token_sequence(classified(spark, sf_dir), KEY)
    return s.select("user_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


def added_rows(spark, sf_dir):
    last = classified(spark, sf_dir).groupBy("user_id").agg(F.max("idx").alias("last_idx"))
    return N.added_rows(T.flags(spark, sf_dir).join(last, "user_id"), KEY).select("user_id", "idx", "parent_idx", "depth", "ir_type", "category", "risk_level", "source")


def pattern_hits(spark, sf_dir):
    h = P.hits(T.mixed(spark, sf_dir), KEY)
    return h.select("user_id", "pattern_id", "risk_boost", F.array_join(F.transform("node_indices", lambda x: x.cast("string")), ",").alias("positions"))


def pattern_totals(spark, sf_dir):
    h = P.hits(T.mixed(spark, sf_dir), KEY)
    return h.groupBy("user_id").agg(F.sum("risk_boost").alias("extra_risk"), F.count("*").alias("hits"))


def pattern_features(spark, sf_dir):
    return N.hit_features(P.hits(T.mixed(spark, sf_dir), KEY), KEY)


NUMBERS = ["import_count", "function_count", "class_count", "cyclomatic_complexity", "depth", "cognitive_complexity", "halstead_distinct_operators", "halstead_distinct_operands", "halstead_total_operators", "halstead_total_operands", "max_nested_function_depth", "except_count", "try_count", "decorator_total", "count_tainted_exec", "count_io_write", "count_hook_dunders", "count_format_calls"]
MARKS = ["has_concat_exec", "has_weakref_hooks", "has_pickle_gadgets", "has_native_lib_load", "has_sys_modules_poison"]


def measured(spark, sf_dir):
    """Customers as files with metrics: number i is key * (i + 3) % (20 + i), flag i comes with every (i + 2)nd key."""
    k = F.col("c_custkey")
    own = [((k * (i + 3)) % (20 + i)).alias(c) for i, c in enumerate(NUMBERS)] + [(k % (i + 2) == 0).alias(c) for i, c in enumerate(MARKS)]
    return T.table(spark, sf_dir, "customer").select("c_custkey", *own, ((k % 8) / F.lit(8.0)).alias("blank_ratio"), ((k % 64) / F.lit(8.0)).alias("source_entropy"))


def file_features(spark, sf_dir):
    f = N.file_features(measured(spark, sf_dir))
    return f.select("c_custkey", *[F.round(c, 9).alias(c) for c in f.columns if c.startswith("f_")])


def whole_vector(spark, sf_dir):
    """All features of a file in one row: of its nodes, of the file itself and of its pattern hits."""
    files = measured(spark, sf_dir).withColumnRenamed("c_custkey", "user_id")
    v = N.vector(classified(spark, sf_dir), files, P.hits(T.mixed(spark, sf_dir), KEY), KEY)
    return v.select("user_id", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in v.columns if c != "user_id"])


def kept_attributes(spark, sf_dir):
    """Properties that an allow-list keeps, with the depth added."""
    n = T.mixed(spark, sf_dir).select("user_id", "idx", N.with_depth(N.kept_properties(F.col("props"), ["arg_count", "has_exec_calls", "has_network_calls"]), F.col("depth")).alias("p"))
    return n.select("user_id", "idx", F.array_join(F.transform(F.array_sort(F.map_keys("p")), lambda k: F.concat(k, F.lit("="), F.element_at(F.col("p"), k))), ",").alias("props"))


def one_pattern(name):
    def query(spark, sf_dir):
        return pattern_hits(spark, sf_dir).where(F.col("pattern_id") == name).select("user_id", "positions")

    return query


def truncated_nodes(spark, sf_dir):
    """Trees cut at a depth: the first level beyond becomes one truncated node."""
    d = T.nodes(spark, sf_dir).withColumn("depth", F.col("k"))
    return N.classify(N.limit_depth(d, 60)).groupBy("ir_type").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def all_nodes(spark, sf_dir):
    """Tree rows and added rows together, with the counters that scoring uses."""
    tree = classified(spark, sf_dir).select("user_id", "idx", "depth", "ir_type", "category", "risk_level", F.lit(None).cast("string").alias("raises"))
    last = tree.groupBy("user_id").agg(F.max("idx").alias("last_idx"))
    added = N.added_rows(T.flags(spark, sf_dir).join(last, "user_id"), KEY).select("user_id", "idx", "depth", "ir_type", "category", "risk_level", "raises")
    return tree.unionByName(added)


def file_metrics(spark, sf_dir):
    return N.metrics(all_nodes(spark, sf_dir), KEY)


QUERIES = {
    "file_features": file_features, "whole_vector": whole_vector, "kept_attributes": kept_attributes, "risk_levels": risk_levels, "node_edges": node_edges, "sibling_edges": sibling_edges, "type_histogram": type_histogram, "category_risk": category_risk, "feature_vector": feature_vector, "risk_shares": risk_shares, "first_positions": first_positions, "token_sequence": token_sequence, "added_rows": added_rows,
    "pattern_hits": pattern_hits, "pattern_totals": pattern_totals, "pattern_features": pattern_features, "global_write": one_pattern("GLOBAL_WRITE"), "async_dynamic": one_pattern("ASYNC_DYNAMIC"), "exec_chain": one_pattern("EXEC_CHAIN"), "silent_except": one_pattern("SILENT_EXCEPT"), "truncated_nodes": truncated_nodes, "file_metrics": file_metrics,
}

N1 = "WITH " + T.NODES_SQL
LABEL = "CASE {t} WHEN 'IMPORT' THEN 'imports' WHEN 'CALL' THEN 'calls' WHEN 'AWAIT' THEN 'calls' WHEN 'GLOBAL' THEN 'scopes' ELSE 'uses' END"
SHARE = "CAST(count(*) FILTER ({0}) AS DOUBLE) / count(*)"
FEATURES = {f"freq_{k}": SHARE.format(f"ir_type = '{k}'") for k in L.VOCABULARY}
FEATURES |= {
    "total_nodes": "CAST(count(*) AS DOUBLE)", "max_depth": "CAST(max(depth) AS DOUBLE)", "high_risk_ratio": SHARE.format("risk_level >= 7"), "med_risk_ratio": SHARE.format("risk_level BETWEEN 4 AND 6"), "priv_ratio": SHARE.format("ir_type = 'GLOBAL'"),
    **{k: "0.0::DOUBLE" for k in ("ctrl_flow_ratio", "io_ratio", "net_ratio", "dyn_ratio", "hook_ratio", "taint_ratio", "concur_ratio", "deser_ratio")}, "mean_risk": "CAST(sum(risk_level) AS DOUBLE) / count(*)", "max_risk": "max(risk_level) / 10.0::DOUBLE",
    "p90_risk": "list_sort(list(risk_level))[CAST(floor(0.9::DOUBLE * count(*)) AS INT) + 1] / 10.0::DOUBLE", "p75_risk": "list_sort(list(risk_level))[CAST(floor(0.75::DOUBLE * count(*)) AS INT) + 1] / 10.0::DOUBLE",
    "risk_variance": "CAST(count(*) * sum(risk_level * risk_level) - sum(risk_level) * sum(risk_level) AS DOUBLE) / (count(*) * count(*))",
    **{f"cat_risk_{k}": f"CAST(coalesce(sum(risk_level) FILTER (category = '{k}'), 0) AS DOUBLE) / count(*)" for k in ("execution", "scope", "network", "io", "privilege", "dynamic", "dependency", "exception", "memory")},
}
HAS = {f: f"(f = '{f}')" for f in T.FLAGS}
RUNS = "(f IN ('has_exec_calls', 'has_eval_calls'))"
MARK = {
    "dyn": f"t = 'DYNAMIC' OR coalesce({RUNS} OR f = 'has_dynamic_imports', false)", "net": "t = 'NETWORK' OR c = 'network' OR coalesce(f = 'has_network_calls', false)", "priv": "t IN ('PRIVILEGE', 'GLOBAL') OR coalesce(f = 'has_privilege_calls', false)", "obf": "t = 'OBFUSC' OR coalesce(f = 'has_obfuscation', false)",
    "exe": f"t = 'DYNAMIC' AND (found OR coalesce({RUNS}, false))", "deser": "t = 'DESER' OR coalesce(f = 'has_deserialisation', false)", "hook": "t = 'HOOK'", "concur": "t = 'CONCUR' OR coalesce(f = 'has_concurrency', false)", "entropy": "coalesce(f = 'has_high_entropy', false)", "wait": "t = 'AWAIT'", "imp": "t = 'IMPORT'", "asg": "t = 'ASSIGN'", "gl": "t = 'GLOBAL'",
    "wide": "t = 'CALL' AND args > 4", "func": "t = 'FUNC_DEF'", "pickle": "coalesce(f = 'has_pickle_gadgets', false)", "native": "t = 'NATIVE_LOAD' OR coalesce(f = 'has_native_lib_load', false)", "taint": "t = 'TAINTED_EXEC' OR coalesce(f = 'has_tainted_exec', false)", "finish": "coalesce(f = 'has_del_hook', false)", "weak": "coalesce(f = 'has_weakref_hooks', false)", "io": "t = 'IO' OR c = 'io' OR coalesce(f = 'has_file_io', false)",
}
HITS = (
    "WITH " + T.MIXED_SQL + ", kids AS (SELECT user_id, parent_idx AS idx, count(*) AS n, count(*) FILTER (t = 'PASS') AS p FROM m1 WHERE parent_idx IS NOT NULL GROUP BY ALL),\n"
    "m2 AS (SELECT m1.*, " + ", ".join(f"({v}) AS {k}" for k, v in MARK.items()) + ", t = 'CATCH' AND (coalesce(n, 0) = 0 OR (n = 1 AND p = 1)) AS silent FROM m1 LEFT JOIN kids USING (user_id, idx)),\n"
    "m3 AS (SELECT *, min(CASE WHEN asg THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS aa, max(CASE WHEN wait THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 1 AS near, min(CASE WHEN imp THEN idx END) OVER (PARTITION BY user_id) AS i0 FROM m2),\n"
    "m4 AS (SELECT *, min(CASE WHEN t = 'CALL' AND idx > i0 THEN idx END) OVER (PARTITION BY user_id) AS c0 FROM m3),\n"
    "g AS (SELECT user_id, " + ", ".join(f"min(idx) FILTER ({k}) AS {k}" for k in MARK) + ", list_sort(list(idx) FILTER (dyn AND depth >= 5))[1:2] AS deep, list_sort(list(idx) FILTER (silent))[1:3] AS sil, min(idx) FILTER (gl AND aa IS NOT NULL) AS gw, arg_min(aa, idx) FILTER (gl AND aa IS NOT NULL) AS gwa, "
    "list_sort(list(idx) FILTER (imp AND depth > 2))[1:3] AS shadow, list_sort(list(idx) FILTER (dyn AND near))[1:2] AS ad, list_sort(list(idx) FILTER (obf))[1:3] AS obfs, list_sort(list(idx) FILTER (taint))[1:2] AS taints, min(i0) AS i0, min(c0) AS c0, min(idx) FILTER (exe AND idx > c0) AS e0 FROM m4 GROUP BY user_id),\n"
    "h AS (SELECT user_id, unnest([" + ", ".join(
        f"{{'p': '{k}', 'b': {L.BOOSTS[k]}, 's': {v}}}" for k, v in {
            **{k: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} || ',' || {b} END" for k, a, b in (("EXFIL_CHAIN", "dyn", "net"), ("PRIV_NETWORK", "priv", "net"), ("OBFUSC_EXEC", "obf", "dyn"), ("DESER_EXEC", "coalesce(deser, obf)", "wide"), ("GLOBAL_WRITE", "gw", "gwa"), ("HOOK_PATTERN", "hook", "func"), ("CONCUR_PRIV", "concur", "priv"), ("ENTROPY_EXEC", "entropy", "exe"), ("PICKLE_GADGET", "pickle", "deser"), ("NATIVE_CODE_LOAD", "native", "priv"), ("HOOK_PERSIST", "finish", "coalesce(net, io)"), ("WEAKREF_EXFIL", "weak", "net"))},
            **{k: f"CASE WHEN len({a}) >= {n} THEN array_to_string({a}, ',') END" for k, a, n in (("DEEP_DYNAMIC", "deep", 1), ("SILENT_EXCEPT", "sil", 1), ("SHADOW_IMPORT", "shadow", 1), ("ASYNC_DYNAMIC", "ad", 1), ("MULTI_OBFUSC", "obfs", 3), ("TAINTED_EXEC", "taints", 1))},
            "EXEC_CHAIN": "CASE WHEN e0 IS NOT NULL THEN i0 || ',' || c0 || ',' || e0 END",
        }.items()) + "]) AS x FROM g),\nhits AS (SELECT user_id, x.p AS pattern_id, x.b AS risk_boost, x.s AS positions FROM h WHERE x.s IS NOT NULL)\n"
)
ADDED = "WITH " + T.NODES_SQL + ", " + T.FLAGS_SQL + ", la AS (SELECT user_id, max(idx) AS last FROM n1 GROUP BY 1), ad0 AS (SELECT user_id, last, unnest([" + ", ".join(
    f"{{'o': {i}, 'on': {' OR '.join(k if k in T.FLAGS else 'false' for k in fl.split())}, 't': '{t}', 'c': '{c}', 'r': {r}, 's': '{s}', 'd': '{d}'}}" for i, (fl, t, c, r, s, d) in enumerate(L.INJECTED)
) + "]) AS x FROM fl JOIN la USING (user_id)), ad AS (SELECT user_id, last + row_number() OVER (PARTITION BY user_id ORDER BY x.o) AS idx, 0 AS parent_idx, 1 AS depth, x.t AS ir_type, x.c AS category, x.r AS risk_level, x.s AS source, x.d AS raises FROM ad0 WHERE x.on)"
METRICS = ADDED + """, al AS (SELECT user_id, depth, ir_type, risk_level, '' AS raises FROM n1 UNION ALL SELECT user_id, depth, ir_type, risk_level, raises FROM ad),
me AS (SELECT user_id, count(*) AS total_nodes, max(depth) AS max_depth, count(*) FILTER (ir_type IN ('GLOBAL', 'PRIVILEGE')) + count(*) FILTER (contains(raises, 'priv')) AS privilege_sensitive_count,
  count(*) FILTER (ir_type = 'NETWORK') + count(*) FILTER (contains(raises, 'net')) AS network_call_count, count(*) FILTER (ir_type = 'IO') + count(*) FILTER (contains(raises, 'io')) AS io_call_count,
  count(*) FILTER (ir_type = 'DYNAMIC') + count(*) FILTER (contains(raises, 'dyn')) AS dynamic_eval_count, count(*) FILTER (risk_level >= 7) AS high_risk_node_count, count(*) FILTER (ir_type = 'OBFUSC') AS obfuscation_count,
  count(*) FILTER (ir_type = 'LOOP') AS loop_count, count(*) FILTER (ir_type = 'BRANCH') AS branch_count, count(*) FILTER (ir_type = 'CALL') AS call_count FROM al GROUP BY user_id)"""
MEASURED = "ms AS (SELECT c_custkey, " + ", ".join(f"(c_custkey * {i + 3}) % {20 + i} AS {c}" for i, c in enumerate(NUMBERS)) + ", " + ", ".join(f"c_custkey % {i + 2} = 0 AS {c}" for i, c in enumerate(MARKS)) + ", (c_custkey % 8) / 8.0::DOUBLE AS blank_ratio, (c_custkey % 64) / 8.0::DOUBLE AS source_entropy FROM customer)"
_VOCAB = "greatest(halstead_distinct_operators + halstead_distinct_operands, 1)::DOUBLE"
FILE = {
    "f_import_count": "import_count", "f_function_count": "function_count", "f_class_count": "class_count", "f_cyclomatic": "cyclomatic_complexity", "f_depth": "depth", "f_cognitive": "cognitive_complexity", "f_halstead_volume": f"least((halstead_total_operators + halstead_total_operands) * log2({_VOCAB}), 10000.0::DOUBLE) / 10000.0::DOUBLE", "f_halstead_vocab": _VOCAB,
    "f_blank_ratio": "blank_ratio", "f_max_nested_depth": "max_nested_function_depth", "f_try_except_ratio": "except_count / greatest(try_count, 1)::DOUBLE", "f_decorator_density": "decorator_total / greatest(function_count, 1)::DOUBLE", "f_source_entropy": "source_entropy / 8.0::DOUBLE", "f_tainted_exec_count": "count_tainted_exec", "f_io_write_count": "count_io_write", "f_hook_dunder_count": "count_hook_dunders", "f_format_call_count": "count_format_calls",
    "f_has_concat_exec": "has_concat_exec::INT", "f_has_weakref_hooks": "has_weakref_hooks::INT", "f_has_pickle_gadgets": "has_pickle_gadgets::INT", "f_has_native_load": "has_native_lib_load::INT", "f_has_sys_poison": "has_sys_modules_poison::INT",
}
FILE = {k: f"round(({v})::DOUBLE, 9)" for k, v in FILE.items()}
HIT_ROW = "SELECT user_id, CAST(count(*) AS DOUBLE) AS pattern_hit_count, round(sum(risk_boost) / 100.0::DOUBLE, 9) AS pattern_total_boost, CAST(max(CASE WHEN pattern_id = 'EXFIL_CHAIN' THEN 1 ELSE 0 END) AS DOUBLE) AS has_exfil_pattern, CAST(max(CASE WHEN pattern_id IN ('EXEC_CHAIN', 'OBFUSC_EXEC', 'DESER_EXEC', 'ENTROPY_EXEC', 'TAINTED_EXEC') THEN 1 ELSE 0 END) AS DOUBLE) AS has_exec_pattern FROM hits GROUP BY user_id"
ORACLE_SQL = {
    "file_features": f"WITH {MEASURED} SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in FILE.items()) + " FROM ms",
    "whole_vector": HITS.rstrip() + f", {MEASURED}, hr AS ({HIT_ROW}), w AS (SELECT user_id, " + ", ".join(f"round({v}, 9) AS {k}" for k, v in FEATURES.items()) + " FROM n1 GROUP BY user_id), fr AS (SELECT c_custkey, " + ", ".join(f"{v} AS {k}" for k, v in FILE.items()) + " FROM ms) SELECT w.*, " + ", ".join(f"coalesce({k}, 0.0::DOUBLE) AS {k}" for k in [*FILE, "pattern_hit_count", "pattern_total_boost", "has_exfil_pattern", "has_exec_pattern"]) + " FROM w LEFT JOIN fr ON fr.c_custkey = w.user_id LEFT JOIN hr ON hr.user_id = w.user_id",
    "kept_attributes": "WITH " + T.MIXED_SQL + " SELECT user_id, idx, 'arg_count=' || args || ',depth=' || depth || CASE WHEN f IN ('has_exec_calls', 'has_network_calls') THEN ',' || f || '=true' ELSE '' END AS props FROM m1",
    "risk_levels": N1 + " SELECT event_id, ir_type, category, risk_level FROM n1",
    "node_edges": N1 + f" SELECT user_id, parent_idx AS source_index, idx AS target_index, {LABEL.format(t='ir_type')} AS edge_type, risk_level / 10.0::DOUBLE AS weight FROM n1 WHERE parent_idx IS NOT NULL",
    "sibling_edges": "SELECT l_orderkey, 0 AS source_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS target_index, CASE l_returnflag WHEN 'R' THEN 'scopes' WHEN 'A' THEN 'imports' ELSE 'calls' END AS edge_type, (l_linenumber % 11) / 10.0::DOUBLE AS weight FROM lineitem",
    "type_histogram": N1 + " SELECT user_id, ir_type, count(*) AS n FROM n1 GROUP BY ALL",
    "category_risk": N1 + " SELECT user_id, category, sum(risk_level) AS risk, count(*) AS n FROM n1 GROUP BY ALL",
    "feature_vector": N1 + ", w AS (SELECT user_id, " + ", ".join(f"{v} AS {k}" for k, v in FEATURES.items()) + " FROM n1 GROUP BY user_id) SELECT user_id, x.f AS feature, x.v AS amount FROM (SELECT user_id, unnest([" + ", ".join(f"{{'f': '{k}', 'v': {k}}}" for k in FEATURES) + "]) AS x FROM w)",
    "risk_shares": N1 + " SELECT user_id, list_sort(list(risk_level))[CAST(floor(0.9::DOUBLE * count(*)) AS INT) + 1] AS p90, list_sort(list(risk_level))[CAST(floor(0.75::DOUBLE * count(*)) AS INT) + 1] AS p75 FROM n1 GROUP BY user_id",
    "first_positions": N1 + ", p AS (SELECT user_id, list_sort(list(idx) FILTER (ir_type = 'GLOBAL')) AS p FROM n1 GROUP BY user_id) SELECT user_id, p[1] AS p1, p[2] AS p2, p[3] AS p3 FROM p",
    "token_sequence": N1 + ", s AS (SELECT user_id, list(ir_type ORDER BY idx) AS t FROM n1 GROUP BY user_id), a AS (SELECT user_id, t, list_filter(t, lambda x: x = 'GLOBAL') AS g FROM s), b AS (SELECT user_id, list_concat(t[1:512 - least(len(g), 128)], g[1:least(len(g), 128)]) AS t FROM a) SELECT user_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM b",
    "added_rows": ADDED + " SELECT user_id, idx, parent_idx, depth, ir_type, category, risk_level, source FROM ad",
    "pattern_hits": HITS + "SELECT user_id, pattern_id, risk_boost, positions FROM hits",
    "pattern_totals": HITS + "SELECT user_id, sum(risk_boost) AS extra_risk, count(*) AS hits FROM hits GROUP BY user_id",
    "pattern_features": HITS + "SELECT user_id, CAST(count(*) AS DOUBLE) AS pattern_hit_count, sum(risk_boost) / 100.0::DOUBLE AS pattern_total_boost, CAST(max(CASE WHEN pattern_id = 'EXFIL_CHAIN' THEN 1 ELSE 0 END) AS DOUBLE) AS has_exfil_pattern, CAST(max(CASE WHEN pattern_id IN ('EXEC_CHAIN', 'OBFUSC_EXEC', 'DESER_EXEC', 'ENTROPY_EXEC', 'TAINTED_EXEC') THEN 1 ELSE 0 END) AS DOUBLE) AS has_exec_pattern FROM hits GROUP BY user_id",
    **{q: HITS + f"SELECT user_id, positions FROM hits WHERE pattern_id = '{p}'" for q, p in (("global_write", "GLOBAL_WRITE"), ("async_dynamic", "ASYNC_DYNAMIC"), ("exec_chain", "EXEC_CHAIN"), ("silent_except", "SILENT_EXCEPT"))},
    "truncated_nodes": N1 + " SELECT CASE WHEN k > 60 THEN 'TRUNCATED' ELSE ir_type END AS ir_type, count(*) AS n, max(k) AS deepest FROM n1 WHERE k <= 61 GROUP BY 1",
    "file_metrics": METRICS + " SELECT * FROM me",
}
