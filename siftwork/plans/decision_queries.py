"""Queries from file metrics to scores, batches, decisions, strategies and generated files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S
from ..operators import nodes as N
from ..operators import scoring as D
from ..operators import validate as V
from ..sources import tables
from . import node_queries as Q
from . import stand_ins as T


def scores(spark, sf_dir):
    """Files are users; batches of 7 users."""
    return D.score(Q.file_metrics(spark, sf_dir), None).withColumn("task_id", F.floor(F.col("user_id") / 7))


def file_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("user_id", "structural_risk", "privilege_risk", "network_risk", "dynamic_risk", "obfuscation_risk", "backdoor_risk", "dependency_risk", "overall_risk", F.array_join("flagged_patterns", ",").alias("flags"))


def assessments(spark, sf_dir):
    return D.assess(scores(spark, sf_dir), ["task_id"])


def batch_assessment(spark, sf_dir):
    return assessments(spark, sf_dir).drop("flags", "mean_confidence")


def decisions(spark, sf_dir):
    return D.decide(assessments(spark, sf_dir))


def policy_decision(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("task_id", "decision", "confidence", "rules_triggered", F.array_join(F.transform("triggered", lambda r: r["rule_id"]), ",").alias("rules"), F.array_join("constraints", ",").alias("constraints"), "hitl_required")


def deployment_strategy(spark, sf_dir):
    s = D.strategy(decisions(spark, sf_dir))
    return s.select("task_id", "method", "primary_tool", "strategy_confidence", F.array_join("expected_resources", ",").alias("expected_resources"))


def generated_files(spark, sf_dir):
    return D.generated_files(D.strategy(decisions(spark, sf_dir)), ["task_id"])


def decision_counts(spark, sf_dir):
    return D.decision_counts(decisions(spark, sf_dir))


def decision_view(spark, sf_dir):
    """What a list of tasks shows of each: badge, colour, percent."""
    d = decisions(spark, sf_dir)
    return d.select("task_id", S.decision_badge(F.col("decision")).alias("badge"), S.risk_colour(F.col("aggregate_risk")).alias("colour"), F.floor(F.col("aggregate_risk") * 100).cast("int").alias("percent"))


def malice_gate(spark, sf_dir):
    m = D.malice(T.flags(spark, sf_dir))
    return m.select("user_id", "malicious", F.array_join("reasons", "|").alias("reasons"))


def malice_alerts(spark, sf_dir):
    m = D.malice(T.flags(spark, sf_dir)).where("malicious")
    return m.select("user_id", F.concat_ws("+", F.slice("reasons", 1, 3)).alias("reason"), F.lit("pending").alias("status"), F.lit("critical").alias("severity"))


def intelligence_summary(spark, sf_dir):
    m = Q.file_metrics(spark, sf_dir)
    s = D.score(m, None).select("user_id", "flagged_patterns")
    f = m.join(s, "user_id").select(F.floor(F.col("user_id") / 7).alias("task_id"), F.col("user_id").alias("file_index"), F.get(F.array(*map(F.lit, sorted(L.LANGUAGES.values()))), (F.col("user_id") % len(L.LANGUAGES)).cast("int")).alias("language"), F.col("total_nodes").alias("ast_nodes"), F.col("call_count").alias("functions"), F.lit(1).alias("classes"), (F.col("total_nodes") % 9).alias("complexity"), F.col("total_nodes").alias("ir_nodes"), "max_depth", F.col("privilege_sensitive_count").alias("loops"), F.col("call_count").alias("branches"), (F.col("dynamic_eval_count") > 0).alias("privileged"), F.col("flagged_patterns").alias("flags"))
    out = D.summary(f, ["task_id"])
    return out.select("task_id", "total_files", "total_ast_nodes", "total_functions", "total_classes", "avg_cyclomatic", "max_cyclomatic", "total_ir_nodes", "control_flow_depth", "loop_density", "branch_density", *[F.array_join(c, ",").alias(c) for c in ("detected_languages", "security_flags", "unique_imports", "privileged_imports")])


def resource_anti_join(spark, sf_dir):
    """Types of parts that suppliers of the same number class lack."""
    p = T.table(spark, sf_dir, "part")
    e = p.select((F.col("p_partkey") % 20).alias("task_id"), F.concat(F.lit("azurerm_"), F.col("p_type")).alias("resource"))
    a = p.where(F.col("p_size") > 45).select((F.col("p_partkey") % 20).alias("task_id"), F.upper("p_type").alias("resource"))
    return V.missing(e, a, ["task_id"])


def hint_coverage(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", F.lit("azurerm_redis_cache"), "text").alias("text"))
    names = [*L.HINTS, "Unknown"]
    numbered = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    h = numbered.where((F.col("i") + F.col("doc_id")) % 3 != 0).withColumn("hint", F.get(F.array(*map(F.lit, names)), F.col("i")))
    return V.hint_coverage(h, ["doc_id"]).select("doc_id", "hints", "addressed", "covered", "passed")


def checks(spark, sf_dir):
    o = T.table(spark, sf_dir, "lineitem")
    cats = ["SYNTAX_ERROR", "LINT_ERROR", "PLAN_ERROR", "RESOURCE_MISMATCH", "HINT_MISMATCH"]
    return o.select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("name"), (F.col("l_quantity") > 12).alias("passed"), F.get(F.array(*map(F.lit, cats)), (F.col("l_linenumber") % 5).cast("int")).alias("error_category"), F.col("l_shipdate").cast("string").alias("detail")).groupBy("l_orderkey", "ord").agg(F.min("name").alias("name"), F.min("passed").alias("passed"), F.min("error_category").alias("error_category"), F.min("detail").alias("detail"))


def first_failure(spark, sf_dir):
    f = V.first_failure(checks(spark, sf_dir), ["l_orderkey"])
    return f.select("l_orderkey", "passed", "ord", "category", V.restart(F.col("category")).alias("restart_from"), F.when(F.col("category").isNotNull(), V.retry_hint(F.col("category"), F.col("detail"))).alias("hint"))


def attempts(spark, sf_dir):
    """Retries: lines of an order are attempts, at most three count."""
    counts = F.col("ord") <= 3
    return checks(spark, sf_dir).groupBy("l_orderkey").agg(F.coalesce(F.max(F.when(counts, F.col("ord"))), F.lit(0)).alias("attempts"), F.count_if(counts & F.col("passed")).alias("passed"), F.count_if(counts & ~F.col("passed") & (V.restart(F.col("error_category")) == "strategy")).alias("strategy_restarts"))


def attempt_checks(spark, sf_dir):
    """Lines of an order as checks: two an attempt."""
    o = T.table(spark, sf_dir, "lineitem")
    cats = ["SYNTAX_ERROR", "LINT_ERROR", "PLAN_ERROR", "RESOURCE_MISMATCH", "HINT_MISMATCH"]
    n = F.col("l_linenumber")
    return o.select("l_orderkey", F.floor((n + 1) / 2).cast("int").alias("attempt"), (n * 10000000 + F.col("l_partkey")).alias("ord"), F.col("l_returnflag").alias("name"), (F.col("l_quantity") > 9).alias("passed"), F.get(F.array(*map(F.lit, cats)), (F.col("l_partkey") % 5).cast("int")).alias("error_category"), F.col("l_partkey").cast("string").alias("detail"))


def retry_loop(spark, sf_dir):
    """The end of each order's retry loop."""
    return V.retries(attempt_checks(spark, sf_dir), ["l_orderkey"])


def retry_attempts(spark, sf_dir):
    return V.retry_rows(retry_loop(spark, sf_dir), ["l_orderkey"])


def plan_lines(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("task_id"), F.col("p_partkey").alias("seq"), "p_type", "p_size", "p_name")
    ok = F.to_json(F.struct(F.when(F.col("p_size") % 4 == 0, "diagnostic").when(F.col("p_size") % 4 == 1, "apply_complete").otherwise("planned_change").alias("type"), F.struct(F.struct(F.col("p_type").alias("resource_type")).alias("resource")).alias("change"), F.struct(F.struct(F.col("p_type").alias("resource_type")).alias("resource")).alias("hook"), F.struct(F.col("p_name").alias("summary"), F.col("p_type").alias("detail")).alias("diagnostic")))
    return p.withColumn("line", F.when(F.col("p_size") == 7, F.lit("{broken")).when(F.col("p_size") == 8, F.lit("")).otherwise(ok))


def planned_resources(spark, sf_dir):
    return V.resources(V.plan_messages(plan_lines(spark, sf_dir)), ["task_id"], "seq")


def applied_resources(spark, sf_dir):
    return V.resources(V.plan_messages(plan_lines(spark, sf_dir)), ["task_id"], "seq", "apply_complete")


def plan_errors(spark, sf_dir):
    return V.plan_errors(V.plan_messages(plan_lines(spark, sf_dir)), ["task_id"], "seq")


def declared_resources(spark, sf_dir):
    p = T.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("task_id"), F.col("p_partkey").alias("seq"), F.concat(F.lit('  resource "azurerm_'), F.col("p_brand"), F.lit('" "x" {')).alias("line"))
    return V.declared(p, ["task_id"], ["seq"]).select("task_id", "resource", F.col("first.seq").alias("first"))


def machine_sizes(spark, sf_dir):
    roles = [*L.ROLE_SIZES, "other"]
    n = T.table(spark, sf_dir, "nation").withColumn("role", F.get(F.array(*map(F.lit, roles)), (F.col("n_nationkey") % len(roles)).cast("int")))
    return n.select("n_nationkey", "role", S.choose(F.col("role"), {k: v[0] for k, v in L.ROLE_SIZES.items()}, 0.25).alias("cpu"), S.choose(F.col("role"), {k: v[1] for k, v in L.ROLE_SIZES.items()}, 0.5).alias("memory"))


QUERIES = {
    "policy_decision": policy_decision, "file_scores": file_scores, "batch_assessment": batch_assessment, "deployment_strategy": deployment_strategy, "generated_files": generated_files, "decision_counts": decision_counts, "decision_view": decision_view, "malice_gate": malice_gate, "malice_alerts": malice_alerts, "intelligence_summary": intelligence_summary,
    "resource_anti_join": resource_anti_join, "hint_coverage": hint_coverage, "first_failure": first_failure, "attempts": attempts, "retry_loop": retry_loop, "retry_attempts": retry_attempts, "planned_resources": planned_resources, "applied_resources": applied_resources, "plan_errors": plan_errors, "declared_resources": declared_resources, "machine_sizes": machine_sizes,
}

SCORES = Q.METRICS + """, s0 AS (SELECT *, 0.3::DOUBLE * least(total_nodes / 500.0::DOUBLE, 1.0::DOUBLE) AS structural_risk, least(privilege_sensitive_count / 5.0::DOUBLE, 1.0::DOUBLE) AS privilege_risk, least(network_call_count / 5.0::DOUBLE, 1.0::DOUBLE) AS network_risk, least(dynamic_eval_count / 3.0::DOUBLE, 1.0::DOUBLE) AS dynamic_risk, least(obfuscation_count / 3.0::DOUBLE, 1.0::DOUBLE) AS obfuscation_risk FROM me),
s1 AS (SELECT *, CASE WHEN privilege_risk > 0.3::DOUBLE AND network_risk > 0.3::DOUBLE THEN least((privilege_risk + network_risk) / 2.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS backdoor_risk, least(network_call_count / 10.0::DOUBLE + 0.5::DOUBLE * obfuscation_risk, 1.0::DOUBLE) AS dependency_risk FROM s0),
sc AS (SELECT *, user_id // 7 AS task_id, least(0.1::DOUBLE * structural_risk + 0.25::DOUBLE * privilege_risk + 0.2::DOUBLE * network_risk + 0.25::DOUBLE * dynamic_risk + 0.1::DOUBLE * obfuscation_risk + 0.1::DOUBLE * backdoor_risk, 1.0::DOUBLE) AS overall_risk,
  list_filter([CASE WHEN privilege_risk > 0.5::DOUBLE THEN 'HIGH_PRIVILEGE' END, CASE WHEN network_risk > 0 THEN 'NETWORK_ACCESS' END, CASE WHEN dynamic_risk > 0.3::DOUBLE THEN 'DYNAMIC_EXECUTION' END, CASE WHEN obfuscation_risk > 0.3::DOUBLE THEN 'OBFUSCATION' END, CASE WHEN backdoor_risk > 0.5::DOUBLE THEN 'BACKDOOR_PATTERN' END], lambda x: x IS NOT NULL) AS fl FROM s1)"""
ASSESS = SCORES + """, asx AS (SELECT task_id, CASE WHEN count(*) < 5 THEN avg(overall_risk) ELSE list_sort(list(overall_risk))[CAST(floor(0.9::DOUBLE * count(*)) AS INT) + 1] END AS aggregate_risk, count(*) FILTER (overall_risk >= 0.65::DOUBLE) AS high_risk_file_count, count(*) AS total_files, 0 AS circular_dependency_count,
  sum(privilege_sensitive_count) AS external_dependency_count, sum(privilege_sensitive_count) AS privileged_api_count, sum(total_nodes) AS total_ir_nodes, sum(len(fl)) AS anomalous_pattern_count FROM sc GROUP BY task_id)"""
DECIDE = ASSESS + """, d0 AS (SELECT *, list_filter([CASE WHEN aggregate_risk >= 0.85::DOUBLE THEN 'R001' END, CASE WHEN aggregate_risk >= 0.6::DOUBLE THEN 'R002' END, CASE WHEN high_risk_file_count > 3 THEN 'R003' END, CASE WHEN privileged_api_count > 10 THEN 'R004' END, CASE WHEN anomalous_pattern_count > 5 THEN 'R005' END], lambda x: x IS NOT NULL) AS rules FROM asx),
d1 AS (SELECT *, least(0.75::DOUBLE + least(len(rules) * 0.15::DOUBLE, 0.3::DOUBLE) + aggregate_risk * 0.2::DOUBLE, 0.98::DOUBLE) AS confidence, list_filter([CASE WHEN list_contains(rules, 'R002') THEN 'network_isolation' END, CASE WHEN list_contains(rules, 'R003') THEN 'sandboxed_execution' END, CASE WHEN list_contains(rules, 'R004') THEN 'privilege_restriction' END, CASE WHEN list_contains(rules, 'R005') THEN 'monitoring_required' END], lambda x: x IS NOT NULL) AS cons,
  CASE WHEN list_contains(rules, 'R001') THEN 'REJECT' WHEN len(rules) > 0 THEN 'APPROVE_WITH_CONSTRAINTS' ELSE 'APPROVE' END AS decision FROM d0)"""
STRATEGY = DECIDE + """, t0 AS (SELECT *, (privileged_api_count > 5)::INT + (high_risk_file_count > 2)::INT + list_contains(cons, 'network_isolation')::INT AS imp, 2 * ((aggregate_risk < 0.4::DOUBLE)::INT + (total_ir_nodes < 300 AND privileged_api_count = 0)::INT + (decision = 'APPROVE')::INT) AS decl FROM d1),
t1 AS (SELECT *, CASE WHEN decision = 'REJECT' THEN 'none' WHEN decision = 'APPROVE' AND decl >= 2 AND imp = 0 THEN 'declarative' WHEN imp >= 3 THEN 'imperative' WHEN len(cons) > 0 OR (decl > 0 AND imp > 0) THEN 'hybrid' ELSE 'declarative' END AS method FROM t0)"""
MAL = "WITH " + T.FLAGS_SQL + ", gr AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in sorted(L.MALICE_FLAGS)) + "], lambda x: x IS NOT NULL) AS grave, list_filter([" + ", ".join(f"CASE WHEN {a} AND {b} THEN '{'+'.join(sorted((a, b)))}' END" for a, b in L.MALICE_PAIRS) + "], lambda x: x IS NOT NULL) AS pairs FROM fl), mg AS (SELECT user_id, len(pairs) > 0 OR len(grave) >= 3 AS malicious, list_sort(list_concat(pairs, CASE WHEN len(grave) >= 3 THEN grave ELSE [] END)) AS reasons FROM gr)"
CHECKS = "WITH ch AS (SELECT l_orderkey, l_linenumber AS ord, min(l_quantity > 12) AS passed, min((['SYNTAX_ERROR','LINT_ERROR','PLAN_ERROR','RESOURCE_MISMATCH','HINT_MISMATCH'])[l_linenumber % 5 + 1]) AS category, min(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS detail FROM lineitem GROUP BY 1, 2)"
RESTART = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.RESTART.items()) + " END"
HINT = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in L.RETRY_HINTS.items()) + " END"
LOOP = f"""WITH RECURSIVE c AS (SELECT l_orderkey, CAST(floor((l_linenumber + 1) / 2) AS INT) AS attempt, l_linenumber * 10000000 + l_partkey AS ord, l_quantity > 9 AS passed, (['SYNTAX_ERROR','LINT_ERROR','PLAN_ERROR','RESOURCE_MISMATCH','HINT_MISMATCH'])[l_partkey % 5 + 1] AS category, l_partkey::VARCHAR AS detail FROM lineitem),
a0 AS (SELECT l_orderkey, attempt, bool_and(passed) AS passed, arg_min(category, ord) FILTER (NOT passed) AS category, arg_min(detail, ord) FILTER (NOT passed) AS detail FROM c GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY attempt)::INT AS i, {HINT} || ' ' || substr(detail, 1, 300) AS hint FROM a0),
f(l_orderkey, i, state, restarts, ran, category, feedback) AS (
  SELECT l_orderkey, 1, CASE WHEN passed THEN 'passed' ELSE 'open' END, 0, 'strategy>iac>validate', category, hint FROM a WHERE i = 1
  UNION ALL SELECT a.l_orderkey, a.i, CASE WHEN a.passed THEN 'passed' WHEN a.i = 3 THEN 'aborted' ELSE 'open' END, f.restarts + (f.category IN ('RESOURCE_MISMATCH', 'HINT_MISMATCH') AND f.restarts < 1)::INT, f.ran || CASE WHEN f.category IN ('RESOURCE_MISMATCH', 'HINT_MISMATCH') AND f.restarts < 1 THEN ' strategy>iac>validate' ELSE ' iac>validate' END, a.category, coalesce(a.hint, f.feedback)
  FROM f JOIN a ON a.l_orderkey = f.l_orderkey AND a.i = f.i + 1 WHERE f.state = 'open' AND a.i <= 3),
z AS (SELECT l_orderkey, arg_max(state, i) AS state, max(i) AS attempts, max(restarts) AS restarts, arg_max(ran, i) AS ran, max(struct_pack(i := i, c := category)).c AS category, max(struct_pack(i := i, c := feedback)).c AS feedback FROM f GROUP BY 1)"""
PLANNED = "SELECT p_partkey % 50 AS task_id, p_type AS resource, min(p_partkey) AS first FROM part WHERE p_size NOT IN (7, 8) AND p_size % 4 {} GROUP BY ALL"
NAMES = [*L.HINTS, "Unknown"]
ADDRESSED = "CASE " + " ".join(f"WHEN i = {i} THEN " + (" OR ".join(f"contains(t, '{w}')" for w in L.HINTS[n].split()) if n in L.HINTS else "true") for i, n in enumerate(NAMES)) + " END"
ORACLE_SQL = {
    "file_scores": SCORES + " SELECT user_id, structural_risk, privilege_risk, network_risk, dynamic_risk, obfuscation_risk, backdoor_risk, dependency_risk, overall_risk, array_to_string(fl, ',') AS flags FROM sc",
    "batch_assessment": ASSESS + " SELECT * FROM asx",
    "policy_decision": DECIDE + " SELECT task_id, decision, confidence, len(rules) AS rules_triggered, array_to_string(rules, ',') AS rules, array_to_string(cons, ',') AS constraints, decision <> 'REJECT' AND confidence < 0.6::DOUBLE AND len(rules) > 0 AS hitl_required FROM d1",
    "deployment_strategy": STRATEGY + f" SELECT task_id, method, CASE method WHEN 'none' THEN 'none' WHEN 'imperative' THEN 'azure_cli' ELSE 'terraform' END AS primary_tool, CASE WHEN method = 'none' THEN confidence ELSE least(confidence * 0.9::DOUBLE, 0.95::DOUBLE) END AS strategy_confidence, CASE WHEN method = 'none' THEN '' ELSE '{','.join(L.RESOURCES)}' " + " ".join(f"|| CASE WHEN list_contains(cons, '{k}') THEN ',{','.join(v)}' ELSE '' END" for k, v in L.RESOURCES_IF.items()) + " END AS expected_resources FROM t1",
    "generated_files": STRATEGY + ", f0 AS (SELECT task_id, unnest(list_filter([" + ", ".join(f"CASE WHEN method <> 'none' AND {c.replace('array_contains(constraints', 'list_contains(cons')} THEN '{n}' END" for n, c in L.FILES) + "], lambda x: x IS NOT NULL)) AS file, generate_subscripts(list_filter([" + ", ".join(f"CASE WHEN method <> 'none' AND {c.replace('array_contains(constraints', 'list_contains(cons')} THEN '{n}' END" for n, c in L.FILES) + "], lambda x: x IS NOT NULL), 1) - 1 AS ord FROM t1) SELECT task_id, ord, file FROM f0",
    "decision_counts": DECIDE + " SELECT count(*) AS decisions_made, count(*) FILTER (decision <> 'REJECT') AS approved, count(*) FILTER (decision = 'REJECT') AS rejected, count(*) FILTER (decision <> 'REJECT' AND confidence < 0.6::DOUBLE AND len(rules) > 0) AS hitl_escalated FROM d1",
    "decision_view": DECIDE + " SELECT task_id, CASE decision WHEN 'APPROVE' THEN 'ok' WHEN 'REJECT' THEN 'bad' ELSE 'warn' END AS badge, CASE WHEN aggregate_risk > 0.7::DOUBLE THEN 'crit' WHEN aggregate_risk > 0.5::DOUBLE THEN 'high' WHEN aggregate_risk > 0.25::DOUBLE THEN 'med' ELSE 'low' END AS colour, CAST(floor(aggregate_risk * 100) AS INT) AS percent FROM d1",
    "malice_gate": MAL + " SELECT user_id, malicious, array_to_string(reasons, '|') AS reasons FROM mg",
    "malice_alerts": MAL + " SELECT user_id, array_to_string(reasons[1:3], '+') AS reason, 'pending' AS status, 'critical' AS severity FROM mg WHERE malicious",
    "intelligence_summary": SCORES + ", f AS (SELECT *, ([" + ", ".join(f"'{v}'" for v in sorted(L.LANGUAGES.values())) + f"])[user_id % {len(L.LANGUAGES)} + 1] AS language, total_nodes % 9 AS cc FROM sc), o AS (SELECT task_id, x, min(user_id * 10 + i) AS p FROM (SELECT task_id, user_id, unnest(fl) AS x, generate_subscripts(fl, 1) AS i FROM f) GROUP BY ALL), ol AS (SELECT task_id, array_to_string(list(x ORDER BY p)[1:20], ',') AS security_flags FROM o GROUP BY 1) SELECT f.task_id, count(*) AS total_files, sum(total_nodes) AS total_ast_nodes, sum(call_count) AS total_functions, count(*) AS total_classes, coalesce(avg(cc) FILTER (cc > 0), 0.0::DOUBLE) AS avg_cyclomatic, coalesce(max(cc), 0) AS max_cyclomatic, sum(total_nodes) AS total_ir_nodes, max(max_depth) AS control_flow_depth, CAST(sum(privilege_sensitive_count) AS DOUBLE) / greatest(sum(total_nodes), 1) AS loop_density, CAST(sum(call_count) AS DOUBLE) / greatest(sum(total_nodes), 1) AS branch_density, array_to_string(list_sort(list(DISTINCT language)), ',') AS detected_languages, coalesce(max(security_flags), '') AS security_flags, array_to_string(list_sort(list(DISTINCT 'file_' || user_id))[1:50], ',') AS unique_imports, coalesce(array_to_string(list_sort(list(DISTINCT 'file_' || user_id || ':privileged_api') FILTER (dynamic_eval_count > 0))[1:20], ','), '') AS privileged_imports FROM f LEFT JOIN ol ON f.task_id = ol.task_id GROUP BY f.task_id",
    "resource_anti_join": "SELECT DISTINCT p_partkey % 20 AS task_id, lower(trim(p_type)) AS resource FROM part e WHERE NOT EXISTS (SELECT 1 FROM part a WHERE a.p_size > 45 AND a.p_partkey % 20 = e.p_partkey % 20 AND lower(trim(a.p_type)) = lower(trim(e.p_type)))",
    "hint_coverage": f"WITH h AS (SELECT doc_id, lower('azurerm_redis_cache ' || text) AS t, i FROM documents, range({len(NAMES)}) r(i) WHERE (i + doc_id) % 3 <> 0), g AS (SELECT doc_id, count(*) AS hints, count(*) FILTER ({ADDRESSED}) AS addressed FROM h GROUP BY 1) SELECT doc_id, hints, addressed, CAST(addressed AS DOUBLE) / hints AS covered, CAST(addressed AS DOUBLE) / hints >= 0.5 AS passed FROM g",
    "first_failure": CHECKS + f", ff AS (SELECT l_orderkey, min(ord) FILTER (NOT passed) AS ord, arg_min(category, ord) FILTER (NOT passed) AS category, arg_min(detail, ord) FILTER (NOT passed) AS detail FROM ch GROUP BY 1) SELECT l_orderkey, ord IS NULL AS passed, ord, category, {RESTART} AS restart_from, {HINT} || ' ' || substr(detail, 1, 300) AS hint FROM ff",
    "attempts": CHECKS + f" SELECT l_orderkey, coalesce(max(ord) FILTER (ord <= 3), 0) AS attempts, count(*) FILTER (ord <= 3 AND passed) AS passed, count(*) FILTER (ord <= 3 AND NOT passed AND {RESTART} = 'strategy') AS strategy_restarts FROM ch GROUP BY 1",
    "retry_loop": LOOP + " SELECT * FROM z",
    "retry_attempts": LOOP + " SELECT l_orderkey, j AS attempt, (string_split(ran, ' '))[j] AS ran, CASE WHEN j < attempts THEN 'retry' ELSE state END AS outcome FROM (SELECT *, unnest(range(1, attempts + 1))::INT AS j FROM z)",
    "planned_resources": PLANNED.format("IN (2, 3)"), "applied_resources": PLANNED.format("= 1"),
    "plan_errors": "WITH e AS (SELECT p_partkey % 50 AS task_id, p_partkey, '• ' || p_name || ': ' || p_type AS t FROM part WHERE p_size NOT IN (7, 8) AND p_size % 4 = 0) SELECT task_id, array_to_string(list(t ORDER BY p_partkey)[1:10], chr(10)) AS errors FROM e GROUP BY 1",
    "declared_resources": "SELECT p_partkey % 50 AS task_id, 'azurerm_' || p_brand AS resource, min(p_partkey) AS first FROM part GROUP BY ALL",
    "machine_sizes": "WITH r AS (SELECT n_nationkey, ([" + ", ".join(f"'{k}'" for k in [*L.ROLE_SIZES, "other"]) + f"])[n_nationkey % {len(L.ROLE_SIZES) + 1} + 1] AS role FROM nation) SELECT n_nationkey, role, CASE role " + " ".join(f"WHEN '{k}' THEN {v[0]}::DOUBLE" for k, v in L.ROLE_SIZES.items()) + " ELSE 0.25::DOUBLE END AS cpu, CASE role " + " ".join(f"WHEN '{k}' THEN {v[1]}::DOUBLE" for k, v in L.ROLE_SIZES.items()) + " ELSE 0.5::DOUBLE END AS memory FROM r",
}


def rendered_files(spark, sf_dir):
    from ..operators import records as C

    r = C.rendered(D.strategy(decisions(spark, sf_dir)))
    return r.groupBy("task_id").agg(F.count("*").alias("files"), F.count_if(F.col("body").isNotNull()).alias("written"), F.count_if(F.col("file").endswith(".tf")).alias("declarative"))


def declared_by_task(spark, sf_dir):
    """Resource types that the rendered files declare, read back from their lines."""
    from ..operators import records as C

    r = C.rendered(D.strategy(decisions(spark, sf_dir)))
    lines = r.select("task_id", "ord", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    return V.declared(lines, ["task_id"], ["ord", "n"]).select("task_id", "resource")


def unplanned_resources(spark, sf_dir):
    """Expected types that the rendered files lack: none, as both follow the same constraints."""
    s = D.strategy(decisions(spark, sf_dir))
    expected = s.where(F.col("method") != "imperative").select("task_id", F.explode("expected_resources").alias("resource"))
    return V.missing(expected, declared_by_task(spark, sf_dir), ["task_id"]).agg(F.count("*").alias("missing"))


def review_requests(spark, sf_dir):
    """With a threshold above every confidence, each triggered decision asks for review."""
    from ..operators import records as C

    d = D.decide(assessments(spark, sf_dir), review_below=0.99)
    return C.review_requests(d, F.lit(0)).select("task_id", "recommendation", F.array_join("shown", ",").alias("flags"), "expires_at", "status")


def result_rows(spark, sf_dir):
    """The final row of each task with its risk summary."""
    from ..operators import records as C

    d = C.risk_summary(decisions(spark, sf_dir))
    s = scores(spark, sf_dir).groupBy("task_id").agg(F.sum("network_call_count").alias("network_calls"), F.max("max_depth").alias("deepest"))
    return C.results(d, s).join(d.select("task_id", "risk_summary"), "task_id").withColumn("constraints", F.array_join("constraints", ","))


def final_rows(spark, sf_dir):
    """All keys of the final row: decision, files, review, strategy, generated files with their bodies, intelligence and duration."""
    from ..operators import records as C

    d = tables.written(D.strategy(decisions(spark, sf_dir)))
    files = C.rendered(d)
    m = Q.file_metrics(spark, sf_dir).select(F.floor(F.col("user_id") / 7).alias("task_id"), "user_id")
    counted = m.groupBy("task_id").agg(F.count_if(F.col("user_id") % 3 > 0).alias("clean_files"), F.count_if(F.col("user_id") % 3 == 0).alias("killed_files"), (F.max("user_id") / 4.0).alias("seconds"))
    pending = m.where(F.col("user_id") % 5 == 0).groupBy("task_id").agg(F.count("*").alias("hitl_pending"))
    r = C.final(d, files, counted, pending, intelligence_summary(spark, sf_dir))
    text = lambda c: F.array_join(c, ",")
    return r.select(
        "task_id", "status", "decision", "confidence", "aggregate_risk", "total_files", "clean_files", "killed_files", "high_risk_files", "anomalous_patterns", "hitl_required", "hitl_pending", text("constraints").alias("constraints"), "deployment_method", "deployment_success",
        text("terraform_files").alias("terraform_files"), text("ansible_files").alias("ansible_files"), F.size("terraform_contents").alias("terraform_contents"), F.size("ansible_contents").alias("ansible_contents"), F.col("intelligence.total_ast_nodes").alias("intelligence"), "duration_seconds",
    )


def declared_variables(spark, sf_dir):
    """The variables that the rendered files declare, by constraint, and how many lines of feedback a second attempt carries."""
    from ..operators import records as C

    s = D.strategy(decisions(spark, sf_dir)).withColumn("feedback", F.array_join(F.transform(F.sequence(F.lit(1), F.col("task_id").cast("int") + 1), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n"))
    r = C.rendered(s, attempt=2, feedback="feedback")
    lines = r.select("task_id", "file", F.posexplode(F.split("body", "\n")).alias("n", "line"))
    variables = lines.where((F.col("file") == "variables.tf") & F.col("line").startswith("variable ")).select("task_id", "n", F.get(F.split("line", '"'), F.lit(1)).alias("name"))
    each = variables.groupBy("task_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ",").alias("variables"))
    told = lines.where((F.col("file") == "main.tf") & F.col("line").rlike("^# line [0-9]+$")).groupBy("task_id").agg(F.count("*").alias("feedback_lines"))
    return each.join(told, "task_id", "left").select("task_id", "variables", F.coalesce("feedback_lines", F.lit(0)).alias("feedback_lines"))


def task_activity(spark, sf_dir):
    from ..operators import records as C

    t = F.col("task_id")
    d = D.decide(assessments(spark, sf_dir), review_below=0.9)
    return C.activity(d.withColumn("status", F.when(t % 5 == 0, "running").when(t % 7 == 1, "failed").otherwise("complete")))


QUERIES |= {"final_rows": final_rows, "declared_variables": declared_variables, "result_rows": result_rows, "task_activity": task_activity, "rendered_files": rendered_files, "declared_by_task": declared_by_task, "unplanned_resources": unplanned_resources, "review_requests": review_requests}
_TF = "CASE WHEN method = 'none' THEN 0 ELSE 4 + list_contains(cons, 'sandboxed_execution')::INT + list_contains(cons, 'monitoring_required')::INT + list_contains(cons, 'network_isolation')::INT + 2 * list_contains(cons, 'privilege_restriction')::INT END"
_ALL = f"({_TF} + CASE method WHEN 'none' THEN 0 WHEN 'imperative' THEN 1 ELSE 3 END)"
_OF = lambda kind: f"array_to_string(list_sort(list_filter(coalesce(fl, []), lambda x: {kind})), ',')"
_VARS = [("true", "subscription_id,location,app_name,environment,allowed_cidr,state_resource_group,state_storage_account"), *[(f"list_contains(cons, '{k}')", v) for k, v in (("monitoring_required", "action_group_id"), ("network_isolation", "key_vault_id"), ("sandboxed_execution", "app_image"), ("privilege_restriction", "keyvault_name"))]]
ORACLE_SQL |= {
    "declared_variables": STRATEGY + " SELECT task_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in _VARS) + "], lambda x: x IS NOT NULL), ',') AS variables, least(task_id + 1, 20) AS feedback_lines FROM t1 WHERE method <> 'none'",
    "final_rows": ORACLE_SQL["generated_files"].replace(" SELECT task_id, ord, file FROM f0", f""", g AS (SELECT task_id, list(file) AS fl FROM f0 GROUP BY 1), c AS (SELECT task_id, count(*) FILTER (user_id % 3 > 0) AS clean_files, count(*) FILTER (user_id % 3 = 0) AS killed_files, count(*) FILTER (user_id % 5 = 0) AS hitl_pending, max(user_id) / 4.0::DOUBLE AS seconds FROM sc GROUP BY 1)
SELECT t1.task_id, 'complete' AS status, decision, confidence, aggregate_risk, total_files, clean_files, killed_files, high_risk_file_count AS high_risk_files, anomalous_pattern_count AS anomalous_patterns, (decision <> 'REJECT' AND confidence < 0.6::DOUBLE AND len(rules) > 0) OR killed_files > 0 AS hitl_required, hitl_pending, array_to_string(cons, ',') AS constraints, method AS deployment_method, method <> 'none' AS deployment_success,
  {_OF("NOT x LIKE '%.yml'")} AS terraform_files, {_OF("x LIKE '%.yml'")} AS ansible_files, len(list_filter(coalesce(fl, []), lambda x: NOT x LIKE '%.yml')) AS terraform_contents, len(list_filter(coalesce(fl, []), lambda x: x LIKE '%.yml')) AS ansible_contents, total_ir_nodes AS intelligence, round(seconds, 2) AS duration_seconds FROM t1 JOIN c ON c.task_id = t1.task_id LEFT JOIN g ON g.task_id = t1.task_id"""),
    "rendered_files": STRATEGY + f" SELECT task_id, {_ALL} AS files, {_ALL} AS written, {_TF} AS declarative FROM t1 WHERE method <> 'none'",
    "unplanned_resources": "SELECT 0 AS missing",
    "result_rows": DECIDE + ", sm AS (SELECT task_id, sum(network_call_count) AS network_calls, max(max_depth) AS deepest FROM sc GROUP BY 1) SELECT d1.task_id, 'complete' AS status, decision, confidence, aggregate_risk, high_risk_file_count AS high_risk_files, len(rules) AS rules_triggered, array_to_string(cons, ',') AS constraints, decision <> 'REJECT' AND confidence < 0.6::DOUBLE AND len(rules) > 0 AS hitl_required, network_calls, deepest, 'Decision: ' || decision || chr(10) || 'Aggregate Risk: ' || printf('%.2f', aggregate_risk * 100) || '%' || chr(10) || 'Files Analyzed: ' || total_files || chr(10) || 'High-Risk Files: ' || high_risk_file_count || chr(10) || 'Rules Triggered: ' || len(rules) || '/6' || CASE WHEN len(rules) > 0 THEN chr(10) || 'Triggered Rules:' || array_to_string(list_transform(rules, lambda r: chr(10) || '  [' || CASE r " + " ".join(f"WHEN '{r[0]}' THEN '{r[2].upper()}'" for r in L.RULES) + " END || '] ' || r), '') ELSE '' END AS risk_summary FROM d1 JOIN sm ON sm.task_id = d1.task_id",
    "task_activity": DECIDE + " SELECT count(*) AS tasks, count(*) FILTER (task_id % 5 = 0) AS running, count(*) FILTER (task_id % 5 <> 0 AND task_id % 7 = 1) AS failed, count(*) FILTER (decision = 'REJECT') AS rejected, count(*) FILTER (decision <> 'REJECT' AND confidence < 0.9::DOUBLE AND len(rules) > 0) AS pending_reviews FROM d1",
    "declared_by_task": STRATEGY + ", ty AS (SELECT task_id, unnest(list_concat(['resource_group', 'virtual_network', 'subnet', 'network_security_group'], CASE WHEN list_contains(cons, 'sandboxed_execution') THEN ['container_group'] ELSE [] END, CASE WHEN list_contains(cons, 'monitoring_required') THEN ['log_analytics_workspace', 'monitor_activity_log_alert'] ELSE [] END, CASE WHEN list_contains(cons, 'network_isolation') THEN ['private_endpoint', 'private_dns_zone'] ELSE [] END, CASE WHEN list_contains(cons, 'privilege_restriction') THEN ['role_assignment', 'key_vault_access_policy'] ELSE [] END)) AS r FROM t1 WHERE method <> 'none') SELECT task_id, 'azurerm_' || r AS resource FROM ty",
    "review_requests": DECIDE + " SELECT d1.task_id, CASE WHEN aggregate_risk > 0.7::DOUBLE THEN 'REJECT' ELSE 'APPROVE_WITH_CONSTRAINTS' END AS recommendation, coalesce((SELECT array_to_string(list_sort(list(DISTINCT x))[1:10], ',') FROM (SELECT unnest(fl) AS x, task_id FROM sc) u WHERE u.task_id = d1.task_id), '') AS flags, 3600 AS expires_at, 'pending' AS status FROM d1 WHERE decision <> 'REJECT' AND confidence < 0.99::DOUBLE AND len(rules) > 0",
}
