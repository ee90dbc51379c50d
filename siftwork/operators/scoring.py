"""File scores, batch assessment, rules as data, decision, strategy and generated files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S
from ..sources import tables
from . import history

#: What `score` flags.
FLAGS = ["HIGH_PRIVILEGE", "NETWORK_ACCESS", "DYNAMIC_EXECUTION", "OBFUSCATION", "BACKDOOR_PATTERN"]
HIGH_RISK, CONFIDENCE, REVIEW_BELOW = 0.65, 0.75, 0.60


def score(files: DataFrame, digits: int | None = 3) -> DataFrame:
    """Adds six risks, confidence and flags. Needs total_nodes, privilege_sensitive_count, network_call_count,
    dynamic_eval_count and obfuscation_count. digits None keeps the risks unrounded."""
    part = lambda c, d: F.least(F.col(c) / F.lit(float(d)), F.lit(1.0))
    d = files.withColumns({"structural_risk": F.lit(0.3) * part("total_nodes", 500), "privilege_risk": part("privilege_sensitive_count", 5), "network_risk": part("network_call_count", 5), "dynamic_risk": part("dynamic_eval_count", 3), "obfuscation_risk": part("obfuscation_count", 3)})
    p, n = F.col("privilege_risk"), F.col("network_risk")
    d = d.withColumns({
        "backdoor_risk": F.when((p > 0.3) & (n > 0.3), F.least((p + n) / F.lit(2.0), F.lit(1.0))).otherwise(F.lit(0.0)),
        "dependency_risk": F.least(F.col("network_call_count") / F.lit(10.0) + F.lit(0.5) * F.col("obfuscation_risk"), F.lit(1.0)),
    })
    overall = F.lit(0.1) * F.col("structural_risk") + F.lit(0.25) * p + F.lit(0.2) * n + F.lit(0.25) * F.col("dynamic_risk") + F.lit(0.1) * F.col("obfuscation_risk") + F.lit(0.1) * F.col("backdoor_risk")
    flags = list(zip(FLAGS, [p > 0.5, n > 0, F.col("dynamic_risk") > 0.3, F.col("obfuscation_risk") > 0.3, F.col("backdoor_risk") > 0.5]))
    d = d.withColumns({"overall_risk": F.least(overall, F.lit(1.0)), "confidence": F.lit(CONFIDENCE), "flagged_patterns": F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags]))})
    if digits is None:
        return d
    return d.withColumns({k: F.round(k, digits) for k in ("structural_risk", "privilege_risk", "network_risk", "dynamic_risk", "obfuscation_risk", "backdoor_risk", "dependency_risk", "overall_risk")})


def order_statistic(rows: DataFrame, keys: list[str], value: str, place: Callable[[Column], Column], cells: int = 1024, levels: int = 2, between: tuple[float, float] | None = None) -> DataFrame:
    """keys and `value`: of each key's ascending values the one at place(how many there are), counted from 0; nulls do not count.

    Exact, and no key's values come together: counts in cells of the value range tell which cell has the place, counts in
    cells of that cell's own range which of those, and of what is left each distinct value is counted once. `rows` is read
    once for each, so it should be a table. `between` are bounds of all values, if they are known."""
    rows = rows.select(*keys, F.col(value).alias("_v")).where("_v IS NOT NULL")
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))
    low, high = between or rows.agg(F.min("_v"), F.max("_v")).first()
    current = rows.withColumns({"_low": F.lit(low), "_high": F.lit(high), "_place": F.lit(None).cast("long")})
    settled = []
    for level in range(levels):
        cell = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells), F.lit(cells - 1))).otherwise(0).cast("int")
        dealt = current.withColumn("_cell", cell)
        counts = dealt.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.first("_place").alias("_place"))
        of = Window.partitionBy(*keys)
        before = F.sum("_n").over(of.orderBy("_cell")) - F.col("_n")  # at most `cells` rows a key
        counts = counts.withColumns({"_before": before, "_total": F.sum("_n").over(of)})
        counts = counts.withColumn("_place", F.coalesce("_place", place(F.col("_total")).cast("long")))
        hit = counts.where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_n"))).withColumn("_place", F.col("_place") - F.col("_before"))
        hit = hit.select(*keys, "_cell", "_low", "_high", "_place")
        settled.append(hit.where("_low = _high").select(*keys, F.col("_low").alias(value)))
        open_ = hit.where("_low < _high")
        left = dealt.select(*keys, "_v", "_cell")
        current = left.join(open_, same(left, open_) & (left["_cell"] == open_["_cell"])).select(*[left[k] for k in keys], "_v", "_low", "_high", "_place")
    each = current.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.first("_place").alias("_place"))
    up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    last = each.withColumn("_up", up_to).where((F.col("_up") > F.col("_place")) & (F.col("_up") - F.col("_n") <= F.col("_place"))).select(*keys, F.col("_v").alias(value))
    return reduce(DataFrame.unionByName, settled, last)


def aggregate_risk(scores: DataFrame, keys: list[str], value: str = "overall_risk", between: tuple[float, float] | None = None) -> DataFrame:
    """keys and aggregate_risk: the mean of fewer than five values; else the one at place int(0.9 n) of the ascending values."""
    at = order_statistic(scores, keys, value, lambda n: F.floor(F.lit(0.9) * n), between=between).withColumnRenamed(value, "_at")
    few = scores.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"))
    on = reduce(lambda a, b: a & b, [few[k].eqNullSafe(at[k]) for k in keys], F.lit(True))
    return few.join(at, on, "left").select(*[few[k] for k in keys], F.when(F.col("_n") < 5, F.col("_mean")).otherwise(F.col("_at")).alias("aggregate_risk"))


def assess(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One row a batch of scored files. External dependencies repeat the privileged count; cycles are not sought."""
    scores = tables.written(scores.select(*keys, "overall_risk", "privilege_sensitive_count", "total_nodes", "flagged_patterns", "confidence"))
    priv, c = F.sum("privilege_sensitive_count"), F.col
    flags = F.array_compact(F.array(*[F.when(F.bool_or(F.array_contains("flagged_patterns", k)), F.lit(k)) for k in sorted(FLAGS)]))
    every = scores.groupBy(*keys).agg(
        F.count_if(c("overall_risk") >= HIGH_RISK).alias("high_risk_file_count"), F.count("*").alias("total_files"), F.lit(0).alias("circular_dependency_count"), priv.alias("external_dependency_count"), priv.alias("privileged_api_count"),
        F.sum("total_nodes").alias("total_ir_nodes"), F.sum(F.size("flagged_patterns")).alias("anomalous_pattern_count"), F.avg("confidence").alias("mean_confidence"), flags.alias("flags"),
    )
    risk = aggregate_risk(scores, keys, between=(0.0, 1.0))
    on = reduce(lambda a, b: a & b, [every[k].eqNullSafe(risk[k]) for k in keys], F.lit(True))
    return every.join(risk, on).select(*[every[k] for k in keys], "aggregate_risk", *[k for k in every.columns if k not in keys])


def decide(assessments: DataFrame, rules: list[tuple] | None = None, network_dynamic: bool = False, review_below: float = REVIEW_BELOW) -> DataFrame:
    """Adds the triggered rules, constraints, confidence, decision and whether a person must look.

    rules: (id, condition, severity, rejects, constraint) with SQL conditions over the assessment's columns."""
    rules = list(rules or L.RULES)
    if network_dynamic:
        rules = [(r[0], L.NETWORK_DYNAMIC, *r[2:]) if r[0] == "R006" else r for r in rules]
    met = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(i).alias("rule_id"), F.lit(sev).alias("severity"), F.lit(rej).alias("rejects"), F.lit(con).cast("string").alias("constraint"))) for i, cond, sev, rej, con in rules]))
    d = assessments.withColumn("triggered", met)
    d = d.withColumns({"rules_triggered": F.size("triggered"), "rules_evaluated": F.lit(len(rules)), "rejects": F.exists("triggered", lambda r: r["rejects"]), "constraints": F.array_distinct(F.array_compact(F.transform("triggered", lambda r: r["constraint"])))})
    sure = F.least(F.col("mean_confidence") + F.least(F.col("rules_triggered") * F.lit(0.15), F.lit(0.3)) + F.col("aggregate_risk") * F.lit(0.2), F.lit(0.98))
    d = d.withColumn("confidence", F.when(F.col("total_files") > 0, sure).otherwise(F.lit(0.5)))
    d = d.withColumn("hitl_required", ~F.col("rejects") & (F.col("confidence") < review_below) & (F.col("rules_triggered") > 0))
    return d.withColumn("decision", F.when(F.col("rejects"), "REJECT").when(F.col("rules_triggered") > 0, "APPROVE_WITH_CONSTRAINTS").otherwise("APPROVE"))


def strategy(decisions: DataFrame) -> DataFrame:
    """Adds method, tools, confidence of the strategy and the expected resources."""
    c = F.col
    isolated = F.array_contains("constraints", "network_isolation")
    imperative = c("hitl_required").cast("int") * 2 + (c("privileged_api_count") > 5).cast("int") + (c("high_risk_file_count") > 2).cast("int") + isolated.cast("int")
    declarative = ((c("aggregate_risk") < 0.4).cast("int") + ((c("total_ir_nodes") < 300) & (c("privileged_api_count") == 0)).cast("int") + ((c("decision") == "APPROVE") & ~c("hitl_required")).cast("int")) * 2
    d = decisions.withColumns({"imperative_signals": imperative, "declarative_signals": declarative})
    method = (
        F.when(c("decision") == "REJECT", "none").when((c("decision") == "APPROVE") & (c("declarative_signals") >= 2) & (c("imperative_signals") == 0), "declarative").when(c("imperative_signals") >= 3, "imperative")
        .when((F.size("constraints") > 0) | ((c("declarative_signals") > 0) & (c("imperative_signals") > 0)), "hybrid").otherwise("declarative")
    )
    d = d.withColumn("method", method)
    d = d.withColumns({"primary_tool": S.choose(c("method"), {"none": "none", "imperative": "azure_cli"}, "terraform"), "secondary_tool": F.when(c("method") != "none", F.lit("ansible")), "strategy_confidence": F.when(c("method") == "none", c("confidence")).otherwise(F.least(c("confidence") * F.lit(0.9), F.lit(0.95)))})
    extra = [F.when(F.array_contains("constraints", k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in L.RESOURCES_IF.items()]
    return d.withColumn("expected_resources", F.when(c("method") == "none", F.array().cast("array<string>")).otherwise(F.concat(F.array(*map(F.lit, L.RESOURCES)), *extra)))


def generated_files(strategies: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file: the files that a method and its constraints call for, in order."""
    names = F.array_compact(F.array(*[F.when((F.col("method") != "none") & F.expr(cond), F.lit(name)) for name, cond in L.FILES]))
    return strategies.select(*keys, F.posexplode(names).alias("ord", "file"))


def bodies(files: DataFrame, templates: dict[str, str], **values: str) -> DataFrame:
    """Adds the text of each file: a template with {name} places, filled from columns."""
    out = F.lit(None).cast("string")
    for name, text in templates.items():
        filled = F.lit(text)
        for place, column in values.items():
            filled = F.replace(filled, F.lit("{" + place + "}"), F.coalesce(F.col(column).cast("string"), F.lit("")))
        out = F.when(F.col("file") == name, filled).otherwise(out)
    return files.withColumn("body", out)


def malice(files: DataFrame) -> DataFrame:
    """Adds malicious and sorted reasons: a pair of flags that never go together innocently, or three grave flags."""
    flag = lambda k: F.coalesce(F.col(k), F.lit(False)) if k in files.columns else F.lit(False)
    pairs = [F.when(flag(a) & flag(b), F.lit("+".join(sorted((a, b))))) for a, b in L.MALICE_PAIRS]
    grave = F.array_compact(F.array(*[F.when(flag(k), F.lit(k)) for k in sorted(L.MALICE_FLAGS)]))
    many = F.size(grave) >= 3
    return files.withColumns({"malicious": reduce(lambda a, b: a | b, [flag(a) & flag(b) for a, b in L.MALICE_PAIRS]) | many, "reasons": F.array_sort(F.concat(F.array_compact(F.array(*pairs)), F.when(many, grave).otherwise(F.array().cast("array<string>"))))})


def summary(files: DataFrame, keys: list[str]) -> DataFrame:
    """One wide row a batch. Needs file_index, language, ast_nodes, functions, classes, complexity, ir_nodes, max_depth,
    loops, branches, privileged (boolean) and flags (array). Lists are cut before they are gathered."""
    c = F.col
    nodes = F.greatest(F.sum("ir_nodes"), F.lit(1))
    own = tables.written(files.withColumn("_name", F.concat(F.lit("file_"), c("file_index").cast("string"))))
    out = own.groupBy(*keys).agg(
        F.count("*").alias("total_files"), F.sum("ast_nodes").alias("total_ast_nodes"), F.sum("functions").alias("total_functions"), F.sum("classes").alias("total_classes"), F.coalesce(F.avg(F.when(c("complexity") > 0, c("complexity"))), F.lit(0.0)).alias("avg_cyclomatic"), F.coalesce(F.max(F.when(c("complexity") > 0, c("complexity"))), F.lit(0)).alias("max_cyclomatic"),
        F.sum("ir_nodes").alias("total_ir_nodes"), F.max("max_depth").alias("control_flow_depth"), (F.sum("loops") / nodes).alias("loop_density"), (F.sum("branches") / nodes).alias("branch_density"), F.array_sort(F.collect_set("language")).alias("detected_languages"),
    )
    raised = own.select(*keys, "file_index", F.posexplode("flags").alias("_pos", "_flag"))
    lists = {
        "security_flags": history.ordered_distinct(raised, keys, "_flag", ["file_index", "_pos"], 20), "unique_imports": history.ordered_distinct(own, keys, "_name", ["_name"], 50),
        "privileged_imports": history.ordered_distinct(own.where("privileged").withColumn("_name", F.concat("_name", F.lit(":privileged_api"))), keys, "_name", ["_name"], 20),
    }
    for name, values in lists.items():
        values = values.select(*[c(k).alias(f"_{k}") for k in keys], c("values").alias(name))
        on = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in keys])
        out = out.join(values, on, "left").drop(*[f"_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def decision_counts(decisions: DataFrame, exact: bool = False) -> DataFrame:
    """Counts; unless `exact`, every decision but REJECT counts as approved."""
    d = F.col("decision")
    return decisions.agg(F.count("*").alias("decisions_made"), F.count_if(d == "APPROVE" if exact else d != "REJECT").alias("approved"), F.count_if(d == "REJECT").alias("rejected"), F.count_if(F.col("hitl_required")).alias("hitl_escalated"))
