"""Syntax nodes to IR nodes, edges, added rows, token sequences, histograms and features.

Nodes are rows (file keys..., idx, parent_idx, depth, ...): idx is the pre-order position in the file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S


def refined_risk(ir_type: Column, base: Column, props: Column) -> Column:
    """Base risk raised by what the node's properties say."""
    n = lambda k: F.coalesce(F.element_at(props, k).try_cast("double"), F.lit(0.0))
    has = lambda k: F.coalesce(S.truthy(F.element_at(props, k)), F.lit(False))
    untyped = F.coalesce(~S.truthy(F.element_at(props, "has_type")), F.lit(False)) & F.element_at(props, "has_type").isNotNull()
    raised = (
        F.when((ir_type == "CALL") & (n("arg_count") > 8), 4).when((ir_type == "CALL") & (has("has_starargs") | has("has_star_kwargs")), 3)
        .when((ir_type == "IMPORT") & ((n("import_level") > 1) | (n("alias_count") > 10)), 3)
        .when((ir_type == "FUNC_DEF") & ((n("decorator_count") >= 3) | (n("arg_count") > 10) | has("is_async")), 2)
        .when((ir_type == "CLASS_DEF") & has("has_metaclass"), 4).when((ir_type == "CATCH") & untyped, 2)
        .when(ir_type == "GLOBAL", 6).when((ir_type == "COMPREHENSION") & has("is_async"), 2).otherwise(0)
    )
    return F.greatest(base, raised)


def scaled_risk(ir_type: Column, category: Column, risk: Column) -> Column:
    """Risk times the category's multiplier, truncated, at most 10, at least the type's floor."""
    m = S.choose(category, L.MULTIPLIERS, 1.0)
    r = F.least((risk * m).cast("int"), F.lit(10))
    return F.when(ir_type.isin(*L.LEAST_8), F.greatest(r, F.lit(8))).when(ir_type.isin(*L.LEAST_6), F.greatest(r, F.lit(6))).otherwise(r)


def classify(nodes: DataFrame) -> DataFrame:
    """Adds ir_type, category and risk_level by node_type; a node without properties may lack `props`."""
    props = F.col("props") if "props" in nodes.columns else F.create_map().cast("map<string,string>")
    types = F.broadcast(L.node_types(nodes.sparkSession))  # under 100 rows
    out = nodes.join(types, "node_type", "left")
    out = out.withColumns({"ir_type": F.coalesce("ir_type", F.lit("EXPR")), "category": F.coalesce("category", F.lit("data_flow")), "base_risk": F.coalesce("base_risk", F.lit(0))})
    return out.withColumn("risk_level", scaled_risk(F.col("ir_type"), F.col("category"), refined_risk(F.col("ir_type"), F.col("base_risk"), props))).drop("base_risk")


def limit_depth(nodes: DataFrame, depth: int = L.IR_DEPTH) -> DataFrame:
    """Cuts trees: a node just below `depth` becomes DEPTH_LIMIT, deeper ones go."""
    return nodes.where(F.col("depth") <= depth + 1).withColumn("node_type", F.when(F.col("depth") > depth, "DEPTH_LIMIT").otherwise(F.col("node_type")))


def kept_properties(props: Column, allowed: list[str]) -> Column:
    return F.map_filter(props, lambda k, v: k.isin(*allowed))


def with_depth(props: Column, depth: Column) -> Column:
    """Properties with the node's depth among them."""
    return F.map_concat(F.map_filter(props, lambda k, _: k != "depth"), F.create_map(F.lit("depth"), depth.cast("string")))


def edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One edge from each node's parent, labelled by the node's type."""
    has = nodes.where(F.col("parent_idx").isNotNull())
    return has.select(*keys, F.col("parent_idx").alias("source_index"), F.col("idx").alias("target_index"), S.edge_label(F.col("ir_type")).alias("edge_type"), S.edge_weight(F.col("risk_level")).alias("weight"))


def added_rows(files: DataFrame, keys: list[str], last: str = "last_idx") -> DataFrame:
    """Rows for the flags of a file, numbered after its last node, in the fixed order; they hang off node 0.

    `files` has the keys, `last` and boolean has_* columns (absent ones count as false)."""
    flag = lambda k: F.coalesce(F.col(k), F.lit(False)) if k in files.columns else F.lit(False)
    rows = F.array(*[
        F.when(reduce(lambda a, b: a | b, [flag(k) for k in flags.split()]), F.struct(F.lit(i).alias("ord"), F.lit(t).alias("ir_type"), F.lit(c).alias("category"), F.lit(r).alias("risk_level"), F.lit(s).alias("source"), F.lit(d).alias("raises")))
        for i, (flags, t, c, r, s, d) in enumerate(L.INJECTED)
    ])
    out = files.select(*keys, last, F.posexplode(F.array_compact(rows)).alias("pos", "r"))
    return out.select(*keys, (F.col(last) + 1 + F.col("pos")).alias("idx"), F.lit(0).alias("parent_idx"), F.lit(1).alias("depth"), "r.*").drop("ord")


def token_sequence(nodes: DataFrame, keys: list[str], size: int = L.SEQUENCE, tail: int = L.TAIL) -> DataFrame:
    """keys, tokens: the first types of a file, its last places given to the first amplified ones.

    Of a file the first `size` nodes and the first `tail` amplified ones are gathered, whatever its length."""
    token = F.when(F.col("ir_type").isin(*L.VOCABULARY), F.col("ir_type")).otherwise("EXPR")
    order = Window.partitionBy(*keys).orderBy("idx")
    marked = nodes.select(*keys, "idx", token.alias("t")).withColumns({"_place": F.row_number().over(order), "_strong": F.col("t").isin(*L.AMPLIFIED)})
    marked = marked.withColumn("_rank", F.sum(F.col("_strong").cast("int")).over(order))
    few = marked.where((F.col("_place") <= size) | F.col("_strong") & (F.col("_rank") <= tail))
    got = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "t", "_place", "_strong"))).alias("s"))
    tokens = F.transform(F.filter("s", lambda x: x["_place"] <= size), lambda x: x["t"])
    strong = F.transform(F.filter("s", lambda x: x["_strong"]), lambda x: x["t"])
    n = F.least(F.size(strong), F.lit(tail))
    return got.select(*keys, F.when(n > 0, F.concat(F.slice(tokens, F.lit(1), F.lit(size) - n), F.slice(strong, F.lit(1), n))).otherwise(F.slice(tokens, 1, size)).alias("tokens"))


def histogram(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys, "ir_type").agg(F.count("*").alias("n"))


def category_risk(nodes: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.groupBy(*keys, "category").agg(F.sum("risk_level").alias("risk"), F.count("*").alias("n"))


def at_share(values: Column, q: float, most: int = 10) -> Column:
    """The value at place int(q * n), from 0, of ascending whole numbers from 0 to `most`: not an interpolated percentile.

    It is how many of the numbers 0, 1, ... have no more than that place of values up to them, so that only counts are kept."""
    place = (F.lit(float(q)) * F.count(values)).cast("int")
    up_to = [(F.count_if(values <= v) <= place).cast("int") for v in range(most)]
    return F.when(F.count(values) > 0, reduce(lambda a, b: a + b, up_to))


def features(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Features of a file's nodes: type shares, ratios, risk statistics and category risks, by one aggregate."""
    n = F.count("*")
    share = lambda p: F.count_if(p) / n
    t, c, r = F.col("ir_type"), F.col("category"), F.col("risk_level")
    aggs = [share(t == k).alias(f"freq_{k}") for k in L.VOCABULARY]
    aggs += [
        n.cast("double").alias("total_nodes"), F.max("depth").cast("double").alias("max_depth"), share(r >= 7).alias("high_risk_ratio"), share((r >= 4) & (r < 7)).alias("med_risk_ratio"), share(t.isin("BRANCH", "LOOP", "MATCH")).alias("ctrl_flow_ratio"),
        share((c == "io") | (t == "IO")).alias("io_ratio"), share((c == "network") | (t == "NETWORK")).alias("net_ratio"), share(t.isin("PRIVILEGE", "GLOBAL")).alias("priv_ratio"), share(t == "DYNAMIC").alias("dyn_ratio"), share((t == "HOOK") | (c == "hook")).alias("hook_ratio"),
        share((t == "TAINTED_EXEC") | (c == "taint")).alias("taint_ratio"), share(t == "CONCUR").alias("concur_ratio"), share(t == "DESER").alias("deser_ratio"), (F.sum(r) / n).alias("mean_risk"), (F.max(r) / F.lit(10.0)).alias("max_risk"), (at_share(r, 0.9) / F.lit(10.0)).alias("p90_risk"), (at_share(r, 0.75) / F.lit(10.0)).alias("p75_risk"),
        # in whole numbers until the last division, so that the order of rows does not matter
        ((n * F.sum(r * r) - F.sum(r) * F.sum(r)) / (n * n)).alias("risk_variance"),
    ]
    aggs += [(F.coalesce(F.sum(F.when(c == k, r)), F.lit(0)) / n).alias(f"cat_risk_{k}") for k in ("execution", "scope", "network", "io", "privilege", "dynamic", "dependency", "exception", "memory")]
    return nodes.groupBy(*keys).agg(*aggs)


def file_features(files: DataFrame) -> DataFrame:
    """Adds the features that come from a file's own metrics and flags (columns of files; absent ones are 0)."""
    num = lambda k, d=0.0: F.coalesce(F.col(k).cast("double"), F.lit(d)) if k in files.columns else F.lit(d)
    vocab = F.greatest(num("halstead_distinct_operators") + num("halstead_distinct_operands"), F.lit(1.0))
    volume = F.least((num("halstead_total_operators") + num("halstead_total_operands")) * F.log2(vocab), F.lit(10000.0))
    out = {
        "f_import_count": num("import_count"), "f_function_count": num("function_count"), "f_class_count": num("class_count"), "f_cyclomatic": num("cyclomatic_complexity"), "f_depth": num("depth"), "f_cognitive": num("cognitive_complexity"), "f_halstead_volume": volume / 10000.0, "f_halstead_vocab": vocab,
        "f_blank_ratio": num("blank_ratio"), "f_max_nested_depth": num("max_nested_function_depth"), "f_try_except_ratio": num("except_count") / F.greatest(num("try_count"), F.lit(1.0)), "f_decorator_density": num("decorator_total") / F.greatest(num("function_count", 1.0), F.lit(1.0)), "f_source_entropy": num("source_entropy") / 8.0,
        "f_tainted_exec_count": num("count_tainted_exec"), "f_io_write_count": num("count_io_write"), "f_hook_dunder_count": num("count_hook_dunders"), "f_format_call_count": num("count_format_calls"),
    }
    out |= {f"f_{name}": (num(k) != 0).cast("double") for name, k in (("has_concat_exec", "has_concat_exec"), ("has_weakref_hooks", "has_weakref_hooks"), ("has_pickle_gadgets", "has_pickle_gadgets"), ("has_native_load", "has_native_lib_load"), ("has_sys_poison", "has_sys_modules_poison"))}
    return files.withColumns(out)


def hit_features(hits: DataFrame, keys: list[str]) -> DataFrame:
    strong = ("EXEC_CHAIN", "OBFUSC_EXEC", "DESER_EXEC", "ENTROPY_EXEC", "TAINTED_EXEC")
    p = F.col("pattern_id")
    return hits.groupBy(*keys).agg(F.count("*").cast("double").alias("pattern_hit_count"), (F.sum("risk_boost") / F.lit(100.0)).alias("pattern_total_boost"), F.max((p == "EXFIL_CHAIN").cast("double")).alias("has_exfil_pattern"), F.max(p.isin(*strong).cast("double")).alias("has_exec_pattern"))


def vector(nodes: DataFrame, files: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """One row a file with the features of its nodes, of the file and of its pattern hits; what a file lacks is 0."""
    own = file_features(files)
    own = own.select(*keys, *[c for c in own.columns if c.startswith("f_")])
    out = features(nodes, keys).join(own, keys, "left").join(hit_features(hits, keys), keys, "left")
    return out.fillna(0.0, [c for c in out.columns if c not in keys])


def number(nodes: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Pre-order numbers from paths of child positions (arrays): idx from 0 within each file."""
    return nodes.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(path)) - 1)


def metrics(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a file for scoring. Added rows count again where their flag raised a counter."""
    t, raises = F.col("ir_type"), F.coalesce(F.col("raises"), F.lit(""))
    plus = lambda k: F.count_if(F.array_contains(F.split(raises, " "), k))
    return nodes.groupBy(*keys).agg(
        F.count("*").alias("total_nodes"), F.max("depth").alias("max_depth"), (F.count_if(t.isin("GLOBAL", "PRIVILEGE")) + plus("priv")).alias("privilege_sensitive_count"), (F.count_if(t == "NETWORK") + plus("net")).alias("network_call_count"),
        (F.count_if(t == "IO") + plus("io")).alias("io_call_count"), (F.count_if(t == "DYNAMIC") + plus("dyn")).alias("dynamic_eval_count"), F.count_if(F.col("risk_level") >= 7).alias("high_risk_node_count"), F.count_if(t == "OBFUSC").alias("obfuscation_count"),
        F.count_if(t == "LOOP").alias("loop_count"), F.count_if(t == "BRANCH").alias("branch_count"), F.count_if(t == "CALL").alias("call_count"),
    )
