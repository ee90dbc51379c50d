"""Patterns over the nodes of a file: one pass of windows and one aggregate find all nineteen.

`nodes` has the file keys, idx, parent_idx, depth, ir_type, category, source and props (MAP<STRING,STRING>).
Each pattern is found at most once a file, with its first node positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S

WINDOW, BAND = 9, 5


def marks(nodes: DataFrame) -> dict:
    """The node predicates that patterns are made of."""
    t, c, src = F.col("ir_type"), F.col("category"), F.coalesce(F.col("source"), F.lit(""))
    has = lambda *ks: F.coalesce(F.greatest(*[S.truthy(F.element_at("props", k)) for k in ks], F.lit(False)), F.lit(False))
    number = lambda k: F.coalesce(F.element_at("props", k).try_cast("double"), F.lit(0.0))
    runs = has("has_exec_calls", "has_eval_calls")
    return {
        "dyn": (t == "DYNAMIC") | runs | has("has_dynamic_imports"), "net": (t == "NETWORK") | (c == "network") | has("has_network_calls"), "priv": t.isin("PRIVILEGE", "GLOBAL") | has("has_privilege_calls"), "obf": (t == "OBFUSC") | has("has_obfuscation"),
        "exe": (t == "DYNAMIC") & (runs | src.isin("exec_detected", "eval_detected", "injection_detected")), "deser": (t == "DESER") | has("has_deserialisation"), "hook": t == "HOOK", "concur": t.isin("ASYNC_SPAWN", "CONCUR") | has("has_concurrency"),
        "entropy": has("has_high_entropy") | (src == "entropy_blob_detected"), "wait": t.isin("AWAIT", "ASYNC_SPAWN"), "imp": t == "IMPORT", "assign": t == "ASSIGN", "glob": t == "GLOBAL", "call": t == "CALL", "wide": (t == "CALL") & (number("arg_count") > 4), "func": t == "FUNC_DEF",
        "pickle": has("has_pickle_gadgets"), "native": has("has_native_lib_load") | (t == "NATIVE_LOAD"), "taint": (t == "TAINTED_EXEC") | has("has_tainted_exec", "has_tainted_eval"), "finish": has("has_del_hook", "has_subclass_hook") | src.isin("del_hook_detected", "subclass_hook_detected"),
        "weak": has("has_weakref_hooks") | (src == "weakref_hook_detected"), "io": (t == "IO") | (c == "io") | has("has_file_io"),
    }


def silent_catches(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `silent`: a CATCH without children, or whose only child is PASS."""
    inner = nodes.where("parent_idx IS NOT NULL").groupBy(*keys, F.col("parent_idx").alias("idx")).agg(F.count("*").alias("children"), F.count_if(F.col("ir_type") == "PASS").alias("passes"))
    n = F.coalesce("children", F.lit(0))
    return nodes.join(inner, [*keys, "idx"], "left").withColumn("silent", (F.col("ir_type") == "CATCH") & ((n == 0) | ((n == 1) & (F.col("passes") == 1)))).drop("children", "passes")


def hits(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pattern_id, risk_boost, node_indices (array)."""
    d = silent_catches(nodes, keys).withColumns(marks(nodes))
    ordered = Window.partitionBy(*keys).orderBy("idx")
    whole = Window.partitionBy(*keys)
    at = lambda p: F.when(p, F.col("idx"))
    d = d.withColumns({
        "assign_after": F.min(at(F.col("assign"))).over(ordered.rowsBetween(1, WINDOW)),
        "wait_near": F.max(F.col("wait")).over(ordered.rowsBetween(-BAND, BAND)),
        "first_import": F.min(at(F.col("imp"))).over(whole),
    })
    d = d.withColumn("first_call", F.min(at(F.col("call") & (F.col("idx") > F.col("first_import")))).over(whole))
    # of patterns that name several nodes: how many such nodes a file has up to each, so that the first few are found without gathering all
    several = {"deep": F.col("dyn") & (F.col("depth") >= 5), "silent": F.col("silent"), "shadow": F.col("imp") & (F.col("depth") > 2), "near": F.col("dyn") & F.col("wait_near"), "obfs": F.col("obf"), "taints": F.col("taint")}
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_{k}": F.when(p, F.sum(F.coalesce(p, F.lit(False)).cast("int")).over(upto)) for k, p in several.items()})
    least = lambda p: F.min(at(p))
    first = lambda k, n: F.array_compact(F.array(*[F.min(at(F.col(f"_{k}") == i)) for i in range(1, n + 1)])).alias(k)
    names = ["dyn", "net", "priv", "obf", "exe", "deser", "hook", "concur", "entropy", "wide", "func", "pickle", "native", "finish", "weak", "io"]
    one = d.groupBy(*keys).agg(
        *[least(F.col(k)).alias(k) for k in names], first("deep", 2), first("silent", 3), F.min(F.when(F.col("glob") & F.col("assign_after").isNotNull(), F.struct("idx", "assign_after"))).alias("written"),
        first("shadow", 3), first("near", 2), first("obfs", 3), first("taints", 2),
        F.min("first_import").alias("i0"), F.min("first_call").alias("c0"), least(F.col("exe") & (F.col("idx") > F.col("first_call"))).alias("e0"),
    )
    c = F.col
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.array(a, b))
    some = lambda a, k=1: F.when(F.size(a) >= k, a)
    found = {
        "EXFIL_CHAIN": pair(c("dyn"), c("net")), "PRIV_NETWORK": pair(c("priv"), c("net")), "OBFUSC_EXEC": pair(c("obf"), c("dyn")), "DESER_EXEC": pair(F.coalesce("deser", "obf"), c("wide")), "DEEP_DYNAMIC": some(c("deep")), "SILENT_EXCEPT": some(c("silent")), "GLOBAL_WRITE": pair(c("written.idx"), c("written.assign_after")),
        "SHADOW_IMPORT": some(c("shadow")), "ASYNC_DYNAMIC": some(c("near")), "MULTI_OBFUSC": some(c("obfs"), 3), "HOOK_PATTERN": pair(c("hook"), c("func")), "CONCUR_PRIV": pair(c("concur"), c("priv")), "ENTROPY_EXEC": pair(c("entropy"), c("exe")),
        "EXEC_CHAIN": F.when(c("e0").isNotNull(), F.array("i0", "c0", "e0")), "PICKLE_GADGET": pair(c("pickle"), c("deser")), "NATIVE_CODE_LOAD": pair(c("native"), c("priv")), "TAINTED_EXEC": some(c("taints")), "HOOK_PERSIST": pair(c("finish"), F.coalesce("net", "io")), "WEAKREF_EXFIL": pair(c("weak"), c("net")),
    }
    rows = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("pattern_id"), F.lit(L.BOOSTS[k]).alias("risk_boost"), F.transform(v, lambda x: x.cast("int")).alias("node_indices"))) for k, v in found.items()])
    return one.select(*keys, F.inline(F.array_compact(rows)))
