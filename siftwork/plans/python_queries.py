"""Queries over Python sources made from the tables: metrics and flags, trees, sources without meaning-free parts.

A part's source joins those of SNIPPETS whose bit its key has. What each snippet adds is written down by hand, so
that the SQL does not depend on the parser.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import intermediate as I
from ..operators import structure as R
from . import node_queries as V
from . import stand_ins as T

#: Source; numbers that add up; numbers of which the largest counts; flags; operators and operands with their counts; modules.
SNIPPETS = [
    ("import os\nfrom .pkg import *\n", {"node_count": 4, "import_count": 2, "total_lines": 2, "count_relative_imports": 1, "count_star_imports": 1}, {"depth": 2}, "has_file_io has_privilege_calls has_relative_imports has_star_imports", {}, {}, "os pkg"),
    ("def f(a, b):\n    if a and b:\n        for i in a:\n            while i:\n                i -= 1\n    return a\n", {"node_count": 27, "cyclomatic_complexity": 4, "cognitive_complexity": 7, "function_count": 1, "total_lines": 6}, {"depth": 7}, "", {"And": 1, "Sub": 1}, {"a": 3, "b": 1, "i": 3, "const:int": 1}, ""),
    ("class A(B, metaclass=M):\n    @d\n    async def g(self):\n        await h()\n", {"node_count": 16, "class_count": 1, "function_count": 1, "async_function_count": 1, "decorator_total": 1, "total_lines": 4}, {"depth": 7, "chained_call_max_depth": 1}, "has_async has_metaclass", {}, {"B": 1, "M": 1, "d": 1, "h": 1}, ""),
    ("try:\n    eval(x + y)\nexcept E:\n    log(70000)\nexcept:\n    pass\n", {"node_count": 21, "cyclomatic_complexity": 2, "cognitive_complexity": 4, "try_count": 1, "except_count": 2, "count_eval": 1, "count_tainted_exec": 1, "count_silent_except": 1, "total_lines": 6}, {"depth": 6, "chained_call_max_depth": 1}, "has_concat_exec has_eval_calls has_exception_silence has_tainted_eval", {"Add": 1}, {"eval": 1, "x": 1, "y": 1, "E": 1, "log": 1, "const:int": 1}, ""),
    ("with open(p, 'w') as o:\n    o.a().b().c().d()\n", {"node_count": 25, "cyclomatic_complexity": 1, "cognitive_complexity": 1, "count_io": 1, "count_io_write": 1, "total_lines": 2}, {"depth": 12, "chained_call_max_depth": 4}, "has_chained_calls has_file_io has_file_write", {}, {"open": 1, "p": 1, "const:str": 1, "o": 2}, ""),
    ("match v:\n    case 1:\n        exec('ok')\n    case _:\n        setattr(v, 'n', 0)\n", {"node_count": 21, "cyclomatic_complexity": 1, "count_exec": 1, "count_reflection": 1, "total_lines": 5}, {"depth": 6, "chained_call_max_depth": 1}, "has_dynamic_attr_set has_exec_calls has_reflection", {}, {"v": 2, "const:int": 2, "exec": 1, "const:str": 2, "setattr": 1}, ""),
    ("def o():\n    def p():\n        global z\n        z = [q for q in w if q]\n    return lambda k: k if k else p\n", {"node_count": 29, "cyclomatic_complexity": 2, "function_count": 2, "total_lines": 5}, {"depth": 7, "max_nested_function_depth": 1}, "has_global_scope has_nested_functions", {}, {"z": 1, "q": 3, "w": 1, "k": 2, "p": 1}, ""),
    ("import pickle\nfrom socket import socket\n'{}'.format(300)\n", {"node_count": 10, "import_count": 2, "count_network": 1, "count_inject": 1, "count_format_calls": 1, "total_lines": 3}, {"depth": 4, "chained_call_max_depth": 1}, "has_format_injection has_injection_risk has_network_calls has_obfuscation", {}, {"const:str": 1, "const:int": 1}, "pickle socket"),
]
MOST = ("depth", "chained_call_max_depth", "max_nested_function_depth")
BROKEN, HUGE = "def broken(:\n", 5_300_000
#: Entropy depends on the bytes and has a query of its own.
FLAGS = [k for k in R.FLAGS if k != "has_high_entropy"]


def dealt(spark, keys):
    """Keys dealt evenly: short ones make long sources, which need more tasks than the table's few bytes would get."""
    return keys.repartition(spark.sparkContext.defaultParallelism)


def sources(spark, sf_dir):
    """p_partkey and source: every 50th does not parse, and one is over the size limit."""
    k = F.col("p_partkey")
    m = (k * 37) % 256
    parts = [F.when(m.bitwiseAND(1 << i) != 0, F.lit(s[0])).otherwise("") for i, s in enumerate(SNIPPETS)]
    tail = F.when(k == 1, F.repeat(F.lit("#"), HUGE)).when(k % 50 == 7, F.lit(BROKEN)).otherwise("")
    return dealt(spark, T.table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.concat(*parts, tail).alias("source"))


def python_structure(spark, sf_dir):
    f = R.python_files(sources(spark, sf_dir), "p_partkey", "source")
    found = F.array_sort(F.map_keys(F.map_filter("flags", lambda k, v: v & (k != "has_high_entropy"))))
    numbers = [F.element_at("numbers", k).alias(k) for k in R.NUMBERS if k not in ("distinct_imports",)]
    return f.select("p_partkey", *numbers, F.array_join(found, ",").alias("flags"), F.array_join("modules", ",").alias("modules"), F.array_join("parse_errors", ",").alias("errors"))


def python_facts(spark, sf_dir):
    """Line shares, imports and error categories by source."""
    f = R.python_files(sources(spark, sf_dir), "p_partkey", "source")
    return f.groupBy(F.split(F.get("parse_errors", F.lit(0)), ":")[0].alias("error"), F.size("modules").alias("modules")).agg(F.count("*").alias("n"), F.max("blank_ratio").alias("blank"))


def python_tree(spark, sf_dir):
    """Every node of trees of two snippets: place, parent, depth, type, name and the other properties."""
    k = F.col("s_suppkey")
    s = T.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(k % 2 == 1, SNIPPETS[1][0]).otherwise(""), F.when(k % 4 >= 2, SNIPPETS[7][0]).otherwise("")).alias("source"))
    rest = F.map_filter("props", lambda x, _: ~x.isin("name", "call_name"))
    others = F.array_join(F.transform(F.array_sort(F.map_keys(rest)), lambda x: F.concat(x, F.lit("="), F.element_at(F.col("props"), x))), ",")
    return R.python_nodes(s, "s_suppkey", "source").select("s_suppkey", "idx", "parent_idx", "depth", "node_type", F.coalesce(F.element_at("props", "name"), F.element_at("props", "call_name")).alias("name"), others.alias("others"))


def python_stripped(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    source = F.concat(F.lit("def f"), k, F.lit("(a"), k, F.lit(': int) -> str:\n    """Doc."""\n    b: int = '), k, F.lit("\n    return a"), k, F.lit(" + 'x' * b"), k, F.lit(".c"), k, F.lit("(k"), k, F.lit("=b'q')\n"))
    broken = F.when(F.col("c_custkey") % 100 == 3, F.lit(BROKEN)).otherwise(source)
    return R.python_stripped(dealt(spark, T.table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", broken.alias("source")), "c_custkey", "source")


def supplier_sources(spark, sf_dir):
    """s_suppkey and source: none, one or both of two snippets."""
    k = F.col("s_suppkey")
    return T.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.when(k % 2 == 1, SNIPPETS[1][0]).otherwise(""), F.when(k % 4 >= 2, SNIPPETS[7][0]).otherwise("")).alias("source"))


def source_rows(spark, sf_dir):
    s = supplier_sources(spark, sf_dir)
    about = I.files(s, "s_suppkey", "source")
    return I.nodes(s, about, "s_suppkey", "source"), about


def source_pipeline(spark, sf_dir):
    """From sources to counters, edges, patterns and tokens, a row a file."""
    rows, _ = source_rows(spark, sf_dir)
    s = I.summaries(rows, "s_suppkey")
    return s.withColumns({"weight": F.round("weight", 9), "n_tokens": F.size("tokens"), "digest": F.md5(F.array_join("tokens", " ").cast("binary"))}).drop("tokens")


def source_vector(spark, sf_dir):
    """From sources to feature vectors: those of nodes and patterns, and of the file a few that the snippets decide."""
    rows, about = source_rows(spark, sf_dir)
    v = I.vectors(rows, about, "s_suppkey")
    names = [*V.FEATURES, "pattern_hit_count", "pattern_total_boost", "has_exfil_pattern", "has_exec_pattern", "f_import_count", "f_function_count", "f_cyclomatic", "f_cognitive", "f_format_call_count"]
    return v.select("s_suppkey", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 9).alias("amount")) for c in names])))


QUERIES = {"source_pipeline": source_pipeline, "source_vector": source_vector, "python_structure": python_structure, "python_facts": python_facts, "python_tree": python_tree, "python_stripped": python_stripped}

SOURCES = "src AS (SELECT p_partkey, CASE WHEN p_partkey = 1 OR p_partkey % 50 = 7 THEN 0 ELSE (p_partkey * 37) % 256 END AS m, (p_partkey * 37) % 256 AS lines_of, p_partkey = 1 AS huge, p_partkey % 50 = 7 AS broken FROM part)"


def _mask(test) -> int:
    return sum(1 << i for i, s in enumerate(SNIPPETS) if test(s))


def _number(name: str) -> str:
    m = "lines_of" if name == "total_lines" else "m"
    if name == "halstead_distinct_operators" or name == "halstead_distinct_operands":
        at = 4 if name.endswith("operators") else 5
        names = sorted({k for s in SNIPPETS for k in s[at]})
        return " + ".join(f"(m & {_mask(lambda s, k=k: k in s[at])} <> 0)::INT" for k in names)
    if name.startswith("halstead_total"):
        at = 4 if name.endswith("operators") else 5
        return " + ".join(f"CASE WHEN m & {1 << i} <> 0 THEN {sum(s[at].values())} ELSE 0 END" for i, s in enumerate(SNIPPETS) if s[at])
    each = [(i, (s[2] if name in MOST else s[1]).get(name, 0)) for i, s in enumerate(SNIPPETS)]
    each = [f"CASE WHEN {m} & {1 << i} <> 0 THEN {n} ELSE 0 END" for i, n in each if n]
    if name in MOST:
        return f"greatest(0, {', '.join(each)})"
    start = {"cyclomatic_complexity": "1", "node_count": "CASE WHEN huge OR broken THEN 0 ELSE 1 END", "total_lines": "(huge OR broken)::INT"}.get(name, "0")
    return " + ".join([start, *each])


_FOUND = "list_filter([" + ", ".join(f"CASE WHEN m & {_mask(lambda s, k=k: k in s[3].split())} <> 0 THEN '{k}' END" for k in sorted(FLAGS) if _mask(lambda s, k=k: k in s[3].split())) + "], lambda x: x IS NOT NULL)"
_MODULES = "list_filter([" + ", ".join(f"CASE WHEN m & {_mask(lambda s, k=k: k in s[6].split())} <> 0 THEN '{k}' END" for k in ("os", "pickle", "pkg", "socket")) + "], lambda x: x IS NOT NULL)"
#: (idx, parent, depth, type, name, other properties) of the nodes of snippets 1 and 7 below their module.
NODES = {
    1: """1 0 1 FunctionDef f arg_count=2,decorator_count=0,is_async=false
2 1 2 arguments - -
3 2 3 arg - -
4 2 3 arg - -
5 1 2 If - -
6 5 3 BoolOp - -
7 6 4 And - -
8 6 4 Name a -
9 8 5 Load - -
10 6 4 Name b -
11 10 5 Load - -
12 5 3 For - -
13 12 4 Name i -
14 13 5 Store - -
15 12 4 Name a -
16 15 5 Load - -
17 12 4 While - -
18 17 5 Name i -
19 18 6 Load - -
20 17 5 AugAssign - -
21 20 6 Name i -
22 21 7 Store - -
23 20 6 Sub - -
24 20 6 Constant - numeric_magnitude=byte_range,value_type=int
25 1 2 Return - -
26 25 3 Name a -
27 26 4 Load - -""",
    7: """1 0 1 Import - alias_count=1
2 1 2 alias - -
3 0 1 ImportFrom - alias_count=1,import_level=0
4 3 2 alias - -
5 0 1 Expr - -
6 5 2 Call format arg_count=1,has_star_kwargs=false,has_starargs=false
7 6 3 Attribute - -
8 7 4 Constant - value_type=str
9 7 4 Load - -
10 6 3 Constant - numeric_magnitude=word_range,value_type=int""",
}


def _nodes() -> str:
    rows = []
    for n, text in NODES.items():
        for line in text.split("\n"):
            idx, parent, depth, kind, name, others = line.split(" ")
            rows.append(f"({n}, {idx}, {parent}, {depth}, '{kind}', {'NULL' if name == '-' else repr(name)}, '{'' if others == '-' else others}')")
    return "tn(snippet, i, p, depth, node_type, name, others) AS (VALUES " + ", ".join(rows) + ")"


def _hash(x: str) -> str:
    return f"'ID_' || substr(sha256({x}), 1, 8)"


ORACLE_SQL = {
    "python_structure": f"WITH {SOURCES} SELECT p_partkey, " + ", ".join(f"{_number(k)} AS {k}" for k in R.NUMBERS if k != "distinct_imports") + f", array_to_string({_FOUND}, ',') AS flags, array_to_string({_MODULES}, ',') AS modules, CASE WHEN huge THEN 'FILE_TOO_LARGE' WHEN broken THEN 'SyntaxError:L' || ({_number('total_lines')}) || ':C12' ELSE '' END AS errors FROM src",
    "python_facts": f"WITH {SOURCES} SELECT CASE WHEN huge THEN 'FILE_TOO_LARGE' WHEN broken THEN 'SyntaxError' END AS error, len({_MODULES}) AS modules, count(*) AS n, 0.0::DOUBLE AS blank FROM src GROUP BY 1, 2",
    "python_tree": f"WITH {_nodes()}, s AS (SELECT s_suppkey, s_suppkey % 2 = 1 AS one, s_suppkey % 4 >= 2 AS seven FROM supplier) SELECT s_suppkey, i + CASE WHEN snippet = 7 AND one THEN 27 ELSE 0 END AS idx, CASE WHEN p = 0 THEN 0 ELSE p + CASE WHEN snippet = 7 AND one THEN 27 ELSE 0 END END AS parent_idx, depth, node_type, {_hash('name')} AS name, others FROM s JOIN tn ON (snippet = 1 AND one) OR (snippet = 7 AND seven) UNION ALL SELECT s_suppkey, 0, NULL, 0, 'Module', NULL, '' FROM s",
    "python_stripped": "WITH c AS (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 100 <> 3 THEN 'def ' || " + _hash("'f' || k") + " || '(' || " + _hash("'a' || k") + " || '):' || chr(10) || '    ' || " + _hash("'b'") + " || ': ' || " + _hash("'int'") + " || ' = 0' || chr(10) || '    return ' || " + _hash("'a' || k") + " || ' + '''' * ' || " + _hash("'b' || k") + " || '.' || " + _hash("'c' || k") + " || '(' || " + _hash("'k' || k") + " || '=b'''')' END AS stripped, CASE WHEN c_custkey % 100 = 3 THEN 'SyntaxError' END AS error FROM c",
}
_TYPES = ", ".join(f"('{k}', '{a}', '{b}', {c})" for k, (a, b, c) in L.NODE_TYPES.items())
_TIMES = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in L.MULTIPLIERS.items())
#: What the flags of snippet 7 add, in order.
_ADDED = "(1, 'NETWORK', 'network', 6, 'net'), (2, 'OBFUSC', 'dynamic', 8, 'dyn'), (3, 'DYNAMIC', 'execution', 9, 'dyn'), (4, 'DYNAMIC', 'execution', 5, '')"
IR = "WITH " + ORACLE_SQL["python_tree"].removeprefix("WITH ").replace(" SELECT s_suppkey, i +", f""", nt(node_type, ir_type, category, base) AS (VALUES {_TYPES}), mu(category, m) AS (VALUES {_TIMES}), ad(j, ir_type, category, risk_level, raises) AS (VALUES {_ADDED}),
n0 AS (SELECT s_suppkey, i +""", 1) + """), n1 AS (SELECT s_suppkey, idx, parent_idx, depth, coalesce(nt.ir_type, 'EXPR') AS ir_type, coalesce(nt.category, 'data_flow') AS category, coalesce(base, 0) AS base FROM n0 LEFT JOIN nt ON nt.node_type = n0.node_type),
al AS (SELECT s_suppkey, idx, parent_idx, depth, ir_type, n1.category, CAST(floor(base * m) AS INT) AS risk_level, '' AS raises FROM n1 JOIN mu ON mu.category = n1.category
  UNION ALL SELECT l.s_suppkey, last + j, 0, 1, ad.ir_type, ad.category, ad.risk_level, ad.raises FROM (SELECT s_suppkey, max(idx) AS last FROM n1 GROUP BY 1) l JOIN s ON s.s_suppkey = l.s_suppkey AND seven, ad)"""
#: By hand: the root has the flags for network calls and obfuscation, the two imports are rows 1 and 3 of snippet 7 and its call row 6, and the added rows follow its last, 10.
_HITS = "CASE WHEN seven THEN 'EXEC_CHAIN:' || (1 + o) || ',' || (6 + o) || ',' || (13 + o) || ';EXFIL_CHAIN:' || (13 + o) || ',0;OBFUSC_EXEC:0,' || (13 + o) ELSE '' END"
_BOOST = sum(L.BOOSTS[k] for k in ("EXEC_CHAIN", "EXFIL_CHAIN", "OBFUSC_EXEC"))
_STRONG = "(" + ", ".join(f"'{k}'" for k in L.AMPLIFIED) + ")"
_KNOWN = "(" + ", ".join(f"'{k}'" for k in L.VOCABULARY) + ")"
_TYPED = V.FEATURES | {
    "priv_ratio": V.SHARE.format("ir_type IN ('PRIVILEGE', 'GLOBAL')"), "ctrl_flow_ratio": V.SHARE.format("ir_type IN ('BRANCH', 'LOOP', 'MATCH')"), "io_ratio": V.SHARE.format("category = 'io' OR ir_type = 'IO'"), "net_ratio": V.SHARE.format("category = 'network' OR ir_type = 'NETWORK'"),
    "dyn_ratio": V.SHARE.format("ir_type = 'DYNAMIC'"), "hook_ratio": V.SHARE.format("ir_type = 'HOOK' OR category = 'hook'"), "taint_ratio": V.SHARE.format("ir_type = 'TAINTED_EXEC' OR category = 'taint'"), "concur_ratio": V.SHARE.format("ir_type = 'CONCUR'"), "deser_ratio": V.SHARE.format("ir_type = 'DESER'"),
}
_FILE = {"pattern_hit_count": "3 * seven::INT", "pattern_total_boost": f"seven::INT * {_BOOST} / 100.0::DOUBLE", "has_exfil_pattern": "seven::INT", "has_exec_pattern": "seven::INT", "f_import_count": "2 * seven::INT", "f_function_count": "one::INT", "f_cyclomatic": "1 + 4 * one::INT", "f_cognitive": "7 * one::INT", "f_format_call_count": "seven::INT"}
ORACLE_SQL |= {
    "source_pipeline": IR + f""", me AS (SELECT s_suppkey, count(*) AS total_nodes, max(depth) AS max_depth, count(*) FILTER (ir_type IN ('GLOBAL', 'PRIVILEGE')) + count(*) FILTER (raises = 'priv') AS privilege_sensitive_count, count(*) FILTER (ir_type = 'NETWORK') + count(*) FILTER (raises = 'net') AS network_call_count,
  count(*) FILTER (ir_type = 'IO') AS io_call_count, count(*) FILTER (ir_type = 'DYNAMIC') + count(*) FILTER (raises = 'dyn') AS dynamic_eval_count, count(*) FILTER (risk_level >= 7) AS high_risk_node_count, count(*) FILTER (ir_type = 'OBFUSC') AS obfuscation_count, count(*) FILTER (ir_type = 'LOOP') AS loop_count, count(*) FILTER (ir_type = 'BRANCH') AS branch_count, count(*) FILTER (ir_type = 'CALL') AS call_count,
  count(*) FILTER (parent_idx IS NOT NULL) AS edges, round(coalesce(sum(risk_level / 10.0::DOUBLE) FILTER (parent_idx IS NOT NULL), 0.0), 9) AS weight, list(CASE WHEN ir_type IN {_KNOWN} THEN ir_type ELSE 'EXPR' END ORDER BY idx) AS t FROM al GROUP BY 1),
tk AS (SELECT *, list_concat(t, list_filter(t, lambda x: x IN {_STRONG})) AS k FROM me), o AS (SELECT *, CASE WHEN one THEN 27 ELSE 0 END AS o FROM s)
SELECT tk.* EXCLUDE (t, k), len(k) AS n_tokens, md5(array_to_string(k, ' ')) AS digest, {_HITS} AS patterns, seven::INT * {_BOOST} AS extra_risk FROM tk JOIN o ON o.s_suppkey = tk.s_suppkey""",
    "source_vector": IR + ", w AS (SELECT s_suppkey, " + ", ".join(f"{v} AS {k}" for k, v in _TYPED.items()) + " FROM al GROUP BY 1) SELECT s_suppkey, x.f AS feature, round(x.v, 9) AS amount FROM (SELECT w.s_suppkey, unnest([" + ", ".join(f"{{'f': '{k}', 'v': ({v})::DOUBLE}}" for k, v in ({k: k for k in _TYPED} | _FILE).items()) + "]) AS x FROM w JOIN s ON s.s_suppkey = w.s_suppkey)",
}
