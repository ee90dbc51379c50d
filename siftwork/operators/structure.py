"""Structure of source files: a regular-expression parser for nine languages, and Python through its own syntax tree.

Files are rows with keys, a language (see lookups.GRAMMARS) and text. Parsers give a row a file and never fail:
what cannot be read becomes an error row.
"""

from __future__ import annotations

import ast
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S

BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def compiled(pattern: str, ascii_only: bool) -> str:
    """The expression with word characters of all scripts, or of ASCII only.

    A word at its beginning is matched first and its boundary looked up after it: the search then skips what
    does not begin with its letter, instead of looking around at every place."""
    lead = re.match(r"\\b([A-Za-z]+)(?![A-Za-z*+?{])", pattern)
    word = "[A-Za-z0-9_]" if ascii_only else r"\w"
    head, rest = (f"{lead[1]}(?<!{word}{lead[1]})", pattern[lead.end() :]) if lead and "|" not in unnested(pattern) else ("", pattern)
    if re.search(r"[A-Za-z]\\b$", rest):
        rest = rest[:-2] + f"(?!{word})"
    return head + rest.replace(r"\b", BOUNDARY) if ascii_only else "(?U)" + head + rest


def unnested(pattern: str) -> str:
    """The parts of an expression outside its groups."""
    out, depth = "", 0
    for c in re.sub(r"\\.|\[[^\]]*\]", "", pattern):
        depth += (c == "(") - (c == ")")
        out += c if not depth else ""
    return out


def clean_source(text: Column, language: str) -> Column:
    """Comments go before string literals do."""
    return S.strip_strings(S.strip_comments(text, language in L.HASH_COMMENTS))


def _language(text: Column, grammar: tuple, ascii_only: bool) -> Column:
    func, cls, imp, control, *flags = grammar
    count = lambda p: F.regexp_count(text, F.lit(compiled(p, ascii_only))) if p else F.lit(0)
    each = [count(rf"\b{w}\b") for w in control.split()]
    functions, control_hits = count(func), sum(each[1:], each[0])
    found = [F.when(n > 0, F.struct(F.lit(w.upper()).alias("node_type"), n.alias("count"))) for w, n in zip(control.split(), each)]
    return F.struct(
        functions.alias("function_count"), count(cls).alias("class_count"), count(imp).alias("import_count"), control_hits.alias("control_count"), (control_hits + 1).alias("cyclomatic_complexity"),
        F.least(F.lit(3) + F.floor(functions / 5).cast("int"), F.lit(20)).alias("depth"), F.array_compact(F.array(*found)).alias("control"),
        *[text.rlike(compiled(p, ascii_only)).alias(k) for p, k in zip(flags, ("has_exec_calls", "has_eval_calls", "has_dynamic_imports", "has_network_calls", "has_file_io"))],
    )


def parse_text(files: DataFrame, language: str = "language", text: str = "text", ascii_only: bool = False, grammars: dict[str, tuple] | None = None) -> DataFrame:
    """Adds the counters and flags of the file's language; unsupported ones get the error unsupported_extension.

    grammars: own languages, or other expressions for known ones, in the form of lookups.GRAMMARS; a grammar may be a
    callable from the cleaned text to a struct of the same fields."""
    got, clean = None, F.col("_clean")
    hashed = F.col(language).isin(*L.HASH_COMMENTS)
    # cleaned once a row, below the generator, and not once a count
    files = files.withColumn("_clean", F.when(hashed, clean_source(F.col(text), L.HASH_COMMENTS[0])).otherwise(clean_source(F.col(text), "base")))
    for name, grammar in {**L.GRAMMARS, **(grammars or {})}.items():
        s = grammar(clean) if callable(grammar) else _language(clean, grammar, ascii_only)
        got = F.when(F.col(language) == name, s) if got is None else got.when(F.col(language) == name, s)
    out = files.select("*", F.inline(F.array(got))).drop("_clean")  # a generator: the struct is made once a row, not once a column
    nodes = F.lit(1) + F.col("function_count") + F.col("class_count") + F.col("import_count") + F.col("control_count")
    return out.withColumns({"node_count": nodes, "parse_error": F.when(F.col("function_count").isNull(), F.lit("unsupported_extension"))})


def text_nodes(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, parent_idx, depth, node_type, count: a root, a node for each definition and import, one for each control word."""
    one = lambda kind, n: F.array_repeat(F.struct(F.lit(kind).alias("node_type"), F.lit(1).alias("count")), n)
    all_ = F.concat(one("Module", F.lit(1)), one("FUNC_DEF", F.col("function_count")), one("CLASS_DEF", F.col("class_count")), one("IMPORT", F.col("import_count")), F.col("control"))
    return parsed.where("parse_error IS NULL").select(*keys, F.posexplode(all_).alias("idx", "n")).select(*keys, "idx", F.when(F.col("idx") > 0, 0).alias("parent_idx"), F.when(F.col("idx") > 0, 1).otherwise(0).alias("depth"), "n.*")


# Python ------------------------------------------------------------------------------------------------

CONTROL = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith)
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
DOCUMENTED = (*FUNCTIONS, ast.ClassDef, ast.Module)
CALLS = {n: flag for flag, names in L.CALL_NAMES.items() for n in names.split()}
CALL_FLAGS: dict[str, list[str]] = {}
for _flag, _names in L.CALL_NAMES.items():
    for _n in _names.split():
        CALL_FLAGS.setdefault(_n, []).append(_flag)
MODULE_FLAGS: dict[str, list[str]] = {}
for _flag, _names in L.MODULE_NAMES.items():
    for _n in _names.split():
        MODULE_FLAGS.setdefault(_n, []).append(_flag)
COUNTS = {"has_exec_calls": "count_exec", "has_eval_calls": "count_eval", "has_compile_calls": "count_compile", "has_dynamic_imports": "count_dynamic", "has_deserialisation": "count_deserialise", "has_privilege_calls": "count_privilege", "has_network_calls": "count_network", "has_file_io": "count_io", "has_obfuscation": "count_obfusc", "has_reflection": "count_reflection", "has_injection_risk": "count_inject", "has_concurrency": "count_concur"}
FLAGS = sorted({*L.CALL_NAMES, *L.MODULE_NAMES, *[v for v in L.HOOK_NAMES.values() if v], "has_pickle_gadgets", "has_exception_silence", "has_high_entropy", "has_metaclass", "has_dynamic_attr_set", "has_sys_modules_poison", "has_native_lib_load", "has_tainted_exec", "has_tainted_eval", "has_concat_exec", "has_file_write", "has_format_injection", "has_thread_local", "has_global_scope", "has_nested_functions", "has_slot_manipulation", "has_star_imports", "has_relative_imports", "has_chained_calls", "has_async"})
NUMBERS = ["node_count", "depth", "cyclomatic_complexity", "cognitive_complexity", "import_count", "function_count", "class_count", "async_function_count", "try_count", "except_count", "decorator_total", "max_nested_function_depth", "halstead_distinct_operators", "halstead_distinct_operands", "halstead_total_operators", "halstead_total_operands", "total_lines", "blank_lines", "chained_call_max_depth", "distinct_imports", "count_tainted_exec", "count_io_write", "count_hook_dunders", "count_format_calls", "count_silent_except", "count_star_imports", "count_relative_imports", *sorted(COUNTS.values())]
ENTROPY_HIGH = 5.2


def call_name(node: ast.Call) -> str:
    f = node.func
    return f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""


def silent(h: ast.ExceptHandler) -> bool:
    if len(h.body) != 1:
        return not h.body
    b = h.body[0]
    return isinstance(b, ast.Pass) or isinstance(b, ast.Expr) and isinstance(b.value, ast.Constant) and b.value.value is ...


def chain(node: ast.AST) -> int:
    n = 0
    while n <= 500:
        if isinstance(node, ast.Call):
            n, node = n + 1, node.func
        elif isinstance(node, ast.Attribute):
            node = node.value
        else:
            break
    return n


class FileFacts:
    """Flags, counters and, unless `rows` is false, nodes of one Python source, from one iterative walk of its tree."""

    def __init__(self, source: str, rows: bool = True):
        self.flags: Counter = Counter()
        self.n: Counter = Counter()
        self.modules: set[str] = set()
        self.operators: Counter = Counter()
        self.operands: Counter = Counter()
        self.nodes: list[tuple] = []
        self.errors: list[str] = []
        lines = source.splitlines()
        self.n["total_lines"], self.n["blank_lines"] = len(lines), sum(not r.strip() for r in lines)
        raw = source.encode("utf-8", "replace")
        p = np.bincount(np.frombuffer(raw, np.uint8)) / max(1, len(raw)) if raw else np.zeros(1)
        p = p[p > 0]
        self.entropy = float(-(p * np.log2(p)).sum()) + 0.0
        self.flags["has_high_entropy"] += self.entropy > ENTROPY_HIGH
        self.n["cyclomatic_complexity"] = 1
        if len(raw) > L.MAX_SOURCE:
            self.errors.append("FILE_TOO_LARGE")
            return
        try:
            tree = ast.parse(source)
        except SyntaxError as e:
            self.errors.append(f"SyntaxError:L{e.lineno}:C{e.offset}")
            return
        except (ValueError, RecursionError, MemoryError) as e:
            self.errors.append(type(e).__name__)
            return
        self.walk(tree, rows)

    def walk(self, tree: ast.AST, rows: bool) -> None:
        stack: list[tuple] = [(tree, None, 0, 0, 0)]  # node, parent's idx, depth, control nesting, function nesting
        idx = -1
        while stack:
            node, parent, depth, nest, inner = stack.pop()
            idx += 1
            if idx >= L.MAX_NODES:
                self.errors.append("TOO_MANY_NODES")
                return
            self.n["depth"] = max(self.n["depth"], depth)
            if depth > L.TREE_DEPTH:
                if rows:
                    self.nodes.append((idx, parent, depth, "DEPTH_LIMIT", {}))
                continue
            if rows:
                self.nodes.append((idx, parent, depth, type(node).__name__, self.properties(node)))
            self.visit(node, nest)
            control = isinstance(node, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Try))
            scope = isinstance(node, (*FUNCTIONS, ast.ClassDef, ast.Lambda))
            inner += isinstance(node, FUNCTIONS)
            self.n["_functions_deep"] = max(self.n["_functions_deep"], inner)
            below = 0 if scope else nest + control
            stack += [(c, idx, depth + 1, below, inner) for c in reversed(list(ast.iter_child_nodes(node)))]
        self.n["node_count"] = idx + 1
        self.n["max_nested_function_depth"] = max(0, self.n.pop("_functions_deep") - 1)
        self.flags["has_nested_functions"] += self.n["max_nested_function_depth"] >= 1
        self.n["halstead_distinct_operators"], self.n["halstead_total_operators"] = len(self.operators), sum(self.operators.values())
        self.n["halstead_distinct_operands"], self.n["halstead_total_operands"] = len(self.operands), sum(self.operands.values())
        self.n["distinct_imports"] = len(self.modules)

    def properties(self, node: ast.AST) -> dict[str, str]:
        p: dict = {}
        if isinstance(node, ast.Call):
            p = {"arg_count": len(node.args) + len(node.keywords), "has_starargs": any(isinstance(a, ast.Starred) for a in node.args), "has_star_kwargs": any(k.arg is None for k in node.keywords), "call_name": S_hash(call_name(node))}
        elif isinstance(node, FUNCTIONS):
            p = {"arg_count": len(node.args.args), "decorator_count": len(node.decorator_list), "is_async": isinstance(node, ast.AsyncFunctionDef), "name": S_hash(node.name)}
        elif isinstance(node, ast.Lambda):
            p = {"arg_count": len(node.args.args)}
        elif isinstance(node, ast.ClassDef):
            p = {"base_count": len(node.bases), "decorator_count": len(node.decorator_list), "has_metaclass": any(k.arg == "metaclass" for k in node.keywords), "name": S_hash(node.name)}
        elif isinstance(node, ast.ImportFrom):
            p = {"alias_count": len(node.names), "import_level": node.level}
        elif isinstance(node, ast.Import):
            p = {"alias_count": len(node.names)}
        elif isinstance(node, ast.ExceptHandler):
            p = {"has_type": node.type is not None}
        elif isinstance(node, ast.Constant):
            p = {"value_type": type(node.value).__name__, "numeric_magnitude": magnitude(node.value)}
        elif isinstance(node, ast.Name):
            p = {"name": S_hash(node.id)}
        return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in p.items() if v is not None}

    def named(self, name: str) -> None:
        for flag in CALL_FLAGS.get(name, ()):
            self.flags[flag] += 1
            if flag in COUNTS:
                self.n[COUNTS[flag]] += 1
        self.flags["has_dynamic_attr_set"] += name == "setattr"
        self.flags["has_native_lib_load"] += name in ("CDLL", "WinDLL", "cdll", "windll", "dlopen")
        self.flags["has_thread_local"] += name == "local"

    def module(self, name: str) -> None:
        top = name.split(".")[0].lower()
        self.modules.add(top)
        for flag in MODULE_FLAGS.get(top, ()):
            self.flags[flag] += 1

    def visit(self, node: ast.AST, nest: int) -> None:
        n, flags = self.n, self.flags
        if isinstance(node, (*CONTROL, ast.Assert, ast.comprehension, ast.IfExp)):
            n["cyclomatic_complexity"] += 1
        if isinstance(node, CONTROL):
            n["cognitive_complexity"] += 1 + nest
        if isinstance(node, ast.BoolOp):
            n["cyclomatic_complexity"] += len(node.values) - 1
            n["cognitive_complexity"] += len(node.values) - 1
            self.operators[type(node.op).__name__] += 1
        elif isinstance(node, ast.Match):
            n["cyclomatic_complexity"] += max(len(node.cases) - 1, 0)
        elif isinstance(node, (ast.BinOp, ast.UnaryOp, ast.AugAssign)):
            self.operators[type(node.op).__name__] += 1
        elif isinstance(node, ast.Compare):
            for op in node.ops:
                self.operators[type(op).__name__] += 1
        elif isinstance(node, ast.Name):
            self.operands[node.id] += 1
        elif isinstance(node, ast.Constant):
            self.operands["const:" + type(node.value).__name__] += 1
        if isinstance(node, ast.Call):
            self.call(node)
        elif isinstance(node, FUNCTIONS):
            n["function_count"] += 1
            n["decorator_total"] += len(node.decorator_list)
            n["async_function_count"] += isinstance(node, ast.AsyncFunctionDef)
            flags["has_async"] += isinstance(node, ast.AsyncFunctionDef)
            flags["has_pickle_gadgets"] += node.name in L.PICKLE_NAMES
            if node.name in L.HOOK_NAMES:
                own = L.HOOK_NAMES[node.name]
                n["count_hook_dunders"] += 2 if own else 1  # those with a flag of their own count twice
                if own:
                    flags[own] += 1
        elif isinstance(node, ast.ClassDef):
            n["class_count"] += 1
            n["decorator_total"] += len(node.decorator_list)
            flags["has_metaclass"] += any(k.arg == "metaclass" for k in node.keywords)
        elif isinstance(node, ast.Import):
            n["import_count"] += 1
            for a in node.names:
                self.module(a.name)
        elif isinstance(node, ast.ImportFrom):
            n["import_count"] += 1
            if node.level:
                flags["has_relative_imports"] += 1
                n["count_relative_imports"] += 1
            if node.module:
                self.module(node.module)
            for a in node.names:
                if a.name == "*":
                    flags["has_star_imports"] += 1
                    n["count_star_imports"] += 1
                else:
                    self.named(a.name)
        elif isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Subscript) and isinstance(t.value, ast.Attribute) and t.value.attr == "modules":
                    flags["has_sys_modules_poison"] += 1
                flags["has_slot_manipulation"] += isinstance(t, ast.Name) and t.id == "__slots__"
        elif isinstance(node, ast.Global):
            flags["has_global_scope"] += 1
        elif isinstance(node, (ast.AsyncFor, ast.AsyncWith, ast.Await)):
            flags["has_async"] += 1
        elif isinstance(node, ast.ExceptHandler):
            n["except_count"] += 1
            if silent(node):
                flags["has_exception_silence"] += 1
                n["count_silent_except"] += 1
        elif isinstance(node, (ast.Try, ast.TryStar)):
            n["try_count"] += 1

    def call(self, node: ast.Call) -> None:
        name, n, flags = call_name(node), self.n, self.flags
        self.named(name)
        deep = chain(node)
        n["chained_call_max_depth"] = max(n["chained_call_max_depth"], deep)
        flags["has_chained_calls"] += deep > 3
        first = node.args[0] if node.args else None
        if name in ("exec", "execfile", "eval") and first is not None:
            if not (isinstance(first, ast.Constant) and isinstance(first.value, str)):
                flags["has_tainted_eval" if name == "eval" else "has_tainted_exec"] += 1
                n["count_tainted_exec"] += 1
            flags["has_concat_exec"] += isinstance(first, ast.BinOp) and isinstance(first.op, ast.Add)
        if name == "open":
            mode = node.args[1] if len(node.args) > 1 else next((k.value for k in node.keywords if k.arg == "mode"), None)
            if isinstance(mode, ast.Constant) and isinstance(mode.value, str) and set(mode.value) & set("wax"):
                flags["has_file_write"] += 1
                n["count_io_write"] += 1
        if name == "format":
            flags["has_format_injection"] += 1
            n["count_format_calls"] += 1


def S_hash(name: str) -> str:
    import hashlib

    return "ID_" + hashlib.sha256(name.encode("utf-8", "replace")).hexdigest()[:8]


def magnitude(v) -> str | None:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    a = abs(v)
    return "zero" if a == 0 else "byte_range" if a < 256 else "word_range" if a < 65536 else "dword_range" if a < 4294967296 else "large"


NAMED = {"name", "id", "attr", "arg", "asname", "module", "rest"}


def stripped(source: str) -> str:
    """The source without docstrings and annotations, with literals blanked and names hashed."""
    tree = ast.parse(source)
    stack: list[ast.AST] = [tree]
    while stack:
        node = stack.pop()
        kind = type(node)
        if kind is ast.Constant:
            v = node.value
            if not (v is None or v is ... or isinstance(v, bool)):
                node.value = "" if isinstance(v, str) else b"" if isinstance(v, bytes) else 0
            continue
        if kind in DOCUMENTED and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        elif kind is ast.Global or kind is ast.Nonlocal:
            node.names = [S_hash(v) for v in node.names]
        for field in kind._fields:
            v = getattr(node, field, None)
            if v is None:
                continue
            if (field == "annotation" or field == "returns") and kind is not ast.AnnAssign:
                setattr(node, field, None)
            elif isinstance(v, list):
                stack += [c for c in v if isinstance(c, ast.AST)]
            elif isinstance(v, ast.AST):
                if v._fields:
                    stack.append(v)
            elif field in NAMED and isinstance(v, str) and v != "*":
                setattr(node, field, S_hash(v))
    return ast.unparse(tree)


#: Sources whose results are in Python's memory together, whatever the session's Arrow batches hold.
TOGETHER = 200


def sources_of(it, key: str, text: str):
    """(keys, an iterator of sources, empty if null) of at most TOGETHER rows at a time; a source is read when its turn comes."""
    for b in it:
        keys, texts = (b.column(b.schema.get_field_index(c)) for c in (key, text))
        for at in range(0, b.num_rows, TOGETHER):
            yield keys.slice(at, TOGETHER), (t.as_py() or "" for t in texts.slice(at, TOGETHER))


def file_row(source: str) -> tuple:
    """What `python_files` keeps of a source; its tree and counters go at once."""
    f = FileFacts(source, rows=False)
    return [(k, f.flags[k] > 0) for k in FLAGS], [(k, int(f.n[k])) for k in NUMBERS], f.entropy, f.n["blank_lines"] / max(1, f.n["total_lines"]), sorted(f.modules), f.errors


def python_files(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, flags (MAP), numbers (MAP), source_entropy, blank_ratio, modules and parse_errors of each Python source."""
    kind = dict(files.dtypes)[key]

    def run(it):
        kinds = [pa.map_(pa.string(), pa.bool_()), pa.map_(pa.string(), pa.int64()), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
        for keys, texts in sources_of(it, key, text):
            columns = zip(*map(file_row, texts))
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns, kinds)], names=[key, "flags", "numbers", "source_entropy", "blank_ratio", "modules", "parse_errors"])

    return files.select(key, text).mapInArrow(run, f"{key} {kind}, flags map<string,boolean>, numbers map<string,long>, source_entropy double, blank_ratio double, modules array<string>, parse_errors array<string>")


def places(parents: tuple) -> list[list[int]]:
    """For each node, given its parent's number, its child positions from the root down."""
    out, children = [], Counter()
    for p in parents:
        if p is None:
            out.append([])
        else:
            out.append([*out[p], children[p]])
            children[p] += 1
    return out


def python_nodes(files: DataFrame, key: str, text: str = "text", paths: bool = False) -> DataFrame:
    """key, idx, parent_idx, depth, node_type, props: the syntax tree of each Python source, a row a node, in pre-order.

    With `paths` each node's path too: its child positions from the root down. A source that gives no tree is a module alone."""
    kind = dict(files.dtypes)[key]
    more = ["path"] if paths else []

    def run(it):
        for b in it:
            keys = b.column(b.schema.get_field_index(key))
            for i, t in enumerate(b.column(b.schema.get_field_index(text)).to_pylist()):
                nodes = FileFacts(t or "").nodes or ([(0, None, 0, "Module", {})] if paths else [])
                if nodes:
                    idx, parent, depth, types, props = zip(*nodes)
                    path = [pa.array(places(parent), pa.list_(pa.int32()))] if paths else []
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i].as_py()] * len(idx), keys.type), pa.array(idx, pa.int32()), pa.array(parent, pa.int32()), pa.array(depth, pa.int32()), pa.array(types, pa.string()), pa.array([list(p.items()) for p in props], pa.map_(pa.string(), pa.string())), *path], names=[key, "idx", "parent_idx", "depth", "node_type", "props", *more])

    return files.select(key, text).mapInArrow(run, f"{key} {kind}, idx int, parent_idx int, depth int, node_type string, props map<string,string>" + ", path array<int>" * paths)


def python_stripped(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, stripped and error of each Python source; what does not parse has no text but the name of its error."""
    kind = dict(files.dtypes)[key]

    def one(source):
        try:
            return stripped(source), None
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return None, type(e).__name__

    def run(it):
        for keys, texts in sources_of(it, key, text):
            got = [one(t) for t in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[key, "stripped", "error"])

    return files.select(key, text).mapInArrow(run, f"{key} {kind}, stripped string, error string")
