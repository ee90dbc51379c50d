"""From sources to vectors: cutting by path, renumbering, and hand-written expectations."""

import random

from pyspark.sql import functions as F

from siftwork.functions import lookups as L
from siftwork.operators import intermediate as I
from siftwork.operators import nodes as N
from siftwork.operators import patterns as P


def test_cut_below_equals_brute_force(spark):
    """Random trees with cuts inside cuts, at the root and at leaves; several files."""
    rng = random.Random(6)
    rows, want = [], set()
    for f in range(12):
        paths = [[]]
        for _ in range(60):
            up = rng.choice(paths)
            paths.append([*up, sum(len(p) == len(up) + 1 and p[:-1] == up for p in paths)])
        cut = {tuple(p) for p in paths if rng.random() < (0.1 if f else 0) and (p or f == 1)}
        rows += [(f, p, tuple(p) in cut) for p in paths]
        want |= {(f, tuple(p)) for p in paths if not any(tuple(p[:i]) in cut for i in range(len(p)))}
    got = I.cut_below(spark.createDataFrame(rows, "f int, path array<int>, c boolean").repartition(3), ["f"], F.col("c"))
    assert {(r.f, tuple(r.path)) for r in got.collect()} == want and 12 < len(want) < len(rows)
    n = N.number(got, ["f"]).collect()
    numbered = {(r.f, tuple(r.path)): r.idx for r in n}
    again = I.renumbered(got.withColumns({"idx": F.lit(0), "parent_idx": F.lit(0)}), ["f"]).collect()
    assert all(r.idx == numbered[r.f, tuple(r.path)] and r.parent_idx == (numbered[r.f, tuple(r.path[:-1])] if r.path else None) for r in again) and len(again) == len(want)


SOURCES = [
    (1, "import os\ntry:\n    os.system(x)\nexcept:\n    pass\n"),
    (2, "def broken(:\n"),
    (3, None),
    (4, "x = " + "-" * 70 + "1"),
    (5, "class A:\n    def f(self):\n        return [i for i in self.g(1, 2, 3, 4, 5, 6, 7, 8, 9)]\n"),
]


def test_rows_of_sources(spark):
    s = spark.createDataFrame(SOURCES, "k int, text string").repartition(2)
    about = I.files(s, "k")
    rows = I.nodes(s, about, "k")
    by = {k: [r for r in rows.orderBy("k", "idx").collect() if r.k == k] for k in range(1, 6)}
    for own in by.values():  # pre-order numbers without gaps, parents before their children
        assert [r.idx for r in own] == list(range(len(own))) and own[0].parent_idx is None and all(r.parent_idx < r.idx for r in own[1:])
    assert by[1][0].props["has_privilege_calls"] == "true" and by[1][0].props["depth"] == "0" and "has_eval_calls" not in by[1][0].props
    assert [r.ir_type for r in by[1][:4]] == ["MODULE", "IMPORT", "EXPR", "TRY"] and {"privilege_detected", "silent_exception"} <= {r.source for r in by[1]}
    assert [(r.ir_type, r.source) for r in by[2]] == [("MODULE", None)] and [r.ir_type for r in by[3]] == ["MODULE"]
    deep = [r for r in by[4] if r.source is None]
    assert [r.ir_type for r in deep].count("TRUNCATED") >= 1 and max(r.depth for r in deep) == L.IR_DEPTH + 1 and all(r.depth == L.IR_DEPTH + 1 for r in deep if r.ir_type == "TRUNCATED")
    call = next(r for r in by[5] if r.ir_type == "CALL")
    assert call.risk_level == 4 and call.props["arg_count"] == "9"  # raised from 2 by its arguments, times 1.2
    cut = I.nodes(s, about, "k", cut=F.col("node_type") == "FunctionDef")
    left = [r.ir_type for r in cut.where("k = 5").orderBy("idx").collect()]
    assert left[:3] == ["MODULE", "CLASS_DEF", "FUNC_DEF"] and "CALL" not in left


def test_summaries_and_vectors(spark):
    s = spark.createDataFrame(SOURCES, "k int, text string")
    about = I.files(s, "k")
    rows = I.nodes(s, about, "k")
    got = {r.k: r for r in I.summaries(rows, "k").collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert "SILENT_EXCEPT" in got[1].patterns and got[1].privilege_sensitive_count == 2 and got[1].edges == got[1].total_nodes - 1
    assert (got[2].total_nodes, got[2].edges, got[2].weight, got[2].patterns, got[2].extra_risk, got[2].tokens) == (1, 0, 0.0, "", 0, ["MODULE"])
    assert got[4].max_depth == L.IR_DEPTH + 1
    v = {r.k: r for r in I.vectors(rows, about, "k").collect()}
    assert v[1].total_nodes == got[1].total_nodes and v[1].f_import_count == 1.0 and v[1].pattern_hit_count == P.hits(rows.where("k = 1"), ["k"]).count()
    assert v[3].total_nodes == 1.0 and v[3].mean_risk == 0.0 and v[5].f_class_count == 1.0
    assert I.summaries(I.nodes(s.limit(0), about.limit(0), "k"), "k").count() == 0
