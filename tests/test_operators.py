"""Operators on small tables with results worked out by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.functions import lookups as L
from siftwork.functions import scalars as S
from siftwork.operators import dataset, history, nodes, patterns, scoring, structure, validate
from siftwork.sources import files as sources

NODE = "f int, idx int, parent_idx int, depth int, ir_type string, category string, source string, props map<string,string>"


def found(spark, rows):
    data = [(1, i, 0 if i else None, r[1] if len(r) > 1 else 0, r[0], "x", r[3] if len(r) > 3 else None, r[2] if len(r) > 2 else {}) for i, r in enumerate(rows)]
    return {r.pattern_id: r.node_indices for r in patterns.hits(spark.createDataFrame(data, NODE), ["f"]).collect()}


def test_global_write_window(spark):
    assert found(spark, [("GLOBAL",)] + [("CALL",)] * 8 + [("ASSIGN",)])["GLOBAL_WRITE"] == [0, 9]
    assert "GLOBAL_WRITE" not in found(spark, [("GLOBAL",)] + [("CALL",)] * 9 + [("ASSIGN",)])


def test_async_band(spark):
    assert found(spark, [("AWAIT",)] + [("CALL",)] * 4 + [("DYNAMIC",)])["ASYNC_DYNAMIC"] == [5]
    assert "ASYNC_DYNAMIC" not in found(spark, [("AWAIT",)] + [("CALL",)] * 5 + [("DYNAMIC",)])


def test_sequence_and_pairs(spark):
    got = found(spark, [("IMPORT", 3), ("CALL", 0, {"arg_count": "5"}), ("DYNAMIC", 6, {}, "exec_detected"), ("NETWORK",), ("DESER",), ("HOOK",), ("FUNC_DEF",), ("PASS",), ("CATCH",)])
    assert got["EXEC_CHAIN"] == [0, 1, 2] and got["EXFIL_CHAIN"] == [2, 3] and got["DESER_EXEC"] == [4, 1] and got["HOOK_PATTERN"] == [5, 6]
    assert got["SHADOW_IMPORT"] == [0] and got["DEEP_DYNAMIC"] == [2] and got["SILENT_EXCEPT"] == [8]


def test_empty_nodes(spark):
    assert patterns.hits(spark.createDataFrame([], NODE), ["f"]).count() == 0


def test_classify_refines_and_floors(spark):
    rows = [("Call", {"arg_count": "9"}), ("Call", {"has_starargs": "true"}), ("Global", {}), ("ClassDef", {"has_metaclass": "true"}), ("Nothing", {}), ("ExceptHandler", {"has_type": "false"}), ("IMPORT", {"import_level": "2"})]
    d = nodes.classify(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, node_type string, props map<string,string>"))
    assert [(r.ir_type, r.risk_level) for r in d.orderBy("i").collect()] == [("CALL", 4), ("CALL", 3), ("GLOBAL", 9), ("CLASS_DEF", 4), ("EXPR", 0), ("CATCH", 2), ("IMPORT", 3)]


def test_added_rows_follow_the_tree(spark):
    d = spark.createDataFrame([(1, 4, True, True, False)], "f int, last_idx int, has_exec_calls boolean, has_tainted_eval boolean, has_file_io boolean")
    assert [(r.idx, r.ir_type, r.risk_level) for r in nodes.added_rows(d, ["f"]).orderBy("idx").collect()] == [(5, "DYNAMIC", 9), (6, "TAINTED_EXEC", 10)]


def test_token_sequence_keeps_its_tail(spark):
    d = spark.createDataFrame([(1, i, "GLOBAL" if i == 3 else "ODD" if i == 4 else "CALL") for i in range(600)], "f int, idx int, ir_type string")
    t = nodes.token_sequence(d, ["f"]).first().tokens
    assert len(t) == 512 and t[-1] == "GLOBAL" and t[4] == "EXPR"


@pytest.mark.parametrize("n,expected", [(1, 1.0), (4, 2.5), (5, 5.0), (10, 10.0), (11, 10.0)])
def test_aggregate_risk(spark, n, expected):
    d = spark.createDataFrame([(k, float(i)) for i in range(1, n + 1) for k in (1, None)], "k int, x double")
    assert {r.k: r.aggregate_risk for r in scoring.aggregate_risk(d, ["k"], "x").collect()} == {1: expected, None: expected}


@pytest.mark.parametrize("cells,levels", [(1024, 2), (2, 1), (2, 2), (3, 4)])
def test_order_statistic(spark, cells, levels):
    """Skewed, equal, negative, tiny and null values; every place."""
    import random

    rng = random.Random(cells)
    groups = {0: [rng.random() for _ in range(200)], 1: [1e9, *[1.0] * 50, *[1.0 + i * 1e-12 for i in range(50)]], 2: [5.0] * 40, 3: [-3.0], 4: [None], 5: [*[0.5] * 99, 0.25, None]}
    d = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, x double").repartition(3)
    for share in (0.0, 0.4, 0.9, 0.999):
        got = {r.k: r.x for r in scoring.order_statistic(d, ["k"], "x", lambda n, q=share: F.floor(n * q), cells, levels).collect()}
        assert got == {k: sorted(x)[int(len(x) * share)] for k, vs in groups.items() if (x := [v for v in vs if v is not None])}


def test_decision_and_strategy(spark):
    cols = "task_id int, aggregate_risk double, high_risk_file_count int, total_files int, privileged_api_count int, total_ir_nodes int, anomalous_pattern_count int, mean_confidence double, flags array<string>"
    rows = [(1, 0.85, 0, 3, 0, 10, 0, 0.75, []), (2, 0.6, 4, 3, 11, 10, 6, 0.75, []), (3, 0.1, 0, 3, 0, 10, 0, 0.75, []), (4, 0.5, 0, 3, 0, 900, 6, 0.75, []), (5, 0.1, 0, 2, 0, 9, 0, 0.75, ["DYNAMIC_EXECUTION", "NETWORK_ACCESS"])]
    a = spark.createDataFrame(rows, cols)
    got = {r.task_id: (r.decision, r.method, r.rules_triggered) for r in scoring.strategy(scoring.decide(a)).collect()}
    assert got == {1: ("REJECT", "none", 2), 2: ("APPROVE_WITH_CONSTRAINTS", "imperative", 4), 3: ("APPROVE", "declarative", 0), 4: ("APPROVE_WITH_CONSTRAINTS", "hybrid", 1), 5: ("APPROVE", "declarative", 0)}
    assert scoring.decide(a, network_dynamic=True).where("task_id = 5").first().decision == "REJECT"
    files = [r.file for r in scoring.generated_files(scoring.strategy(scoring.decide(a)), ["task_id"]).where("task_id = 4").orderBy("ord").collect()]
    assert files[:2] == ["main.tf", "nsg.tf"] and "monitoring.tf" in files and "deploy.sh" not in files


def test_malice(spark):
    cols = "f int, " + ", ".join(f"{k} boolean" for k in L.MALICE_FLAGS)
    rows = [(1, True, True, False, False, False, False), (2, True, False, True, True, False, False), (3, True, False, True, False, False, False)]
    got = {r.f: (r.malicious, len(r.reasons)) for r in scoring.malice(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: (True, 1), 2: (True, 3), 3: (False, 0)}


def test_chain_detects_changes(spark):
    d = spark.createDataFrame([(k, i, f"e{i}") for k in (1, 2) for i in range(20)], "log int, seq int, event string")
    c = history.link(d, "log", "seq", ["seq", "event"]).cache()
    again = S.canonical_hash(F.to_json(F.struct("seq", "event", "prev_hash")))
    assert all(r.ok for r in history.verify(c, "seq", again, ["log"]).collect())
    bad = c.withColumn("event", F.when((F.col("log") == 1) & (F.col("seq") == 7), "x").otherwise(F.col("event")))
    assert {r.log: r.first_broken for r in history.verify(bad, "seq", again, ["log"]).collect()} == {1: 7, 2: None}
    gap = c.where("NOT (log = 2 AND seq = 5)")
    assert {r.log: r.first_broken for r in history.verify(gap, "seq", again, ["log"]).collect()} == {1: None, 2: 6}


def again(*fields):
    return S.canonical_hash(F.to_json(F.struct(*sorted(fields), "prev_hash")))


def test_one_long_chain_by_ranges(spark):
    """Breaks inside ranges and at their edges, in one range and in many."""
    d = spark.createDataFrame([(1, i, f"e{i}") for i in range(60)], "log int, seq long, event string")
    rows = history.link(d, "log", "seq", ["seq", "event"]).select("seq", "event", "prev_hash", "chain_hash").collect()
    for n in (1, 4, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for at in (0, 1, 29, 30, 59):
            changed = spark.createDataFrame([(*r[:1], "x" if r.seq == at else r.event, *r[2:]) for r in rows], "seq long, event string, prev_hash string, chain_hash string").repartition(7)
            whole = S.canonical_hash(F.to_json(F.struct("event", "prev_hash", "seq")))
            assert tuple(history.verify(changed, "seq", whole).first()) == (False, at, 60)
            gap = spark.createDataFrame([r for r in rows if r.seq != at], "seq long, event string, prev_hash string, chain_hash string")
            assert tuple(history.verify(gap, "seq", whole).first()) == ((True, None, 59) if at == 59 else (False, at + 1, 59))
        assert tuple(history.verify(changed.limit(0), "seq", whole).first()) == (True, None, 0)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_appended_batches_are_one_chain(spark, tmp_path):
    """Batches, one written twice, and keys that skip a batch; null keys are a chain too."""
    at = str(tmp_path / "log")
    batch = lambda keys, a: spark.createDataFrame([(k, f"e{a}{i}", a * 100 + i) for k in keys for i in range(3)], "log int, event string, o int")
    fields = ["seq", "event"]
    assert history.append(batch([1, 2, None], 0), at, "log", "o", fields) == 0
    assert history.append(batch([1], 1), at, "log", "o", fields) == 1
    history.append(batch([1], 9), at, "log", "o", fields, 1)  # replaces what it wrote before
    assert history.append(batch([2, 3, None], 2), at, "log", "o", fields) == 2
    with pytest.raises(ValueError):
        history.append(batch([1], 3), at, "log", "o", fields, 1)
    log = history.chained(spark, at)
    assert [r.event for r in log.where("log = 1").orderBy("seq").collect()] == ["e00", "e01", "e02", "e90", "e91", "e92"]
    got = {r.log: (r.ok, r.total) for r in history.verify(log, "seq", again("event", "seq"), ["log"]).collect()}
    assert got == {1: (True, 6), 2: (True, 6), 3: (True, 3), None: (True, 6)}
    gone = log.where("NOT (log = 2 AND seq = 2)")
    assert {r.log: r.first_broken for r in history.verify(gone, "seq", again("event", "seq"), ["log"]).collect()}[2] == 3


def test_streamed_chain_goes_on_after_a_restart(spark, tmp_path):
    def feed(a):
        spark.createDataFrame([(k, f"e{a}{i}", a * 10 + i) for k in (1, 2) for i in range(4)], "log int, event string, o int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("log int, event string, o int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        history.appended(stream, str(tmp_path / "log"), "log", "o", ["seq", "event"]).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    feed(0)
    run()
    feed(1)
    feed(2)
    run()
    log = history.chained(spark, str(tmp_path / "log"))
    assert {r.log: (r.ok, r.total) for r in history.verify(log, "seq", again("event", "seq"), ["log"]).collect()} == {1: (True, 12), 2: (True, 12)}
    assert log.where("prev_hash = '" + history.GENESIS + "'").count() == 2


def test_retry_loop(spark):
    ok, bad = lambda t, a: (t, a, 1, "x", True, None, None), lambda t, a, c: (t, a, 1, "x", False, c, f"d{a}")
    rows = [
        ok(1, 1), bad(1, 2, "LINT_ERROR"),  # what follows a pass does not count
        bad(2, 1, "RESOURCE_MISMATCH"), bad(2, 2, "HINT_MISMATCH"), ok(2, 3),  # one restart only
        bad(3, 1, "SYNTAX_ERROR"), bad(3, 2, "HINT_MISMATCH"), bad(3, 3, "PLAN_ERROR"), ok(3, 4),
        bad(4, 5, "SYNTAX_ERROR"), (4, 5, 0, "x", True, None, None), (4, 5, 2, "x", False, "PLAN_ERROR", "z"),  # the first failure of an attempt counts
        bad(5, 1, None), ok(5, 2),
    ]
    ended = validate.retries(spark.createDataFrame(rows, "t int, attempt int, ord int, name string, passed boolean, error_category string, detail string"), ["t"])
    got = {r.t: (r.state, r.attempts, r.restarts, r.ran.replace("strategy>iac>validate", "S").replace("iac>validate", "I"), r.category, (r.feedback or "")[-2:]) for r in ended.collect()}
    assert got == {1: ("passed", 1, 0, "S", None, ""), 2: ("passed", 3, 1, "S S I", None, "d2"), 3: ("aborted", 3, 1, "S I S", "PLAN_ERROR", "d3"), 4: ("open", 1, 0, "S", "SYNTAX_ERROR", "d5"), 5: ("passed", 2, 0, "S I", None, "d1")}
    steps = validate.retry_rows(ended, ["t"]).where("t = 3").orderBy("attempt").collect()
    assert [(r.attempt, r.outcome) for r in steps] == [(1, "retry"), (2, "retry"), (3, "aborted")]


def test_python_facts(spark):
    src = "import os\nclass A:\n    def __del__(self):\n        os.system(x)\n    def f(self):\n        def g():\n            try:\n                eval(a + b)\n            except:\n                pass\n            open('p', 'w')\n        return g\n"
    r = structure.python_files(spark.createDataFrame([(1, src), (2, "def ("), (3, None)], "k int, text string"), "k").collect()
    by = {x.k: x for x in r}
    f = {k for k, v in by[1].flags.items() if v}
    assert {"has_del_hook", "has_privilege_calls", "has_eval_calls", "has_tainted_eval", "has_concat_exec", "has_exception_silence", "has_file_write", "has_nested_functions"} <= f
    assert by[1].numbers["count_hook_dunders"] == 2 and by[1].numbers["max_nested_function_depth"] == 1 and by[1].modules == ["os"]
    assert by[2].parse_errors[0].startswith("SyntaxError:L1") and by[3].numbers["node_count"] == 1


def test_stripping_is_stable():
    src = 'def f(a: int) -> int:\n    """doc"""\n    return a + 12345 + len("secret")\n'
    out = structure.stripped(src)
    assert "doc" not in out and "secret" not in out and "12345" not in out and "int" not in out and "ID_" in out


def test_deep_tree_is_cut(spark):
    t = structure.python_nodes(spark.createDataFrame([(1, "x = " + "(" * 60 + "1" + ",)" * 60), (2, "x = " + "-" * 95 + "1")], "k int, text string"), "k")
    assert t.where("k = 2 AND node_type = 'DEPTH_LIMIT'").count() == 2
    assert t.where("k = 2").agg(F.max("depth")).first()[0] == L.TREE_DEPTH + 1


def test_regex_parser(spark):
    d = spark.createDataFrame([(1, "go", "import (\nfunc (r *T) Run(x int) {\n if a { defer b() } }\n// if\n"), (2, "php", "function f() { eval($x); } # class Q\n"), (3, "cobol", "x"), (4, "shell", None)], "k int, language string, text string")
    got = {r.k: r for r in structure.parse_text(d).collect()}
    assert (got[1].function_count, got[1].import_count, got[1].control_count) == (1, 1, 2)
    assert got[2].has_exec_calls and got[2].class_count == 0 and got[3].parse_error == "unsupported_extension"
    assert structure.text_nodes(structure.parse_text(d), ["k"]).where("k = 1").count() == 5


def test_validation(spark):
    assert [r.resource for r in validate.missing(spark.createDataFrame([(1, "azurerm_A "), (1, "b")], "k int, resource string"), spark.createDataFrame([(1, "B")], "k int, resource string"), ["k"]).collect()] == ["a"]
    h = validate.hint_coverage(spark.createDataFrame([(1, "AWS SDK", "x"), (1, "Redis cache", "redis"), (1, "New", "x"), (2, "GCP SDK", None)], "k int, hint string, text string"), ["k"])
    assert {r.k: (r.addressed, r.passed) for r in h.collect()} == {1: (2, True), 2: (0, False)}


def test_records_skip_bad_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"seq": 1, "event": "A"}\n\nnot json\n{"seq": 2, "event": "B"}\n')
    got = sources.read_records(spark, str(tmp_path / "log"))
    assert sorted(r.seq for r in got.collect()) == [1, 2]
    assert history.last_hash(got, "seq").first()[0] == history.GENESIS


def test_source_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "d/b.js").write_text("y")
    got = sources.source_files(spark, str(tmp_path)).orderBy("file_index").collect()
    assert [(r.extension, r.file_size_bytes) for r in got] == [(".py", 5), (".js", 1)]
    assert sources.archive({"a": "1"})[:2] == b"PK"


def test_samples_are_repeatable(spark):
    a, b = (dataset.generate(spark, 24).orderBy("sample_id").collect() for _ in range(2))
    assert a == b and all(0 <= x.risk_level <= 1 for x in a)
    required = {r.threat_class: r.required for r in dataset.threats(spark).collect()}
    assert all(set(required[r.threat_class]) <= set(r.tokens) for r in a)


@given(st.text(alphabet="ab\"'`/*\n", max_size=40))
@settings(max_examples=25, deadline=None)
def test_stripping_twice_changes_nothing(spark, text):
    d = spark.createDataFrame([(text,)], "t string").select(S.strip_strings(F.col("t")).alias("a"))
    r = d.select("a", S.strip_strings(F.col("a")).alias("b")).first()
    assert len(r.b) <= len(r.a)


def test_tokens_and_envelopes(spark):
    from siftwork.operators import records

    d = spark.createDataFrame([("a", "vm1", 1000)], "agent string, vm string, at long")
    r = d.select(records.token("k", F.col("agent"), F.col("vm"), F.col("at")).alias("t"), records.envelope("X", "a", "b", F.lit("task")).alias("e"))
    t = r.first().t.split("|")
    assert t[:3] == ["a", "vm1", "8200"] and len(t[3]) == 16 and r.first().e.schema_version == "1.0.0"
    ok = r.select(records.token_valid(F.col("t"), F.lit(8199)).alias("a"), records.token_valid(F.col("t"), F.lit(8200)).alias("b"), records.token_valid(F.lit("junk"), F.lit(0)).alias("c")).first()
    assert (ok.a, ok.b, ok.c) == (True, False, False)


def test_streamed_chain_and_upsert(spark, tmp_path):
    from siftwork.streaming import state

    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string, o int").parquet(str(tmp_path / "in"))
    state.upsert(stream, str(tmp_path / "out"), "k", "o").option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()} == {1: "b", 2: "c"}


def test_own_grammars(spark):
    from siftwork.operators import structure

    files = spark.createDataFrame([(1, "lua", "function f(a)\nlocal x = require(1)\nif x then end"), (2, "go", "func f() {}"), (3, "odd", "x")], "k int, language string, text string")
    lua = (r"\bfunction\s+(\w+)", None, r"\brequire\b", "if for while", r"\bload\b", r"\bload\b", r"\brequire\b", r"\bsocket\b", r"\bio\b")
    got = {r.k: (r.function_count, r.import_count, r.control_count, r.parse_error) for r in structure.parse_text(files, grammars={"lua": lua}).collect()}
    assert got[1] == (1, 1, 1, None) and got[2][0] == 1 and got[3] == (None, None, None, "unsupported_extension")
    assert {r.k: r.parse_error for r in structure.parse_text(files).collect()}[1] == "unsupported_extension"


def test_fitted_model_beats_the_mean(spark):
    from pyspark.sql import functions as F

    from siftwork.operators import dataset

    d = dataset.generate(spark, 1200).withColumn("v", dataset.feature_vector(F.col("tokens")))
    weights = dataset.fit(d.where("sample_id < 900"), "v", "labels")
    held = d.where("sample_id >= 900").select("labels", dataset.predict(F.col("v"), weights).alias("p")).collect()
    mean = [sum(r.labels[k] for r in held) / len(held) for k in range(6)]
    off = lambda of: sum(abs(of(r)[k] - r.labels[k]) for r in held for k in range(6))
    assert off(lambda r: r.p) < 0.6 * off(lambda r: mean)


def test_line_stats_equal_split_lines(spark):
    import random

    rng = random.Random(3)
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    texts = ["".join(rng.choice(["a", " ", "\t", "b ", *breaks]) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + ["", " ", "\n", "a"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", S.line_stats(F.col("t")).alias("s"))
    got = {r.i: (r.s.total, r.s.blank, r.s.blank_ratio) for r in d.collect()}
    for i, t in enumerate(texts):
        ls = t.splitlines()
        blank = sum(not x.strip(" \t") for x in ls)
        assert got[i] == (len(ls), blank, blank / max(1, len(ls)))
    assert got[-1] == (None, None, None)


@pytest.mark.parametrize("parts", [1, 7])
def test_places_of_skewed_values(spark, parts):
    """Nulls first, equal values together, values that differ by many magnitudes, in one range and in many."""
    values = [None, None, *[10.0**k for k in range(-20, 20)], *[5.0] * 30]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sorted((r.position, r.v) for r in history.placed(d, "v").collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [p for p, _ in got] == list(range(len(values))) and [v for _, v in got] == sorted(values, key=lambda v: (v is not None, v or 0))
    s = history.split(d, "v").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 57, "validation": 7, "test": 8} and history.split(d.limit(0), "v").count() == 0


def test_final_row_and_renderings(spark):
    """Variables follow constraints, feedback its bound and attempt; tasks that tables lack have defaults."""
    from siftwork.operators import records

    kinds = "task_id int, decision string, confidence double, aggregate_risk double, total_files int, high_risk_file_count int, anomalous_pattern_count int, hitl_required boolean, constraints array<string>, method string, told string"
    rows = [(1, "APPROVE_WITH_CONSTRAINTS", 0.9, 0.5, 3, 1, 2, False, ["network_isolation", "monitoring_required"], "hybrid", "\n".join(f"f{i}" for i in range(30))), (2, "REJECT", 0.9, 0.9, 1, 1, 0, False, [], "none", None), (3, "APPROVE", 0.9, 0.1, 1, 0, 0, True, [], "declarative", None)]
    d = spark.createDataFrame(rows, kinds)
    second = {(r.task_id, r.file): r.body for r in records.rendered(d, attempt=2, feedback="told").collect()}
    lines = second[1, "main.tf"].splitlines()
    assert lines[1:21] == [f"# f{i}" for i in range(20)] and lines[21] == "terraform {" and "# f" not in second[3, "main.tf"]
    assert [x for x in records.VARIABLES_IF.values() if f'"{x}"' in second[1, "variables.tf"]] == ["action_group_id", "key_vault_id"] and all(f'variable "{v}"' in second[3, "variables.tf"] for v in records.VARIABLES)
    first = records.rendered(d, feedback="told")
    assert not any("# f" in r.body for r in first.collect())
    table = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    got = {r.task_id: r for r in records.final(d, first, table([(1, 2, 1, 3.456), (3, 1, 0, 1.0)], "task_id int, clean_files long, killed_files long, seconds double"), table([(3, 4)], "task_id int, hitl_pending long"), table([(1, 9)], "task_id int, nodes int")).collect()}
    assert len(got[1]) == 21 and got[1].hitl_required and got[1].killed_files == 1 and got[1].duration_seconds == 3.46 and got[1].intelligence.nodes == 9 and got[1].ansible_files[-1] == "site.yml" and set(got[1].terraform_contents) == set(got[1].terraform_files)
    assert (got[2].terraform_files, got[2].terraform_contents, got[2].clean_files, got[2].hitl_required, got[2].intelligence, got[2].deployment_success) == ([], {}, 0, False, None, False) and got[3].hitl_pending == 4 and got[3].hitl_required


def test_sources_are_held_a_few_at_a_time(spark):
    """Python's memory does not follow the number of rows that a batch of Arrow has."""
    import gc
    import tracemalloc

    import pyarrow as pa

    src = "".join(f"def f{i}(a, b=1):\n    return a + b\n" for i in range(10))
    run = {}

    class Frame:
        dtypes = [("k", "int"), ("text", "string")]

        def select(self, *names):
            return self

        def mapInArrow(self, f, schema):
            run["f"] = f

    structure.python_files(Frame(), "k")
    peaks = []
    for n in (400, 2000):
        batch = pa.record_batch({"k": pa.array(range(n), pa.int32()), "text": pa.array([src] * n)})
        gc.collect()
        tracemalloc.start()
        rows = sum(b.num_rows for b in run["f"](iter([batch])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == n
    assert peaks[1] < 1.5 * peaks[0], peaks
    f = structure.FileFacts(src, rows=False)
    g = structure.FileFacts(src)
    assert f.nodes == [] and f.n == g.n and f.flags == g.flags and g.n["node_count"] == len(g.nodes)


def test_sources_are_dealt_to_all_tasks(spark, tmp_path):
    """A small table of keys makes more than one task's sources."""
    from siftwork.plans import python_queries

    spark.range(4000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = python_queries.python_stripped(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 4000 and len(rows) == spark.sparkContext.defaultParallelism and max(r["count"] for r in rows) < 2000
