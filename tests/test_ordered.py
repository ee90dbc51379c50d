"""Ordered folds, timers, views and rings over several batches, with restarts."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from siftwork.streaming import ordered, state

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "k int, ts timestamp, n long, kind string"


class Feed:
    """Files of rows (k, seconds, n, kind), a batch each, and a stream over them that goes on from its checkpoint."""

    def __init__(self, spark, at, schema=SCHEMA):
        self.spark, self.at, self.schema, self.files = spark, at, schema, 0

    def write(self, rows):
        rows = [(r[0], None if r[1] is None else START + timedelta(seconds=r[1]), *r[2:]) for r in rows]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.at}/in/f{self.files}")
        self.files += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{self.at}/in")

    def run(self, frame):
        """All rows that this run gave, in the order of batches."""
        out = []
        with state.rocks(self.spark):
            q = frame.writeStream.foreachBatch(lambda b, i: out.extend(b.collect()) and None).option("checkpointLocation", f"{self.at}/c").outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
        return out


def test_lives_end_without_an_event(spark, tmp_path):
    f = Feed(spark, tmp_path)
    lives = lambda: ordered.lifetimes(f.stream(), "k", "kind", "n", "begin", "end", 100.0, "10 seconds")
    f.write([(1, 0, 0, "begin"), (2, 0, 1, "begin"), (2, 41, 2, "end"), (3, 5, 3, "end"), (None, 6, 4, "begin"), (4, None, 5, "begin"), (5, 50, 6, "other")])
    got = f.run(lives())
    at = START.timestamp()
    seen = {(r.k, r.created - at, r.ended and r.ended - at, r.reason) for r in got}
    assert seen == {(1, 0, None, None), (2, 0, None, None), (None, 6, None, None)}  # second 41 is not behind the watermark yet
    f.write([(5, 300, 7, "other")])  # only time goes on; the run is a restart
    got = f.run(lives())
    seen = {(r.k, r.created - at, r.ended - at, r.reason) for r in got}
    assert seen == {(1, 0, 100, "lifetime_exceeded"), (2, 0, 41, "requested"), (None, 6, 106, "lifetime_exceeded")}
    f.write([(1, 400, 8, "begin"), (1, 500, 9, "end"), (2, 301, 10, "begin"), (2, 402, 11, "end"), (2, 402, 12, "begin"), (5, 900, 13, "other")])
    seen = {(r.k, r.created - at, r.ended - at, r.reason) for r in f.run(lives())}
    assert seen == {(1, 400, 500, "requested"), (2, 301, 401, "lifetime_exceeded"), (2, 402, 502, "lifetime_exceeded")}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_and_order_of_arrival_do_not_matter(spark, tmp_path, seed):
    """Rows out of order within the delay, dealt to batches at random, give what one sorted pass gives."""
    rng = random.Random(seed)
    rows = [(rng.randrange(3), i * 7 + rng.random(), i, rng.choice(["begin", "end", "other"])) for i in range(120)]
    f = Feed(spark, tmp_path)
    late = sorted(rows, key=lambda r: r[1] + rng.random() * 50)
    for i in range(0, 120, 40):
        f.write(late[i : i + 40])
    f.write([(9, 5000, 999, "other")])
    got = {}
    for r in f.run(ordered.lifetimes(f.stream(), "k", "kind", "n", "begin", "end", 60.0, "60 seconds")):
        got[r.k, round(r.created - START.timestamp(), 3)] = r.reason
    want, made = {}, {}
    for k, t, _, kind in sorted(rows, key=lambda r: r[1]):
        if k in made and t > made[k] + 60:
            want[k, round(made.pop(k), 3)] = "lifetime_exceeded"
        if kind == "begin" and k not in made:
            made[k] = t
        elif kind == "end" and k in made:
            want[k, round(made.pop(k), 3)] = "requested"
    want |= {(k, round(t, 3)): "lifetime_exceeded" for k, t in made.items()}
    assert got == want


def event(kind, **data):
    return {"_at": 1_000_000, "type": kind, "stage": None, "status": None, "id": None, "decision": None, "method": None, "escalated": None} | data


def test_view_of_nine_types():
    """The browser's rules, one after the other."""
    s = ordered.view_change(None, event("vm_terminated", id="a"))
    assert s["machines"] == {} and s["status"] is None
    steps = [event("stage_update", stage="fetch", status="running"), event("task_started"), event("stage_update", stage="network", status="complete"), event("stage_update", stage="iac", status="complete", method="hybrid"), event("vm_created", id="a"), event("vm_created", id="b"), event("vm_terminated", id="a"), event("hitl_resolved", id="q"), event("hitl_required", id="r")]
    for e in steps:
        s = ordered.view_change(s, e)
    assert (s["status"], s["last_stage"], s["method"], s["stages"], s["machines"], s["reviews"]) == ("running", "iac", "hybrid", {"iac": "complete"}, {"a": "terminated", "b": "running"}, {"r": "pending"})
    s = ordered.view_change(s, event("environment_teardown"))
    assert set(s["machines"].values()) == {"terminated"}
    s = ordered.view_change(s, event("hitl_resolved", id="r"))
    s = ordered.view_change(s, event("task_complete", decision="REJECT", escalated=True))
    assert s["reviews"] == {"r": "resolved"} and set(s["stages"].values()) == {"error"} and len(s["stages"]) == 8 and s["method"] == "hybrid"
    assert (s["status"], s["decision"], s["completed"], s["approved"], s["rejected"], s["escalated"]) == ("complete", "REJECT", 1, 0, 1, 1)
    s = ordered.view_change(s, event("task_started"))
    assert (s["status"], s["stages"], s["decision"], s["rejected"]) == ("running", {}, None, 1)
    assert set(ordered.view_change(s, event("task_failed"))["stages"].values()) == {"error"}
    assert ordered.view_change(dict(s), event("odd")) == s


def test_views_over_batches(spark, tmp_path):
    f = Feed(spark, tmp_path, "k int, ts timestamp, n long, type string, stage string, status string, id string, decision string, method string, escalated boolean")
    full = lambda k, t, n, kind, **d: (k, t, n, kind, *(d.get(c) for c in ("stage", "status", "id", "decision", "method", "escalated")))
    views = lambda: ordered.views(f.stream(), "k", "n", "1 second")
    f.write([full(1, 10, 2, "stage_update", stage="ir", status="running"), full(1, 5, 1, "task_started"), full(2, 1, 1, "vm_created", id="m")])
    f.write([full(1, 20, 3, "vm_created", id="m"), full(2, 21, 2, "environment_teardown")])
    f.write([full(3, 100, 9, "odd")])
    last = {r.k: r for r in f.run(views())}
    assert last[1].stages == {"ir": "running"} and last[1].machines == {"m": "running"} and last[1].started == START.timestamp() + 5
    assert last[2].machines == {"m": "terminated"} and last[2].status is None and 3 not in last
    f.write([full(1, 200, 4, "task_complete", decision="APPROVE", escalated=False), full(3, 300, 10, "odd")])
    last = {r.k: r for r in f.run(views())}
    assert last[1].status == "complete" and last[1].approved == 1 and last[1].stages == {"ir": "running"}


def test_rings_hold_the_newest(spark, tmp_path):
    """After each batch as many as bounded history has; older rows that come late do not drive newer ones out."""
    from siftwork.operators import history

    rng = random.Random(4)
    f, every, order = Feed(spark, tmp_path), [], list(range(90))
    rng.shuffle(order)
    for i in range(0, 90, 30):
        rows = [(rng.choice([1, 1, 2, None]), n, n, f"v{n}") for n in order[i : i + 30]] + [(1, 0, None, "left out")]
        every += [r for r in rows if r[2] is not None]
        f.write(rows)
        got = f.run(ordered.rings(f.stream(), "k", "n", ["kind"], 5))
        want = history.bounded(spark.createDataFrame([(k, n, v) for k, _, n, v in every], "k int, n long, kind string"), ["k"], "n", 5).collect()
        changed = {r[0] for r in rows if r[2] is not None}
        assert sorted(map(str, got)) == sorted(str(r) for r in want if r.k in changed)


def test_requests_expire_only_by_the_watermark(spark, tmp_path):
    """Answers that come first wait for their request; requests expire once no answer can come."""
    asks, answers = Feed(spark, tmp_path / "a", "request_id int, ts timestamp"), Feed(spark, tmp_path / "b", "request_id int, ts timestamp, decision string")
    joined = lambda: state.answers(asks.stream(), answers.stream(), "1 hour", "1 minute")
    out = []

    def run():
        out.clear()
        joined().writeStream.foreachBatch(lambda b, i: out.extend(b.select("request_id", "decision", "expired").collect()) and None).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in out)

    asks.write([(1, 0), (2, 10)])
    answers.write([(1, 100, "APPROVE"), (3, 500, "REJECT"), (2, 3700, "late")])
    assert run() == [(1, "APPROVE", False)]
    asks.write([(3, 400)])  # asked in time, heard of late
    assert run() == [(3, "REJECT", False)]
    asks.write([(4, 20000)])
    answers.write([(9, 20000, "unknown")])
    assert run() == [(2, None, True)]


def test_machines_of_many_rows_and_late_batches(spark, tmp_path):
    """A key's rows come in many Arrow batches and files, newest first; only their times count."""
    f = Feed(spark, tmp_path)
    rows = [(1, 5000 - i, i, "other") for i in range(40)] + [(1, 100, 40, "end"), (1, 90, 41, "begin"), (1, 95, 42, "end"), (2, 10, 43, "end"), (2, 10, 44, "begin"), (None, 1, 45, "begin")]
    f.write([(3, 50, 46, "end"), (4, 9000, 47, "end"), (6, 8, 51, "end"), (7, None, 52, "begin")])
    f.write(rows + [(3, 40, 48, "begin"), (4, 10, 49, "begin"), (5, 7, 50, "begin")])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        m = state.machines(f.stream().withColumn("s", F.unix_micros("ts") / F.lit(1e6)), "k", "kind", "s", "begin", "end", 7200.0)
        got = state.collected(m, "update", ["key"]).collect()
    finally:
        spark.conf.set(key, before)
    at = START.timestamp()
    assert {(r.key, r.state, r.created and r.created - at, r.ended and r.ended - at, r.reason) for r in got} == {
        (1, "terminated", 90, 95, "requested"), (2, "terminated", 10, 10, "requested"), (3, "terminated", 40, 50, "requested"), (4, "terminated", 10, 7210, "timeout"),
        (5, "running", 7, None, None), (6, "terminated", None, 8, "orphan"), (7, "unknown", None, None, None),
    }
