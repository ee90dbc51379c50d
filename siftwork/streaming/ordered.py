"""Stateful operators that see each key's rows in the order of their event time, with timers on event time.

Rows wait in the state of their key until the watermark has passed them; then they are folded in order, whatever
batches they came in, and what falls due between two rows (the end of a lifetime, say) happens between
them. What falls due after the last row happens once the watermark passes it, without a further event. Rows later than
the watermark allows are dropped by Spark. State is kept by the RocksDB provider and recovered from the
stream's checkpoint.

Null keys are a key of their own; rows without an event time never come due and are left out.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LIFETIME = 3600.0
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Fold(StatefulProcessor):
    """step(key, state, row) and due(key, state) -> (when, call): see `folded`."""

    def __init__(self, columns: list[str], fields: list[str], schema: str, step: Callable, due: Callable | None):
        self.columns, self.fields, self.schema, self.step, self.due = columns, fields, schema, step, due

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        ready, rest = sorted((r for r in rows if r[0] <= now), key=lambda r: r[:2]), [r for r in rows if r[0] > now]
        before = self.state.get() if self.state.exists() else None
        state, given, due = json.loads(before[0]) if before else None, {}, None

        def give(result):
            nonlocal state
            state, rows = result
            for r in rows:  # of rows of one identity the last counts
                given[r[0]] = r[1]

        def owed(until):
            nonlocal due
            while self.due and state is not None and (due := self.due(key, state)) is not None and due[0] < until:
                give(due[1]())

        for r in ready:
            owed(r[0])
            give(self.step(key, state, dict(zip(self.columns, r))))
        owed(now + 1)
        if len(rest) < len(rows):
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if state is None:
            if before:
                self.state.clear()
        elif (text := json.dumps(state)) != (before[0] if before else None):
            self.state.update((text,))
        # all of these lie ahead: a timer set anew for the time that fires now would be lost
        times = ([-(-min(r[0] for r in rest) // 1000)] if rest else []) + ([-(-due[0] // 1000)] if due and state is not None else [])
        for t in times:
            self.handle.registerTimer(t)
        for r in given.values():
            yield Row(**dict(zip(self.fields, r)))

    def close(self) -> None:
        pass


def folded(stream: DataFrame, keys: list[str], order: str, values: list[str], output: str, step: Callable, due: Callable | None = None, late: str = "10 minutes") -> DataFrame:
    """Folds each key's rows in the order of (event time `ts`, `order`).

    step(key, state, row) returns (state, rows): the state (None at first, anything that JSON can hold; None ends
    the key) and a list of (identity, values of `output` in order). due(key, state) returns None or (microseconds, call): at that
    time, if no row comes before, call() returns (state, rows) likewise. `row` has the columns _at (microseconds), `order` and `values`."""
    columns = ["_at", order, *values]
    ready = stream.where("ts IS NOT NULL").withWatermark("ts", late).withColumn("_at", F.unix_micros("ts"))
    kinds = dict(ready.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    fields = [f.split()[0] for f in output.split(", ")]
    return ready.select(*keys, "ts", *columns).groupBy(*keys).transformWithState(Fold(columns, fields, schema, step, due), output, "update", "eventTime")


def lifetimes(stream: DataFrame, key: str, kind: str, order: str, begins: str, ends: str, lifetime: float = LIFETIME, late: str = "10 minutes") -> DataFrame:
    """key, created, ended, reason of every life: it begins with an event `begins` while none runs, and ends with `ends`
    (requested) or after `lifetime` seconds (lifetime_exceeded), with or without a further event. One that runs has a null end."""
    length = round(lifetime * 1e6)

    def row(key, state, at, reason):
        return state["made"], (key[0], state["made"] / 1e6, None if at is None else at / 1e6, reason)

    def step(key, state, r):
        if state is None:
            if r[kind] != begins:
                return None, []
            state = {"made": r["_at"]}
            return state, [row(key, state, None, None)]
        return (None, [row(key, state, r["_at"], "requested")]) if r[kind] == ends else (state, [])

    def due(key, state):
        at = state["made"] + length
        return at, lambda: (None, [row(key, state, at, "lifetime_exceeded")])

    return folded(stream, [key], order, [kind], f"{key} {dict(stream.dtypes)[key]}, created double, ended double, reason string", step, due, late)


#: The stages that a view shows.
STAGES = "fetch parse ir ml policy strategy iac deploy".split()
VIEW = "status string, started double, last_stage string, method string, decision string, stages map<string,string>, machines map<string,string>, reviews map<string,string>, completed long, approved long, rejected long, escalated long"


def view_change(state: dict | None, r: dict) -> dict:
    """The view of a task after one more event: type, and of data what the type has (stage, status, id, decision, method, escalated)."""
    s = state or {"status": None, "started": None, "last_stage": None, "method": None, "decision": None, "stages": {}, "machines": {}, "reviews": {}, "completed": 0, "approved": 0, "rejected": 0, "escalated": 0}
    kind, known = r["type"], s["status"] is not None
    if kind == "task_started":
        s |= {"status": "running", "started": r["_at"] / 1e6, "last_stage": None, "method": None, "decision": None, "stages": {}}
    elif kind == "stage_update":
        if r["stage"] in STAGES:
            s["stages"][r["stage"]] = r["status"]
        if r["stage"] == "iac" and r["status"] == "complete":
            s["method"] = r["method"] or ""
        if known:
            s["last_stage"] = r["stage"]
    elif kind == "hitl_required":
        s["reviews"][r["id"]] = "pending"
    elif kind == "hitl_resolved":
        if r["id"] in s["reviews"]:
            s["reviews"][r["id"]] = "resolved"
    elif kind == "vm_created":
        s["machines"][r["id"]] = "running"
    elif kind == "vm_terminated":
        if r["id"] in s["machines"]:
            s["machines"][r["id"]] = "terminated"
    elif kind == "environment_teardown":
        s["machines"] = dict.fromkeys(s["machines"], "terminated")
    elif kind == "task_complete":
        s |= {"status": "complete", "decision": r["decision"], "completed": s["completed"] + 1, "approved": s["approved"] + (r["decision"] == "APPROVE"), "rejected": s["rejected"] + (r["decision"] == "REJECT"), "escalated": s["escalated"] + bool(r["escalated"])}
        if r["method"] is not None:
            s["method"] = r["method"]
        if r["decision"] == "REJECT":
            s["stages"] = dict.fromkeys(STAGES, "error")
    elif kind == "task_failed":
        s["stages"] = dict.fromkeys(STAGES, "error")
    return s


def views(stream: DataFrame, key: str, order: str, late: str = "10 minutes") -> DataFrame:
    """A row a task with what a monitor shows of it after its last event: columns key and VIEW.

    Needs ts, type, stage, status, id, decision, method and escalated. Nine types change the view, others nothing:
    a start resets stages; a teardown ends all machines; a rejection or a failure marks all stages."""

    def step(key, state, r):
        s = view_change(state, r)
        return s, [(None, (key[0], *(s[f.split()[0]] for f in VIEW.split(", "))))]

    return folded(stream, [key], order, ["type", "stage", "status", "id", "decision", "method", "escalated"], f"{key} {dict(stream.dtypes)[key]}, {VIEW}", step, None, late)


class Ring(StatefulProcessor):
    """The newest rows of a key: at most `most`, in a list that is written anew when rows come."""

    def __init__(self, columns: list[str], schema: str, key: str, most: int):
        self.columns, self.schema, self.key, self.most = columns, schema, key, most

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        old = [tuple(r) for r in self.ring.get()]
        # a heap of `most`, so that a key's batch is never held
        newest = heapq.nlargest(self.most, (t for part in (old, (tuple(r[c] for c in self.columns) for r in rows)) for t in part), key=lambda t: t[0])
        self.ring.put(newest)
        for place, t in enumerate(newest, 1):
            yield Row(**{self.key: key[0], **dict(zip(self.columns, t)), "place": place})

    def close(self) -> None:
        pass


def rings(stream: DataFrame, key: str, order: str, values: list[str], most: int) -> DataFrame:
    """key, order, values and place (1 is the newest) of the newest `most` rows of each key that had rows in the batch.

    `order` is not null; older rows leave the state. Rows of equal order keep the places in which they came."""
    columns = [order, *values]
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return stream.where(F.col(order).isNotNull()).select(key, *columns).groupBy(key).transformWithState(Ring(columns, schema, key, most), f"{key} {kinds[key]}, {schema}, place int", "update", "none")
