"""Queries that run a stream over the events table to its end, with the SQL of the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import ordered as O
from ..streaming import state as X


def tumbling_counts(spark, sf_dir):
    w = X.tumbling(X.events(spark, sf_dir), "event_type", "1 hour")
    return X.collected(w, "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def session_activity(spark, sf_dir):
    """Sessions of half an hour; batch and stream give the same rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return X.sessions(e, "user_id", "30 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stage_latest(spark, sf_dir):
    s = X.latest(X.events(spark, sf_dir), ["user_id", "event_type"], "event_id", ["ts", "event_id"])
    return X.collected(s, "complete")


def latest_values(spark, sf_dir):
    s = X.latest(X.events(spark, sf_dir), ["user_id"], "event_type", ["ts", "event_id"])
    return X.collected(s, "complete")


def machine_rows(spark, sf_dir):
    e = X.events(spark, sf_dir)
    return X.machines(e.withColumn("s", F.unix_micros("ts") / F.lit(1e6)), "user_id", "event_type", "s", "view", "purchase", 7200.0)


def machine_states(spark, sf_dir):
    """A user's machine begins with a view and ends with a purchase, or by timeout."""
    m = X.collected(machine_rows(spark, sf_dir), "update", ["key"])
    return m.select(F.col("key").alias("user_id"), "state", "reason", F.round("created", 3).alias("created"), F.round("ended", 3).alias("ended"))


def machine_counts(spark, sf_dir):
    m = machine_states(spark, sf_dir)
    return m.agg(F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "terminated").alias("terminated"), F.count_if(F.col("reason") == "timeout").alias("timed_out"))


def review_answers(spark, sf_dir):
    """Errors ask for review; each of the three events after one answers it, some of them too late. Both are streams:
    a request is expired once the watermark shows that no answer can come in time; until then it has no row."""
    e = X.events(spark, sf_dir)
    ask = e.where(F.col("event_type") == "error").select(F.col("event_id").alias("request_id"), "ts")
    e = X.events(spark, sf_dir)
    later = e.select((F.col("event_id") - 1 - F.col("event_id") % 3).alias("request_id"), F.concat(F.lit("by "), "event_type").alias("decision"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES") * (F.col("event_id") % 8)).alias("ts"))
    return X.collected(X.answers(ask, later), "append").select("request_id", "decision", "expired")


def machine_lives(spark, sf_dir):
    """Every life of a user's machine, from a view to a purchase or to the end of its hour, which needs no further event."""
    m = O.lifetimes(X.events(spark, sf_dir), "user_id", "event_type", "event_id", "view", "purchase")
    return X.collected(m, "update", ["user_id", "created"]).select("user_id", F.round("created", 6).alias("created"), F.round("ended", 6).alias("ended"), "reason")


#: Of 100 numbers k, how many stand for each type of event.
TYPES = {"stage_update": 40, "vm_created": 15, "vm_terminated": 10, "hitl_required": 10, "hitl_resolved": 10, "environment_teardown": 4, "task_complete": 4, "task_failed": 3, "task_started": 4}
VIEW_STAGES = [*O.STAGES, "network"]


def view_events(events):
    """Events as what a monitor hears of a task, by the number k of each."""
    k, n = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    kind, below = F.lit(None).cast("string"), 100
    for name, share in reversed(TYPES.items()):
        kind = F.when(k < below, name).otherwise(kind)
        below -= share
    e = events.withColumn("type", kind)
    name = F.concat(F.when(F.col("type").startswith("vm"), "vm").otherwise("r"), (n % 6).cast("string"))
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    return e.select("user_id", "ts", "event_id", "type", pick(VIEW_STAGES, n % 9).alias("stage"), pick(["running", "complete", "error"], F.floor(n / 9) % 3).alias("status"), name.alias("id"), pick(["APPROVE", "REJECT", "APPROVE_WITH_CONSTRAINTS"], n % 3).alias("decision"), F.when(n % 4 > 0, pick(["declarative", "hybrid", "imperative"], F.floor(n / 4) % 3)).alias("method"), (n % 5 == 0).alias("escalated"))


def view_state(spark, sf_dir):
    """What a monitor shows of each user's task after its last event."""
    v = X.collected(O.views(view_events(X.events(spark, sf_dir)), "user_id", "event_id"), "update", ["user_id"])
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return v.select("user_id", "status", F.round("started", 6).alias("started"), "last_stage", "method", "decision", *[text(c).alias(c) for c in ("stages", "machines", "reviews")], "completed", "approved", "rejected", "escalated")


def health(spark, sf_dir):
    """What a health check shows of all views: tasks, open reviews, machines, decisions."""
    v = view_state(spark, sf_dir)
    count = lambda c, word: F.sum(F.regexp_count(c, F.lit(word)))
    return v.agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "complete").alias("complete"), count("reviews", "=pending").alias("pending"), count("machines", "=running").alias("machines"), *[F.sum(c).alias(c) for c in ("approved", "rejected", "escalated")])


def live_history(spark, sf_dir):
    """The newest twenty events of each user, kept by the stream itself."""
    r = X.collected(O.rings(X.events(spark, sf_dir), "user_id", "event_id", ["event_type"], 20), "update", ["user_id", "place"])
    return r.select("user_id", "event_id", "event_type", "place")


def late_events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    on, off = X.in_time(e, at, at + F.col("event_id") % 120 - 10, 60, 5)
    return on.agg(F.count("*").alias("n")).withColumn("kept", F.lit(True)).union(off.agg(F.count("*").alias("n")).withColumn("kept", F.lit(False)))


def machine_events(spark, sf_dir):
    """Rows that machines' lives give to a log."""
    from ..operators import records as C

    m = X.collected(machine_rows(spark, sf_dir), "update", ["key"])
    return C.machine_rows(m).select(F.col("key").alias("user_id"), "type", F.round("ts", 3).alias("ts"), "severity", "reason")


def terminated_machines(spark, sf_dir):
    """How many machines the end of task 3 terminates."""
    from ..operators import records as C

    m = machine_states(spark, sf_dir).withColumn("task_id", (F.col("user_id") % 5).cast("string"))
    return C.task_terminations(m, "3")


def running_machines(spark, sf_dir):
    """Lives that go on when the stream ends, with their age at a fixed time."""
    lives = machine_lives(spark, sf_dir).withColumn("state", F.when(F.col("ended").isNull(), "running").otherwise("terminated"))
    return X.running(lives, F.lit(2e9)).select("user_id", "created", "age")


QUERIES = {"machine_lives": machine_lives, "view_state": view_state, "health": health, "live_history": live_history, "machine_events": machine_events, "terminated_machines": terminated_machines, "running_machines": running_machines, "tumbling_counts": tumbling_counts, "session_activity": session_activity, "stage_latest": stage_latest, "latest_values": latest_values, "machine_states": machine_states, "machine_counts": machine_counts, "review_answers": review_answers, "late_events": late_events}
MACHINES = """WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) / 1e6::DOUBLE AS s FROM events), c AS (SELECT user_id, min(s) FILTER (event_type = 'view') AS v, min(s) FILTER (event_type = 'purchase') AS p FROM e GROUP BY 1),
x AS (SELECT c.user_id, CASE WHEN p IS NOT NULL AND (v IS NULL OR p < v) THEN NULL ELSE v END AS created, p FROM c),
y AS (SELECT x.user_id, created, min(p) AS p, min(s) FILTER (s - created > 7200) AS over FROM x JOIN e ON e.user_id = x.user_id GROUP BY ALL),
z AS (SELECT user_id, created, CASE WHEN created IS NULL THEN p WHEN p IS NOT NULL AND p - created <= 7200 THEN p WHEN over IS NOT NULL THEN created + 7200.0::DOUBLE END AS ended, CASE WHEN created IS NULL AND p IS NOT NULL THEN 'orphan' WHEN created IS NULL THEN NULL WHEN p IS NOT NULL AND p - created <= 7200 THEN 'requested' WHEN over IS NOT NULL THEN 'timeout' END AS reason FROM y),
ms AS (SELECT user_id, CASE WHEN ended IS NOT NULL THEN 'terminated' WHEN created IS NOT NULL THEN 'running' ELSE 'unknown' END AS state, reason, round(created, 3) AS created, round(ended, 3) AS ended FROM z)"""
#: What the watermark has passed when a stream over all events ends, in microseconds.
WATERMARK = "w AS (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS wm FROM events)"
_KIND = "CASE " + " ".join(f"WHEN k < {sum(list(TYPES.values())[: i + 1])} THEN '{name}'" for i, name in enumerate(TYPES)) + " END"
ORACLE_SQL = {
    "tumbling_counts": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_activity": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k",
    "stage_latest": "SELECT user_id, event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL",
    "latest_values": "SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, count(*) AS n FROM events GROUP BY ALL",
    "machine_events": MACHINES + " SELECT user_id, 'vm_created' AS type, round(created, 3) AS ts, 'info' AS severity, CAST(NULL AS VARCHAR) AS reason FROM ms WHERE created IS NOT NULL UNION ALL SELECT user_id, 'vm_terminated', round(ended, 3), 'info', reason FROM ms WHERE ended IS NOT NULL",
    "terminated_machines": MACHINES + " SELECT count(*) AS terminated FROM ms WHERE user_id % 5 = 3",
    "machine_states": MACHINES + " SELECT * FROM ms",
    "machine_counts": MACHINES + " SELECT count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'terminated') AS terminated, count(*) FILTER (reason = 'timeout') AS timed_out FROM ms",
    "review_answers": "WITH a AS (SELECT event_id, ts FROM events WHERE event_type = 'error'), b AS (SELECT event_id - 1 - event_id % 3 AS r, 'by ' || event_type AS decision, ts + INTERVAL 10 MINUTE * (event_id % 8) AS ts FROM events), w AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 10 MINUTE AS wm), j AS (SELECT event_id AS request_id, decision, a.ts AS asked, b.ts AS answered FROM a LEFT JOIN b ON r = event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR) SELECT request_id, decision, decision IS NULL AS expired FROM j, w WHERE decision IS NOT NULL OR asked + INTERVAL 1 HOUR < wm",
    "machine_lives": "WITH RECURSIVE " + WATERMARK + """, e AS (SELECT user_id, event_type, epoch_us(ts) AS tm FROM events, w WHERE epoch_us(ts) <= wm),
v AS (SELECT user_id, tm AS made FROM e WHERE event_type = 'view'),
p AS (SELECT v.user_id, made, min(tm) AS bought FROM v LEFT JOIN e ON e.user_id = v.user_id AND event_type = 'purchase' AND tm > made AND tm <= made + 3600000000 GROUP BY ALL),
j AS (SELECT user_id, made, coalesce(bought, CASE WHEN made + 3600000000 <= wm THEN made + 3600000000 END) AS ended, CASE WHEN bought IS NOT NULL THEN 'requested' WHEN made + 3600000000 <= wm THEN 'lifetime_exceeded' END AS reason FROM p, w),
n AS (SELECT j.user_id, j.made, min(v.made) AS next FROM j JOIN v ON v.user_id = j.user_id AND v.made > j.ended GROUP BY ALL),
l(user_id, made) AS (SELECT user_id, min(made) FROM v GROUP BY 1 UNION ALL SELECT l.user_id, next FROM l JOIN n ON n.user_id = l.user_id AND n.made = l.made)
SELECT user_id, round(made / 1e6::DOUBLE, 6) AS created, round(ended / 1e6::DOUBLE, 6) AS ended, reason FROM l JOIN j USING (user_id, made)""",
    "view_state": "WITH " + WATERMARK + f""", x0 AS (SELECT user_id, event_id, epoch_us(ts) AS tm, CAST(json_extract(props, '$.k') AS INT) AS k FROM events, w WHERE epoch_us(ts) <= wm),
x AS (SELECT *, {_KIND} AS type, ([{", ".join(f"'{v}'" for v in VIEW_STAGES)}])[event_id % 9 + 1] AS stage, (['running', 'complete', 'error'])[event_id // 9 % 3 + 1] AS status, event_id % 6 AS i, (['APPROVE', 'REJECT', 'APPROVE_WITH_CONSTRAINTS'])[event_id % 3 + 1] AS decision, CASE WHEN event_id % 4 > 0 THEN (['declarative', 'hybrid', 'imperative'])[event_id // 4 % 3 + 1] END AS method FROM x0),
t AS (SELECT user_id, coalesce(max(tm) FILTER (type = 'task_started'), 0) AS st, coalesce(max(tm) FILTER (type = 'task_complete'), 0) AS co, coalesce(max(tm) FILTER (type = 'task_failed' OR type = 'task_complete' AND decision = 'REJECT'), 0) AS er, coalesce(max(tm) FILTER (type = 'environment_teardown'), 0) AS td, min(tm) FILTER (type IN ('task_started', 'task_complete')) AS known,
  count(*) FILTER (type = 'task_complete') AS completed, count(*) FILTER (type = 'task_complete' AND decision = 'APPROVE') AS approved, count(*) FILTER (type = 'task_complete' AND decision = 'REJECT') AS rejected, count(*) FILTER (type = 'task_complete' AND event_id % 5 = 0) AS escalated FROM x GROUP BY 1),
s0 AS (SELECT user_id, s.stage, max(tm) AS tm, arg_max(status, tm) AS status FROM x JOIN (SELECT unnest([{", ".join(f"'{v}'" for v in O.STAGES)}]) AS stage) s ON s.stage = x.stage AND type = 'stage_update' GROUP BY ALL),
s1 AS (SELECT t.user_id, s.stage, CASE WHEN coalesce(s0.tm, 0) > greatest(st, er) THEN s0.status WHEN er > st THEN 'error' END AS status FROM t CROSS JOIN (SELECT unnest([{", ".join(f"'{v}'" for v in O.STAGES)}]) AS stage) s LEFT JOIN s0 ON s0.user_id = t.user_id AND s0.stage = s.stage),
s2 AS (SELECT user_id, string_agg(stage || '=' || status, ',' ORDER BY stage) AS stages FROM s1 WHERE status IS NOT NULL GROUP BY 1),
m0 AS (SELECT user_id, i, max(tm) FILTER (type = 'vm_created') AS c, coalesce(max(tm) FILTER (type = 'vm_terminated'), 0) AS d FROM x GROUP BY ALL),
m1 AS (SELECT m0.user_id, string_agg('vm' || i || CASE WHEN greatest(d, td) > c THEN '=terminated' ELSE '=running' END, ',' ORDER BY i) AS machines FROM m0 JOIN t USING (user_id) WHERE c IS NOT NULL GROUP BY 1),
r0 AS (SELECT user_id, i, max(tm) FILTER (type = 'hitl_required') AS c, coalesce(max(tm) FILTER (type = 'hitl_resolved'), 0) AS d FROM x GROUP BY ALL),
r1 AS (SELECT user_id, string_agg('r' || i || CASE WHEN d > c THEN '=resolved' ELSE '=pending' END, ',' ORDER BY i) AS reviews FROM r0 WHERE c IS NOT NULL GROUP BY 1),
o AS (SELECT x.user_id, arg_max(stage, tm) FILTER (type = 'stage_update' AND tm > st AND tm > known) AS last_stage, arg_max(coalesce(method, ''), tm) FILTER (tm > st AND (type = 'stage_update' AND stage = 'iac' AND status = 'complete' OR type = 'task_complete' AND method IS NOT NULL)) AS method, arg_max(decision, tm) FILTER (type = 'task_complete' AND tm > st) AS decision FROM x JOIN t USING (user_id) GROUP BY 1)
SELECT t.user_id, CASE WHEN st = 0 AND co = 0 THEN NULL WHEN st > co THEN 'running' ELSE 'complete' END AS status, CASE WHEN st > 0 THEN round(st / 1e6::DOUBLE, 6) END AS started, last_stage, method, decision, coalesce(stages, '') AS stages, coalesce(machines, '') AS machines, coalesce(reviews, '') AS reviews, completed, approved, rejected, escalated FROM t JOIN o USING (user_id) LEFT JOIN s2 USING (user_id) LEFT JOIN m1 USING (user_id) LEFT JOIN r1 USING (user_id)""",
    "live_history": "SELECT user_id, event_id, event_type, place FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 20",
    "late_events": "SELECT count(*) FILTER (k BETWEEN -5 AND 60) AS n, true AS kept FROM (SELECT event_id % 120 - 10 AS k FROM events) UNION ALL SELECT count(*) FILTER (k NOT BETWEEN -5 AND 60), false FROM (SELECT event_id % 120 - 10 AS k FROM events)",
}
ORACLE_SQL["running_machines"] = f"SELECT user_id, created, round(2000000000.0::DOUBLE - created, 1) AS age FROM ({ORACLE_SQL['machine_lives']}) WHERE ended IS NULL"
_COUNT = lambda c, word: f"sum((length({c}) - length(replace({c}, '{word}', ''))) // {len(word)})::BIGINT"
ORACLE_SQL["health"] = f"SELECT count(*) AS tasks, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'complete') AS complete, {_COUNT('reviews', '=pending')} AS pending, {_COUNT('machines', '=running')} AS machines, sum(approved)::BIGINT AS approved, sum(rejected)::BIGINT AS rejected, sum(escalated)::BIGINT AS escalated FROM ({ORACLE_SQL['view_state']})"
