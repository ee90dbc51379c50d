"""Queries over ordered records, histories, chains, splits, samples and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S
from ..operators import dataset as G
from ..operators import history as H
from ..sources import tables
from ..streaming import state as X
from . import stand_ins as T


def event_counts(spark, sf_dir):
    return H.most_common(T.table(spark, sf_dir, "events"), "event_type", "event_id")


def recent_events(spark, sf_dir):
    return H.tail(T.table(spark, sf_dir, "events"), "event_id", 200, F.col("event_type") != "click").select("event_id", "user_id", "event_type")


def bounded_history(spark, sf_dir):
    return H.bounded(T.table(spark, sf_dir, "events"), ["user_id"], "event_id", 20).select("user_id", "event_id", "place")


def ordered_distinct(spark, sf_dir):
    d = H.ordered_distinct(T.table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"], 3)
    return d.select("user_id", F.array_join("values", ",").alias("values"))


def set_operations(spark, sf_dir):
    """Types of part in two size ranges: difference, overlap, union."""
    p = T.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") < 4, F.col("p_type"))).alias("a"), F.collect_set(F.when(F.col("p_size") > 46, F.col("p_type"))).alias("b"))
    return p.select("p_brand", F.size(F.array_except("a", "b")).alias("only_a"), F.arrays_overlap("a", "b").alias("meet"), F.size(F.array_union("a", "b")).alias("either"))


def sorted_caps(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.slice(F.array_sort(F.collect_set(F.concat(F.lit("file_"), F.col("c_custkey").cast("string")))), 1, 20).alias("v"))
    return c.select("c_nationkey", F.array_join("v", ",").alias("files"))


def chain_rows(spark, sf_dir):
    """A chain over events whose hashes can be built without order: each covers the one before by its own fields."""
    e = T.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = F.sha2(F.concat_ws("|", "event_id", "event_type", "user_id"), 256)
    e = e.select("user_id", "event_id", own.alias("chain_hash")).withColumn("prev_hash", F.lag("chain_hash", 1, H.GENESIS).over(w))
    broken = F.col("event_id") % 997 == 3
    return e.withColumn("prev_hash", F.when(broken, F.lit("x")).otherwise(F.col("prev_hash")))


def audit_chain_verify(spark, sf_dir):
    rows = chain_rows(spark, sf_dir)
    return H.verify(rows, "event_id", F.col("chain_hash"), ["user_id"])


def last_hash(spark, sf_dir):
    return H.last_hash(chain_rows(spark, sf_dir), "event_id")


def written_chain(spark, sf_dir):
    """A log written as a chain a user, then verified with recomputed hashes."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    c = H.link(e, "user_id", "event_id", ["event_id", "event_type"])
    record = F.to_json(F.struct("event_id", "event_type", "prev_hash"))
    return H.verify(c, "event_id", S.canonical_hash(record), ["user_id"])


def whole_chain_rows(spark, sf_dir):
    """All events as one chain; each record's hash covers its own fields, so that it can be built without order."""
    e = T.table(spark, sf_dir, "events")
    own = F.sha2(F.concat_ws("|", "event_id", "event_type", "user_id"), 256)
    before = e.select((F.col("event_id") + 1).alias("event_id"), own.alias("prev_hash"))
    rows = e.join(before, "event_id", "left").select("event_id", F.coalesce("prev_hash", F.lit(H.GENESIS)).alias("prev_hash"), own.alias("chain_hash"), own.alias("again"))
    odd, cut = F.col("event_id") % 8191 == 4711, F.col("event_id") % 7919 == 7918
    return rows.withColumns({"prev_hash": F.when(odd, F.lit("x")).otherwise(F.col("prev_hash")), "again": F.when(cut, F.lit("y")).otherwise(F.col("again"))})


def whole_chain_verify(spark, sf_dir):
    """One chain over the whole table, verified by ranges: as it is, and without one of its records."""
    rows = whole_chain_rows(spark, sf_dir)
    every = H.verify(rows, "event_id", F.col("again")).withColumn("chain", F.lit("broken"))
    whole = H.verify(rows.where(F.col("event_id") % 8191 < 4711), "event_id", F.col("chain_hash")).withColumn("chain", F.lit("cut"))
    return every.unionByName(whole)


def appended_chain(spark, sf_dir):
    """Events written to a log in three batches, the last hash of each user's chain, and whether the chain is whole."""
    e = T.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    at = tables.new_folder(spark, "log")
    for part in range(3):  # in the order of time, as batches come
        H.append(e.where((F.col("event_id") >= part * 300) & (F.col("event_id") < (part + 1) * 300 if part < 2 else F.lit(True))), at, "user_id", "event_id", ["seq", "event_id", "event_type"])
    log = H.chained(spark, at)
    record = F.to_json(F.struct("event_id", "event_type", "prev_hash", "seq"))
    ok = H.verify(log, "seq", S.canonical_hash(record), ["user_id"])
    return ok.join(log.groupBy("user_id").agg(F.max_by("chain_hash", "seq").alias("last_hash")), "user_id")


def event_rows(spark, sf_dir):
    names = [*L.EVENTS, "UNKNOWN"]
    e = T.table(spark, sf_dir, "events")
    e = e.select("event_id", F.get(F.array(*map(F.lit, names)), (F.col("event_id") % len(names)).cast("int")).alias("event"), F.when(F.col("event_id") % 5 == 0, "success").when(F.col("event_id") % 13 == 0, "odd").alias("severity"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("ts"))
    return H.event_rows(e).select("event_id", "event", "severity", "stage", "valid", "ts_iso")


def log_reads(spark, sf_dir):
    """What a reader of the log asks for: the newest hundred records of one severity."""
    return H.tail(event_rows(spark, sf_dir), "event_id", 100, F.col("severity") == "error").select("event_id", "event", "stage", "ts_iso")


def alert_decisions(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    alerts = e.where(F.col("event_type") == "error").select(F.col("event_id").alias("alert_id"), F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("pending").alias("status"))
    words = F.when(F.col("user_id") % 2 == 1, "later").when(F.col("event_id") % 2 == 0, " approve ").when(F.col("event_id") % 5 == 0, "maybe").otherwise("REJECT")
    decisions = e.select(F.col("event_id").alias("alert_id"), words.alias("decision"), F.col("ts"))
    return X.resolve(alerts, decisions).select("alert_id", "status", "decision", "resolved")


def dataset_split(spark, sf_dir):
    d = H.split(T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return d.groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("position").alias("start"))


def class_distribution(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id")
    s = G.class_stats(d, "lang", "quality")
    return s.select("lang", "n", F.round("mean_risk", 9).alias("mean_quality"), F.round("std_risk", 9).alias("std_quality"), "min_risk", "max_risk")


def predictions(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels"), "doc_id")
    p = F.when(F.length("text") % 3 == 0, 1.0).when(F.length("text") % 3 == 1, 0.4).otherwise(0.75)
    return d.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("label"), p.alias("predicted"), F.col("quality").cast("double").alias("actual")), F.struct(F.lit("toxic").alias("label"), (F.lit(1.0) - p).alias("predicted"), F.col("toxic").cast("double").alias("actual")))).alias("x")).select("doc_id", "x.*")


def macro_f1(spark, sf_dir):
    return G.macro_f1(predictions(spark, sf_dir), "label", "predicted", "actual").select(F.round("macro_f1", 9).alias("macro_f1"), "labels")


def prediction_error(spark, sf_dir):
    return G.error(predictions(spark, sf_dir), "predicted", "actual").select(F.round("mae", 9).alias("mae"), F.round("accuracy", 9).alias("accuracy"))


def training_samples(spark, sf_dir):
    """The sample that belongs to each document's number."""
    g = G.samples(T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id")))
    first = F.get("tokens", F.lit(1))
    return g.select("sample_id", "threat_class", F.size("tokens").alias("length"), F.round("risk_level", 9).alias("risk_level"), F.size(G.feature_vector(F.col("tokens"))).alias("dimensions"), F.round(F.get("labels", F.lit(0)), 9).alias("label0"), F.when(F.array_contains(F.array(*map(F.lit, L.TRAINING_VOCABULARY)), first), F.get("tokens", F.lit(0))).alias("head"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


def training_features(spark, sf_dir):
    """The 45 numbers of users' event types read as tokens."""
    from . import node_queries as Q

    n = Q.classified(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("idx", "ir_type"))).alias("s"))
    v = n.select("user_id", G.feature_vector(F.transform("s", lambda x: x["ir_type"])).alias("v"))
    return v.select("user_id", F.posexplode("v").alias("dimension", "amount")).withColumn("amount", F.round("amount", 9))


#: A fixed model for the query: weights that grow with the feature's number and alternate in sign by label.
WEIGHTS = [[0.1 * k - 0.2] + [(-1) ** (i + k) * (i + 1) / 20.0 for i in range(45)] for k in range(G.LABELS)]


def linear_scores(spark, sf_dir):
    """Label scores of users' tokens by a fixed model, and by none."""
    from . import node_queries as Q

    n = Q.classified(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("idx", "ir_type"))).alias("s"))
    v = n.select("user_id", G.feature_vector(F.transform("s", lambda x: x["ir_type"])).alias("v"))
    p = v.select("user_id", G.predict(F.col("v"), WEIGHTS).alias("p"), G.predict(F.col("v"), None).alias("none"))
    return p.select("user_id", *[F.round(F.get("p", F.lit(k)), 9).alias(f"label{k}") for k in range(G.LABELS)], F.array_max("none").alias("without"))


def shuffled_sample(spark, sf_dir):
    return G.shuffled(T.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).limit(50)


def hierarchy_depth(spark, sf_dir):
    """Depth and size below each region of the region-nation-customer tree, by a recursive query."""
    for t in ("region", "nation", "customer"):
        T.table(spark, sf_dir, t).createOrReplaceTempView(f"hd_{t}")
    return spark.sql("""WITH RECURSIVE edges(parent, child) AS (SELECT concat('r', n_regionkey), concat('n', n_nationkey) FROM hd_nation UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey) FROM hd_customer),
      t(root, node, depth) AS (SELECT concat('r', r_regionkey), concat('r', r_regionkey), 0 FROM hd_region UNION ALL SELECT root, child, depth + 1 FROM t JOIN edges ON edges.parent = t.node)
      SELECT root, count(*) AS nodes, max(depth) AS deepest FROM t GROUP BY root""")


QUERIES = {
    "event_counts": event_counts, "recent_events": recent_events, "bounded_history": bounded_history, "ordered_distinct": ordered_distinct, "set_operations": set_operations, "sorted_caps": sorted_caps, "audit_chain_verify": audit_chain_verify, "last_hash": last_hash, "written_chain": written_chain, "whole_chain_verify": whole_chain_verify, "appended_chain": appended_chain, "event_rows": event_rows, "log_reads": log_reads, "alert_decisions": alert_decisions,
    "dataset_split": dataset_split, "class_distribution": class_distribution, "macro_f1": macro_f1, "prediction_error": prediction_error, "training_samples": training_samples, "training_features": training_features, "shuffled_sample": shuffled_sample, "linear_scores": linear_scores, "hierarchy_depth": hierarchy_depth,
}

CHAIN = f"WITH c0 AS (SELECT user_id, event_id, sha256(concat_ws('|', event_id, event_type, user_id)) AS chain_hash FROM events), c1 AS (SELECT *, lag(chain_hash, 1, '{H.GENESIS}') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM c0), c2 AS (SELECT *, CASE WHEN event_id % 997 = 3 THEN 'x' ELSE before END AS prev_hash FROM c1)"
EV = [*L.EVENTS, "UNKNOWN"]
PRED = "WITH d AS (SELECT *, CASE WHEN length(text) % 3 = 0 THEN 1.0::DOUBLE WHEN length(text) % 3 = 1 THEN 0.4::DOUBLE ELSE 0.75::DOUBLE END AS p FROM documents JOIN labels USING (doc_id)), pr AS (SELECT 'quality' AS label, p AS predicted, quality::DOUBLE AS actual FROM d UNION ALL SELECT 'toxic', 1.0::DOUBLE - p, toxic::DOUBLE FROM d)"
TOKENS = L.TRAINING_VOCABULARY
_N = "greatest(len(tk), 1)"
_CNT = lambda k: f"len(list_filter(tk, lambda x: x = '{k}'))"
_RISK = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in L.TOKEN_RISKS.items()) + " ELSE 0.0::DOUBLE END"
_RS = f"list_transform(tk, lambda x: {_RISK})"
_D45 = [f"{_CNT(k)} / {_N}::DOUBLE" for k in TOKENS] + [f"{_N} / 200.0::DOUBLE", f"least({_N} / 50.0::DOUBLE, 1.0::DOUBLE)", "0.5::DOUBLE", f"list_sum({_RS}) / {_N}", f"coalesce(list_max({_RS}), 0.0::DOUBLE)", f"len(list_filter({_RS}, lambda r: r >= 0.6::DOUBLE)) / {_N}::DOUBLE"] + [f"{_CNT(k)} / {_N}::DOUBLE" for k in ("BRANCH", "IO", "NETWORK")] + [f"{_CNT('PRIVILEGE')} / {_N}::DOUBLE + {_CNT('GLOBAL')} / {_N}::DOUBLE", f"{_CNT('IMPORT')} / {_N}::DOUBLE", f"({_CNT('DYNAMIC')} > 0)::INT::DOUBLE", f"({_CNT('GLOBAL')} > 0)::INT::DOUBLE", f"({_CNT('IMPORT')} + {_CNT('CALL')}) / {_N}::DOUBLE", "0.5::DOUBLE", f"coalesce(list_max({_RS}), 0.0::DOUBLE)", f"({_CNT('PRIVILEGE')} > 0)::INT::DOUBLE"]
_UNIT = lambda x: f"((('0x' || substr(sha256({x}), 1, 8))::BIGINT % {G.NOISE}) / {G.NOISE}.0::DOUBLE)"
_NORMAL = lambda x: f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_UNIT(x + " || ':1'")})) * cos(6.283185307179586::DOUBLE * {_UNIT(x + " || ':2'")}))"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words.split()) + "]::VARCHAR[]"
_THREATS = ", ".join(f"({i}, '{k}', {_LIST(v[0])}, {_LIST(v[1])}, {v[2]}::DOUBLE, {v[3][0]}::DOUBLE)" for i, (k, v) in enumerate(L.THREATS.items()))
_PICK = lambda a, x: f"{a}[CAST(floor({_UNIT(x)} * len({a})) AS INT) + 1]"
_CLIP = lambda x: f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})), 9)"
ORACLE_SQL = {
    "training_samples": f"""WITH c(class_no, threat_class, required, likely, base, mean) AS (VALUES {_THREATS}), s AS (SELECT doc_id AS sample_id FROM documents), v AS (SELECT [{", ".join(f"'{t}'" for t in TOKENS)}] AS vocabulary),
z AS (SELECT *, CAST(floor(20 + {_UNIT("'42:' || sample_id")} * 180) AS INT) AS size, {_UNIT("'43:' || sample_id")} * 0.15::DOUBLE AS noise, '42:' || sample_id || ':' AS p FROM s JOIN c ON c.class_no = sample_id % {len(L.THREATS)}, v),
y AS (SELECT *, len(required) AS k, greatest(size // greatest(len(required), 1), 1) AS step FROM z),
t AS (SELECT *, list_prepend('MODULE', list_transform(range(0, size), lambda i: CASE WHEN k > 0 AND i % step = 0 AND i // step < k THEN required[i // step + 1] WHEN {_UNIT("p || i || ':noise'")} < noise THEN {_PICK("vocabulary", "p || i || ':c'")}
  WHEN {_UNIT("p || i || ':likely'")} < 0.7::DOUBLE THEN {_PICK("likely", "p || i || ':a'")} ELSE {_PICK("vocabulary", "p || i || ':b'")} END)) AS tokens FROM y)
SELECT sample_id, threat_class, 1 + size AS length, {_CLIP("base + " + _NORMAL("'42:' || sample_id || ':risk'") + " * 0.05::DOUBLE")} AS risk_level, 45 AS dimensions, {_CLIP("mean + " + _NORMAL("'42:' || sample_id || ':0'") + " * 0.05::DOUBLE")} AS label0, 'MODULE' AS head, md5(array_to_string(tokens, ' ')) AS digest FROM t""",
    "training_features": "WITH " + T.NODES_SQL + ", tk AS (SELECT user_id, list(ir_type ORDER BY idx) AS tk FROM n1 GROUP BY 1), v AS (SELECT user_id, [" + ", ".join(_D45) + "] AS v FROM tk) SELECT user_id, i AS dimension, round(v[i + 1], 9) AS amount FROM v, range(45) r(i)",
    "linear_scores": "WITH " + T.NODES_SQL + ", tk AS (SELECT user_id, list(ir_type ORDER BY idx) AS tk FROM n1 GROUP BY 1), v AS (SELECT user_id, [" + ", ".join(_D45) + "] AS v FROM tk) SELECT user_id, " + ", ".join(f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({w[0]!r}::DOUBLE + list_sum(list_transform(range(1, 46), lambda i: v[i] * ([{', '.join(f'{x!r}::DOUBLE' for x in w[1:])}])[i]))))), 9) AS label{k}" for k, w in enumerate(WEIGHTS)) + ", 0.0::DOUBLE AS without FROM v",
    "shuffled_sample": "SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 50",
    "event_counts": "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1)",
    "recent_events": "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'click' ORDER BY event_id DESC LIMIT 200",
    "bounded_history": "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 20",
    "ordered_distinct": "WITH f AS (SELECT user_id, event_type, min(struct_pack(t := ts, e := event_id)) AS o FROM events GROUP BY ALL) SELECT user_id, array_to_string(list(event_type ORDER BY o)[1:3], ',') AS values FROM f GROUP BY user_id",
    "set_operations": "WITH p AS (SELECT p_brand, coalesce(list(DISTINCT p_type) FILTER (p_size < 4), []) AS a, coalesce(list(DISTINCT p_type) FILTER (p_size > 46), []) AS b FROM part GROUP BY 1) SELECT p_brand, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, list_has_any(a, b) AS meet, len(list_distinct(list_concat(a, b))) AS either FROM p",
    "sorted_caps": "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT 'file_' || c_custkey))[1:20], ',') AS files FROM customer GROUP BY 1",
    "audit_chain_verify": CHAIN + " SELECT user_id, min(event_id) FILTER (before <> prev_hash) IS NULL AS ok, min(event_id) FILTER (before <> prev_hash) AS first_broken, count(*) AS total FROM c2 GROUP BY 1",
    "last_hash": CHAIN + " SELECT arg_max(chain_hash, event_id) AS last_hash FROM c2",
    "written_chain": "SELECT user_id, true AS ok, CAST(NULL AS BIGINT) AS first_broken, count(*) AS total FROM events GROUP BY 1",
    "whole_chain_verify": f"WITH c0 AS (SELECT event_id, sha256(concat_ws('|', event_id, event_type, user_id)) AS own FROM events), c1 AS (SELECT *, CASE WHEN event_id % 8191 = 4711 THEN 'x' ELSE lag(own, 1, '{H.GENESIS}') OVER (ORDER BY event_id) END AS prev FROM c0), b AS (SELECT event_id, lag(own, 1, '{H.GENESIS}') OVER (ORDER BY event_id) <> prev OR event_id % 7919 = 7918 AS bad FROM c1), d AS (SELECT event_id, lag(own, 1, '{H.GENESIS}') OVER (ORDER BY event_id) <> prev AS bad FROM c1 WHERE event_id % 8191 < 4711) SELECT 'broken' AS chain, min(event_id) FILTER (bad) IS NULL AS ok, min(event_id) FILTER (bad) AS first_broken, count(*) AS total FROM b UNION ALL SELECT 'cut', min(event_id) FILTER (bad) IS NULL, min(event_id) FILTER (bad), count(*) FROM d",
    "appended_chain": f"WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events), c(user_id, seq, h) AS (SELECT user_id, seq, sha256('{{\"event_id\": ' || event_id || ', \"event_type\": \"' || event_type || '\", \"prev_hash\": \"{H.GENESIS}\", \"seq\": 0}}') FROM e WHERE seq = 0 UNION ALL SELECT e.user_id, e.seq, sha256('{{\"event_id\": ' || event_id || ', \"event_type\": \"' || event_type || '\", \"prev_hash\": \"' || h || '\", \"seq\": ' || e.seq || '}}') FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1) SELECT user_id, true AS ok, CAST(NULL AS BIGINT) AS first_broken, count(*) AS total, arg_max(h, seq) AS last_hash FROM c GROUP BY 1",
    "event_rows": "WITH e AS (SELECT event_id, ts, ([" + ", ".join(f"'{k}'" for k in EV) + f"])[event_id % {len(EV)} + 1] AS event FROM events), s AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'info' WHEN event_id % 13 = 0 THEN 'odd' ELSE coalesce(CASE event " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in L.EVENTS.items() if v[0]) + " END, 'info') END AS severity, CASE event " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in L.EVENTS.items() if v[1]) + " END AS stage FROM e) SELECT event_id, event, severity, stage, severity IN (" + ", ".join(f"'{s}'" for s in L.SEVERITIES) + ") AS valid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_iso FROM s",
    "alert_decisions": "WITH a AS (SELECT event_id AS alert_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'pending' END AS status, CASE WHEN user_id % 2 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'APPROVE' WHEN event_id % 5 = 0 THEN NULL ELSE 'REJECT' END END AS decision FROM events WHERE event_type = 'error') SELECT alert_id, CASE WHEN status = 'pending' AND decision IS NOT NULL THEN 'resolved' ELSE status END AS status, decision, status = 'pending' AND decision IS NOT NULL AS resolved FROM a",
    "dataset_split": "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents), s AS (SELECT *, CASE WHEN position < CAST(floor(n * 0.8::DOUBLE) AS INT) THEN 'train' WHEN position < CAST(floor(n * 0.8::DOUBLE) AS INT) + CAST(floor(n * 0.1::DOUBLE) AS INT) THEN 'validation' ELSE 'test' END AS split FROM p) SELECT split, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, min(position) AS start FROM s GROUP BY 1",
    "class_distribution": "SELECT lang, count(*) AS n, round(avg(quality), 9) AS mean_quality, round(stddev_pop(quality), 9) AS std_quality, min(quality) AS min_risk, max(quality) AS max_risk FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "macro_f1": PRED + ", c AS (SELECT label, count(*) FILTER (predicted >= 0.5 AND actual >= 0.5) AS tp, count(*) FILTER (predicted >= 0.5 AND actual < 0.5) AS fp, count(*) FILTER (predicted < 0.5 AND actual >= 0.5) AS fn FROM pr GROUP BY 1), q AS (SELECT label, tp / (tp + fp + 1e-9::DOUBLE) AS p, tp / (tp + fn + 1e-9::DOUBLE) AS r FROM c) SELECT round(avg(2.0::DOUBLE * p * r / (p + r + 1e-9::DOUBLE)), 9) AS macro_f1, count(*) AS labels FROM q",
    "prediction_error": PRED + " SELECT round(avg(abs(predicted - actual)), 9) AS mae, round(avg(CASE WHEN predicted = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM pr",
    "hierarchy_depth": "WITH RECURSIVE edges(parent, child) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), t(root, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT root, child, depth + 1 FROM t JOIN edges ON edges.parent = t.node) SELECT root, count(*) AS nodes, max(depth) AS deepest FROM t GROUP BY root",
}
ORACLE_SQL["log_reads"] = f"SELECT event_id, event, stage, ts_iso FROM ({ORACLE_SQL['event_rows']}) WHERE severity = 'error' ORDER BY event_id DESC LIMIT 100"
