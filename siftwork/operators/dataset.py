"""Training data from threat classes, its features, and metrics of predictions. All noise is hash-seeded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L

NOISE = 1 << 20


def unit(*of: Column) -> Column:
    """A number in [0, 1) that depends on its arguments only: the first digits of their SHA-256, so that any engine gives it."""
    digits = F.substring(F.sha2(F.concat_ws(":", *(x.cast("string") if isinstance(x, Column) else F.col(x).cast("string") for x in of)), 256), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(NOISE)) / F.lit(float(NOISE))


def normal(*of: Column) -> Column:
    """A standard normal number (Box-Muller) that depends on its arguments only."""
    u, v = unit(*of, F.lit(1)), unit(*of, F.lit(2))
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(6.283185307179586) * v)


def threats(spark: SparkSession) -> DataFrame:
    rows = [(i, k, r.split(), l.split(), risk, m) for i, (k, (r, l, risk, m)) in enumerate(L.THREATS.items())]
    return spark.createDataFrame(rows, "class_no int, threat_class string, required array<string>, likely array<string>, base_risk double, means array<double>")


def generate(spark: SparkSession, n: int, seed: int = 42, shortest: int = 20, longest: int = 200) -> DataFrame:
    """n samples, classes in turn: sample_id, threat_class, tokens, labels, risk_level."""
    return samples(spark.range(n).withColumnRenamed("id", "sample_id"), seed, shortest, longest)


def samples(rows: DataFrame, seed: int = 42, shortest: int = 20, longest: int = 200) -> DataFrame:
    """The sample of each row's number (column sample_id, not negative); equal numbers have equal samples."""
    d = rows.select(F.col("sample_id").cast("long").alias("sample_id")).withColumn("class_no", (F.col("sample_id") % len(L.THREATS)).cast("int"))
    d = d.join(F.broadcast(threats(rows.sparkSession)), "class_no")
    size = (F.lit(shortest) + unit(F.lit(seed), "sample_id") * (longest - shortest)).cast("int")
    vocabulary = F.array(*map(F.lit, L.TRAINING_VOCABULARY))
    pick = lambda a, *of: F.get(a, (unit(*of) * F.size(a)).cast("int"))
    noise = unit(F.lit(seed + 1), "sample_id") * 0.15

    def token(i):
        of = (F.lit(seed), F.col("sample_id"), i)
        likely = F.when(unit(*of, F.lit("likely")) < 0.7, pick(F.col("likely"), *of, F.lit("a"))).otherwise(pick(vocabulary, *of, F.lit("b")))
        # required tokens come at even steps through the sequence
        k = F.size("required")
        step = F.greatest((F.col("size") / F.greatest(k, F.lit(1))).cast("int"), F.lit(1))
        due = (k > 0) & (i % step == 0) & (i / step < k)
        return F.when(due, F.get("required", (i / step).cast("int"))).when(unit(*of, F.lit("noise")) < F.col("noise"), pick(vocabulary, *of, F.lit("c"))).otherwise(likely)

    d = d.withColumns({"size": size, "noise": noise})
    d = d.withColumn("tokens", F.concat(F.array(F.lit("MODULE")), F.transform(F.sequence(F.lit(0), F.col("size") - 1), token)))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    d = d.withColumns({"labels": F.transform("means", lambda m, i: clip(m + normal(F.lit(seed), F.col("sample_id"), i) * 0.05)), "risk_level": clip(F.col("base_risk") + normal(F.lit(seed), F.col("sample_id"), F.lit("risk")) * 0.05)})
    return d.select("sample_id", "threat_class", "tokens", "labels", "risk_level")


def token_risk(t: Column) -> Column:
    from ..functions.scalars import choose

    return choose(t, L.TOKEN_RISKS, 0.0)


def feature_vector(tokens: Column) -> Column:
    """45 numbers: the share of each training token, then structural ones."""
    n = F.greatest(F.size(tokens), F.lit(1))
    count = lambda k: F.size(F.filter(tokens, lambda t: t == k))
    risks = F.transform(tokens, token_risk)
    total = F.aggregate(risks, F.lit(0.0), lambda a, r: a + r)
    most = F.coalesce(F.array_max(risks), F.lit(0.0))
    high = F.size(F.filter(risks, lambda r: r >= 0.6))
    has = lambda k: (count(k) > 0).cast("double")
    rest = [n / F.lit(200.0), F.least(n / F.lit(50.0), F.lit(1.0)), F.lit(0.5), total / n, most, high / n, count("BRANCH") / n, count("IO") / n, count("NETWORK") / n, count("PRIVILEGE") / n + count("GLOBAL") / n, count("IMPORT") / n, has("DYNAMIC"), has("GLOBAL"), (count("IMPORT") + count("CALL")) / n, F.lit(0.5), most, has("PRIVILEGE")]
    return F.array(*[(count(k) / n).cast("double") for k in L.TRAINING_VOCABULARY], *[r.cast("double") for r in rest])


LABELS = 6


def predict(features: Column, weights: list[list[float]] | None, labels: int = LABELS) -> Column:
    """A score from 0 to 1 for each label: a logistic unit over the features. weights: for each label, the bias and then a weight a feature.

    Without a model the scores are 0."""
    if weights is None:
        return F.array(*[F.lit(0.0)] * labels)
    unit_of = lambda w: F.aggregate(F.zip_with(features, F.array(*map(F.lit, w[1:])), lambda x, k: x * k), F.lit(float(w[0])), lambda a, b: a + b)
    return F.array(*[F.lit(1.0) / (F.lit(1.0) + F.exp(-unit_of(w))) for w in weights])


def fit(samples: DataFrame, features: str, labels: str, ridge: float = 1e-2) -> list[list[float]]:
    """Weights for `predict`: ridge regression of the labels' log-odds on the features.

    Only sums of products reach the driver, a square of the number of features, whatever the number of samples."""

    def run(it):
        total = None
        for b in it:
            x = np.array(b.column(0).to_pylist(), float).reshape(b.num_rows, -1)
            y = np.clip(np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1), 0.02, 0.98)
            x = np.hstack([np.ones((len(x), 1)), x])
            part = x.T @ np.hstack([x, np.log(y / (1 - y))])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([total.shape[1]], pa.int32())], names=["sums", "width"])

    parts = samples.select(features, labels).where(F.size(features) > 0).mapInArrow(run, "sums array<double>, width int").collect()  # a row a partition
    if not parts:
        raise ValueError("no samples")
    total = sum(np.array(r.sums).reshape(-1, r.width) for r in parts)
    n = len(total)
    return np.linalg.solve(total[:, :n] + ridge * np.eye(n), total[:, n:]).T.tolist()


def shuffled(records: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed order that depends on the key and the seed only."""
    return records.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key)


def class_stats(samples: DataFrame, label: str, risk: str) -> DataFrame:
    return samples.groupBy(label).agg(F.count("*").alias("n"), F.avg(risk).alias("mean_risk"), F.stddev_pop(risk).alias("std_risk"), F.min(risk).alias("min_risk"), F.max(risk).alias("max_risk"))


def macro_f1(pairs: DataFrame, label: str, predicted: str, actual: str, threshold: float = 0.5) -> DataFrame:
    """The mean over labels of F1 with a smoothing of 1e-9. Rows: a label, a prediction and a truth each."""
    p, a = F.col(predicted) >= threshold, F.col(actual) >= threshold
    c = pairs.groupBy(label).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    e = F.lit(1e-9)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + e), F.col("tp") / (F.col("tp") + F.col("fn") + e)
    return c.select(label, (F.lit(2.0) * precision * recall / (precision + recall + e)).alias("f1")).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("labels"))


def error(pairs: DataFrame, predicted: str, actual: str) -> DataFrame:
    return pairs.agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("mae"), F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))
