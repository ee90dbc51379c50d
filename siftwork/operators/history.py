"""Ordered records: hash chains that go on, verification, tails, bounded histories, ordered distinct values, splits."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import lookups as L
from ..sources import tables

GENESIS = hashlib.sha256(b"").hexdigest()


def link(records: DataFrame, key: str, order: str, fields: list[str], after: DataFrame | None = None, number: str | None = None) -> DataFrame:
    """Adds prev_hash and chain_hash: each record's hash covers the one before it in its chain.

    Building a chain is sequential, so each value of `key` is one chain, written by one task in `order`;
    records are streamed through, not gathered. `after` (key, chain_hash, and with `number` that too) has the last record
    of chains that exist and go on; others begin at GENESIS. `number` names a column that counts a chain's records from 0."""
    ready, last_columns = records, ["_hash"] + (["_number"] if number else [])
    if after is None:
        ready = ready.withColumns({"_hash": F.lit(None).cast("string"), **({"_number": F.lit(None).cast("long")} if number else {})})
    else:
        heads = after.select(F.col(key).alias("_key"), F.col("chain_hash").alias("_hash"), *([F.col(number).cast("long").alias("_number")] if number else []))
        ready = ready.join(heads, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    ready = ready.repartition(key).sortWithinPartitions(key, order)
    schema = StructType(list(records.schema))  # add() changes what it is called on
    if number:
        schema = schema.add(number, "long")
    schema = schema.add("prev_hash", "string").add("chain_hash", "string")
    extra = [*([pa.field(number, pa.int64())] if number else []), pa.field("prev_hash", pa.string()), pa.field("chain_hash", pa.string())]

    def run(it):
        chain, before, n = object(), GENESIS, 0
        for b in it:
            rows = b.to_pylist()
            for r in rows:
                head, at = r.pop("_hash"), r.pop("_number", None)
                if r[key] != chain:  # rows of a chain are adjacent
                    chain, before, n = r[key], head or GENESIS, 0 if at is None else at + 1
                if number:
                    r[number] = n
                r["prev_hash"] = before
                body = {k: r[k] for k in (*fields, "prev_hash")}
                r["chain_hash"] = before = hashlib.sha256(json.dumps(body, sort_keys=True, default=str).encode()).hexdigest()
                n += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*(f for f in b.schema if f.name not in last_columns), *extra]))

    return ready.mapInArrow(run, schema)


def append(records: DataFrame, path: str, key: str, order: str, fields: list[str], batch: int | None = None) -> int:
    """Appends records to the chained log in `path`, whose chains go on where they ended; returns the batch's number.

    A batch is a folder of the log, with a table of each chain's last record beside it, so that nothing reads the whole log
    again. A batch that is written once more, after a failure, replaces itself with the same records: writing is
    repeatable, and one that was broken off leaves no trace. A batch that others follow already is refused."""
    spark = records.sparkSession
    known = tables.numbered(spark, f"{path}/heads", "b")
    batch = batch if batch is not None else (known[-1] + 1 if known else 0)
    if known and known[-1] > batch:
        raise ValueError(f"the log has batch {known[-1]} already: batch {batch} is not its next one")
    earlier = [n for n in known if n < batch]
    heads = spark.read.parquet(f"{path}/heads/b{earlier[-1]}") if earlier else None
    link(records, key, order, fields, heads, "seq").write.mode("overwrite").parquet(f"{path}/log/b{batch}")
    last = spark.read.parquet(f"{path}/log/b{batch}").groupBy(key).agg(F.max("seq").alias("seq"), F.max_by("chain_hash", "seq").alias("chain_hash"))
    if heads is not None:
        rest = heads.join(last.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        last = last.unionByName(rest)
    last.write.mode("overwrite").parquet(f"{path}/heads/b{batch}")
    return batch


def appended(stream: DataFrame, path: str, key: str, order: str, fields: list[str]):
    """A writer that appends each micro-batch to the log in `path`; log and checkpoint belong together, and a restart goes on."""
    return stream.writeStream.foreachBatch(lambda rows, number: append(rows, path, key, order, fields, number) and None)


def chained(spark: SparkSession, path: str) -> DataFrame:
    """The complete batches of a log written by `append`."""
    done = tables.numbered(spark, f"{path}/heads", "b")
    return spark.read.parquet(*[f"{path}/log/b{n}" for n in done])


def verify(records: DataFrame, order: str, recomputed: Column, keys: list[str] | None = None) -> DataFrame:
    """ok, first_broken, total: links compared with the stored hash before each record, hashes with `recomputed`.

    With `keys` each value is a chain, held against itself in one task; without, all records are one, verified by ranges."""
    if not keys:
        return verify_ranges(records, order, recomputed)
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag("chain_hash", 1, GENESIS).over(w)
    bad = records.withColumn("before", before).withColumn("bad", ~F.col("before").eqNullSafe(F.col("prev_hash")) | ~recomputed.eqNullSafe(F.col("chain_hash")))
    out = bad.groupBy(*keys).agg(F.min(F.when(F.col("bad"), F.col(order))).alias("first_broken"), F.count("*").alias("total"))
    return out.select(*keys, F.col("first_broken").isNull().alias("ok"), "first_broken", "total")


def verify_ranges(records: DataFrame, order: str, recomputed: Column) -> DataFrame:
    """The same for one chain of any length.

    Records are dealt to ranges of `order`; each task streams its range, holds every link but the first against the record before, and
    gives one row: where it begins, which hash it needs before that, which it ends with, what is broken first. The rows, one a
    range, are then put in order, and each boundary is held against the end of the range before."""
    kind = dict(records.dtypes)[order]
    ready = records.select(F.col(order).alias("o"), "prev_hash", "chain_hash", recomputed.alias("again")).repartitionByRange("o").sortWithinPartitions("o")

    def run(it):
        first, needs, before, broken, total = None, None, None, None, 0
        for b in it:
            o, prev, own, again = (b.column(k).to_pylist() for k in range(4))
            for at, p, h, a in zip(o, prev, own, again):
                if not total:
                    first, needs = at, p
                if broken is None and (a != h or total and p != before):
                    broken = at
                before = h
                total += 1
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip((first, needs, before, broken, total), (b.schema.field(0).type, pa.string(), pa.string(), b.schema.field(0).type, pa.int64()))], names=["first", "needs", "ends", "broken", "n"])

    ranges = ready.mapInArrow(run, f"first {kind}, needs string, ends string, broken {kind}, n long")
    met = ranges.withColumn("met", F.lag("ends", 1, GENESIS).over(Window.orderBy("first")).eqNullSafe(F.col("needs")))  # a row a range
    out = met.agg(F.min(F.least(F.when(~F.col("met"), F.col("first")), F.col("broken"))).alias("first_broken"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"))
    return out.select(F.col("first_broken").isNull().alias("ok"), "first_broken", "total")


def last_hash(records: DataFrame, order: str) -> DataFrame:
    return records.agg(F.coalesce(F.max_by("chain_hash", order), F.lit(GENESIS)).alias("last_hash"))


def tail(records: DataFrame, order: str, n: int, where: Column | None = None) -> DataFrame:
    """The last n records, newest first."""
    return (records if where is None else records.where(where)).orderBy(F.desc(order)).limit(n)


def bounded(records: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n records of each key, with their place (1 is the newest)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return records.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def most_common(records: DataFrame, value: str, order: str) -> DataFrame:
    """value, n, place: by count, ties by first appearance."""
    got = records.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return got.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")  # a row a distinct value


def ordered_distinct(records: DataFrame, keys: list[str], value: str, order: list[str], most: int = 20) -> DataFrame:
    """keys, values: each value once, in the order of first appearance, at most `most`; no more than that are gathered."""
    first = records.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("o"))
    few = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("o", value))).where(F.col("_rank") <= most)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", value))).alias("s")).select(*keys, F.transform("s", lambda x: x[value]).alias("values"))


def placed(records: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Adds each record's place (0, 1, ...) in the order of a column, nulls first; a written table.

    Records are sorted by range, whose edges Spark takes from a sample, so that skewed values make no large range; the number within the
    range and the counts of the ranges before, a row each, give the place. Equal values follow each other in any order."""
    ranged = records.repartitionByRange(order).sortWithinPartitions(order)
    rows = tables.written(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # as many rows as shuffle partitions
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.col("_row") - F.shiftleft(part, 33)
    return rows.join(F.broadcast(starts), part == F.col("_part")).withColumn(name, own + F.col("_start")).drop("_row", "_part", "_start")


def split(records: DataFrame, order: str, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """Adds position and split by position in `order`."""
    out = placed(records, order)
    n = records.count()
    a, b = int(n * train), int(n * train) + int(n * validation)
    return out.withColumn("split", F.when(F.col("position") < a, "train").when(F.col("position") < b, "validation").otherwise("test"))


def event_rows(events: DataFrame) -> DataFrame:
    """Severity and stage of each event by its constructor; a success counts as info; unknown severities are marked invalid."""
    from ..functions import scalars as S

    sev = S.choose(F.col("event"), {k: v[0] for k, v in L.EVENTS.items() if v[0]})
    stage = S.choose(F.col("event"), {k: v[1] for k, v in L.EVENTS.items() if v[1]})
    given = F.col("severity") if "severity" in events.columns else F.lit(None).cast("string")
    s = F.coalesce(F.when(given == "success", F.lit("info")).otherwise(given), sev, F.lit("info"))
    return events.withColumns({"severity": s, "stage": stage, "valid": s.isin(*L.SEVERITIES), "ts_iso": S.iso_time(F.col("ts"))})
