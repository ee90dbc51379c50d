"""Checks of a plan against what was expected, their first failure, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import scalars as S


def normal(resource: Column) -> Column:
    return F.trim(F.lower(F.replace(resource, F.lit("azurerm_"), F.lit(""))))


def missing(expected: DataFrame, planned: DataFrame, keys: list[str]) -> DataFrame:
    """Expected resources (keys, resource) that are not planned, normalised, each once."""
    e = expected.select(*keys, normal(F.col("resource")).alias("resource")).distinct()
    p = planned.select(*keys, normal(F.col("resource")).alias("resource")).distinct()
    return e.join(p, [*keys, "resource"], "left_anti")


def hint_coverage(hints: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, hints, addressed, covered (share of hints; unknown hints count) and passed (at least half)."""
    low = F.lower(text)
    hit = F.lit(True)
    for name, words in L.HINTS.items():
        any_of = F.lit(False)
        for w in words.split():
            any_of = any_of | low.contains(w)
        hit = F.when(F.col("hint") == name, F.coalesce(any_of, F.lit(False))).otherwise(hit)
    return hints.withColumn("hit", hit).groupBy(*keys).agg(F.count("*").alias("hints"), F.count_if("hit").alias("addressed")).withColumn("covered", F.col("addressed") / F.col("hints")).withColumn("passed", F.col("covered") >= 0.5)


def first_failure(checks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, passed, and ord, name and category of the first failed check."""
    failed = F.when(~F.col("passed"), F.struct("ord", "name", F.col("error_category").alias("category"), F.col("detail").alias("detail")))
    return checks.groupBy(*keys).agg(F.min(failed).alias("f")).select(*keys, F.col("f").isNull().alias("passed"), "f.ord", "f.name", "f.category", "f.detail")


MOST_ATTEMPTS, MOST_RESTARTS = 3, 1


def retries(checks: DataFrame, keys: list[str], attempt: str = "attempt", most: int = MOST_ATTEMPTS, restarts: int = MOST_RESTARTS) -> DataFrame:
    """One row a task (`keys`) with the end of its retry loop, from the checks of its attempts in order.

    state: passed; aborted, after `most` attempts; open, if no attempt follows one that failed. attempts: how many ran; what comes
    after a pass or the last allowed one does not count. restarts: how often the category of the failure before sent an attempt
    back to the strategy, at most `restarts` times; ran: what each attempt ran. category and feedback are those of
    the last failure, category null once passed. Of a task's attempts the first `most` are folded, and no others are gathered."""
    outcome = first_failure(checks, [*keys, attempt])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(attempt))
    few = outcome.withColumn("place", place).where(F.col("place") <= most)
    rows = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "passed", "category", retry_hint(F.col("category"), F.col("detail")).alias("hint")))).alias("s"))
    text = lambda v: F.lit(v).cast("string")
    start = F.struct(text("open").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("restarts"), text("").alias("ran"), text(None).alias("category"), text(None).alias("feedback"))

    def step(acc: Column, x: Column) -> Column:
        again = (acc["attempts"] > 0) & (restart(acc["category"]) == "strategy") & (acc["restarts"] < restarts)
        again = F.coalesce(again, F.lit(False))
        ran = F.when((acc["attempts"] == 0) | again, F.lit("strategy>iac>validate")).otherwise(F.lit("iac>validate"))
        after = F.struct(
            F.when(x["passed"], text("passed")).when(acc["attempts"] + 1 >= most, text("aborted")).otherwise(text("open")).alias("state"), (acc["attempts"] + 1).alias("attempts"), (acc["restarts"] + again.cast("int")).alias("restarts"),
            F.concat(acc["ran"], F.when(acc["attempts"] == 0, F.lit("")).otherwise(F.lit(" ")), ran).alias("ran"), F.when(x["passed"], text(None)).otherwise(x["category"]).alias("category"), F.when(x["passed"], acc["feedback"]).otherwise(x["hint"]).alias("feedback"),
        )
        return F.when(acc["state"] == "open", after).otherwise(acc)

    return rows.withColumn("r", F.aggregate("s", start, step)).select(*keys, "r.*")


def retry_rows(ended: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attempt, ran, outcome: a row for each attempt that `retries` counts; outcome is passed, retry or aborted, open for the last one of an open loop."""
    steps = ended.select(*keys, "state", "attempts", F.posexplode(F.split("ran", " ")).alias("at", "ran"))
    return steps.select(*keys, (F.col("at") + 1).alias("attempt"), "ran", F.when(F.col("at") + 1 < F.col("attempts"), "retry").otherwise(F.col("state")).alias("outcome"))


def restart(category: Column) -> Column:
    return S.choose(category, L.RESTART)


def retry_hint(category: Column, detail: Column) -> Column:
    return F.concat(S.choose(category, L.RETRY_HINTS, "Review the files and generate them again."), F.lit(" "), F.substring(F.coalesce(detail, F.lit("")), 1, 300))


PLAN = "type string, level string, summary string, detail string, change struct<resource:struct<resource_type:string>>, hook struct<resource:struct<resource_type:string>>, diagnostic struct<summary:string,detail:string>"


def plan_messages(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines as columns; malformed and blank ones go."""
    out = lines.withColumn("m", F.from_json(line, PLAN, {"mode": "PERMISSIVE"}))
    return out.where(F.try_parse_json(line).isNotNull() & F.col("m").isNotNull())


def resources(messages: DataFrame, keys: list[str], order: str, kind: str = "planned_change") -> DataFrame:
    """keys, resource, first: resource types of a kind of message in the order of their first appearance."""
    path = "m.change.resource.resource_type" if kind == "planned_change" else "m.hook.resource.resource_type"
    return messages.where((F.col("m.type") == kind) & (F.col(path) != "")).groupBy(*keys, F.col(path).alias("resource")).agg(F.min(order).alias("first"))


def plan_errors(messages: DataFrame, keys: list[str], order: str, most: int = 10) -> DataFrame:
    """keys, errors: the first `most` diagnostics, a line each."""
    of = lambda k: F.coalesce(F.col(f"m.diagnostic.{k}"), F.when(F.col("m.diagnostic").isNull(), F.col(f"m.{k}")), F.lit(""))
    bad = messages.where(((F.col("m.level") == "error") | (F.col("m.type") == "diagnostic")) & (of("summary") != ""))
    text = F.concat(F.lit("• "), of("summary"), F.when(of("detail") != "", F.concat(F.lit(": "), of("detail"))).otherwise(F.lit("")))
    few = bad.select(*keys, F.col(order).alias("o"), text.alias("t")).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("o", "t"))).where(F.col("_rank") <= most)
    got = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", "t"))).alias("s"))
    return got.select(*keys, F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("errors"))


def declared(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, resource, first: types declared by lines that begin with resource "azurerm_..., in order."""
    t = F.trim("line")
    got = lines.where(t.startswith('resource "azurerm_')).withColumn("resource", F.get(F.split(t, '"'), F.lit(1)))
    return got.groupBy(*keys, "resource").agg(F.min(F.struct(*order)).alias("first"))
