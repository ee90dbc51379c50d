"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a domain-language-source tree hold documents. A token budget goes down the tree in
proportion to the weights of siblings; a child that cannot use its share (its tokens times the allowed
epochs) keeps what it can, and the shortage goes to its siblings by weight; only what no sibling can use
is left to the siblings of the parent. Each leaf then takes whole seeded epochs of its documents and, of the
next epoch, the documents whose running token total in that epoch's order stays within the budget.

Only one row a leaf reaches the driver. Running totals need no ordered pass over a leaf: documents are
placed by the digits of a hash; totals by digit find the digit at which the budget ends, and only the
documents of that digit are looked at again.

Defined cases: null domain, lang and source count as 'unknown'; null texts have no tokens and are taken
when their place in the order comes before the budget's end; empty tables give empty results; rows of equal doc_id stand in the
order at one place and are told apart by a hash of their text. Other columns are carried along untouched,
whatever their names; only columns called like the three added ones give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .storage import saved

LEVELS, ADDED = ("domain", "lang", "source"), ("mix_domain", "mix_tokens", "mix_epoch")
#: More leaves than this are refused, as a row for each goes to the driver.
MOST_LEAVES = 200_000
DIGIT = 12


def tokens(text: Column) -> Column:
    """Number of words, the token count used for budgets."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """A stand-in for the domain of a source: one of four groups by its hash."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source, F.lit("unknown")).cast("binary")), F.lit(4)).cast("string"))


def share_out(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Splits `budget` among (weight, capacity): by weight, shortages to the others by weight, in whole tokens."""
    got = [0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = min(budget, sum(children[i][1] for i in open_))
    while open_ and left > 0:
        weight = sum(children[i][0] for i in open_)
        share = {i: left * children[i][0] / weight for i in open_}
        full = [i for i in open_ if share[i] >= children[i][1] - got[i]]
        if not full:
            whole = {i: int(share[i]) for i in open_}
            rest = left - sum(whole.values())
            for i in sorted(open_, key=lambda i: (whole[i] - share[i], i))[:rest]:
                whole[i] += 1
            for i in open_:
                got[i] += whole[i]
            break
        for i in full:
            left -= children[i][1] - got[i]
            got[i] = children[i][1]
        open_ = [i for i in open_ if i not in full]
    return got


def budgets(leaves: dict[tuple, int], total: int, epochs: int, weights: dict[tuple, float] | None = None) -> dict[tuple, int]:
    """Tokens for each leaf path. weights: by path prefix; 1 for those not named."""
    weights = weights or {}
    capacity: dict[tuple, int] = {}
    for path, n in leaves.items():
        for k in range(len(path) + 1):
            capacity[path[:k]] = capacity.get(path[:k], 0) + n * epochs
    below: dict[tuple, list] = {}
    for path in sorted(capacity, key=lambda p: (len(p), p)):
        if path:
            below.setdefault(path[:-1], []).append(path)
    out: dict[tuple, int] = {}
    stack = [((), min(total, capacity.get((), 0)))]
    while stack:
        path, budget = stack.pop()
        children = below.get(path)
        if not children:
            out[path] = budget
            continue
        stack += zip(children, share_out(budget, [(weights.get(c, 1.0), capacity[c]) for c in children]))
    out.pop((), None)
    return out


def weights_of(targets: DataFrame) -> dict[tuple, float]:
    """Weights by path prefix from a table (domain, lang, source, weight); a null ends the prefix. Negative and null weights are refused."""
    rows = targets.select(*LEVELS, "weight").limit(2 * MOST_LEAVES + 1).collect()  # as many as there may be nodes
    if len(rows) > 2 * MOST_LEAVES:
        raise ValueError(f"more than {2 * MOST_LEAVES} weights")
    out: dict[tuple, float] = {}
    for *path, weight in rows:
        while path and path[-1] is None:
            path.pop()
        if None in path or weight is None or not weight >= 0:
            raise ValueError(f"no weight: {path}, {weight}")
        out[tuple(path)] = float(weight)
    return out


def mix(docs: DataFrame, share: float = 0.5, epochs: int = 2, weights: dict[tuple, float] | None = None, seed: int = 17, domain: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of `docs` taken, with domain, tokens and epoch (0, 1, ...) added as mix_domain, mix_tokens, mix_epoch.

    The budget is `share` of all tokens; a row comes once for each epoch that takes it. Only `columns` of `docs`
    are returned (default: all), and only they are written to the table from which the budgets are counted."""
    columns = [c for c in columns or docs.columns if c not in ADDED]
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    leaf = ["mix_domain", "mix_lang", "mix_source"]
    path = [known(domain if domain is not None else domain_of(F.col("source"))), known(F.col("lang")), known(F.col("source"))]
    # texts are counted once; what follows reads the counts only, and at the end the columns of the rows taken,
    # which travel in one struct so that their names meet no others
    row = F.struct(*columns) if columns else F.lit(True)
    keyed = saved(docs.select(row.alias("mix_row"), *(p.alias(k) for k, p in zip(leaf, path)), tokens(F.col("text")).alias("mix_tokens"), F.col("doc_id").alias("mix_id"), F.xxhash64("text").alias("mix_tie")))
    found = keyed.groupBy(*leaf).agg(F.sum("mix_tokens").alias("n")).limit(MOST_LEAVES + 1).collect()
    if len(found) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    leaves = {tuple(r[:3]): r[3] for r in found}
    given = budgets(leaves, int(share * sum(leaves.values())), epochs, weights)
    rows = [(*p, given[p] // n if n else 0, given[p] % n if n else 0) for p, n in leaves.items()]
    plan = F.broadcast(docs.sparkSession.createDataFrame(rows, "mix_domain string, mix_lang string, mix_source string, mix_whole long, mix_rest long"))  # at most MOST_LEAVES rows
    turned = keyed.join(plan, leaf)
    turned = turned.withColumn("mix_epoch", F.explode(F.expr("sequence(0L, mix_whole)")))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_epoch", "mix_id"), 4)  # 60 bits
    turned = turned.withColumn("mix_order", order)
    whole = turned.where("mix_epoch < mix_whole")
    part = turned.where("mix_epoch = mix_whole")
    out = [whole]
    for k in range(2):
        digit = F.shiftrightunsigned("mix_order", 60 - DIGIT * (k + 1)).bitwiseAND((1 << DIGIT) - 1)
        totals = part.groupBy(*leaf, "mix_rest", digit.alias("d")).agg(F.sum("mix_tokens").alias("n"))
        totals = totals.withColumn("upto", F.sum("n").over(Window.partitionBy(*leaf).orderBy("d")))
        # the digit at which the running total passes the budget, and the total before it
        ends = totals.where("upto > mix_rest").groupBy(*leaf).agg(F.min(F.struct("d", (F.col("upto") - F.col("n")).alias("before"))).alias("mix_end"))
        part = part.join(F.broadcast(ends), leaf, "left").withColumn("mix_d", digit)  # at most a row a leaf
        out.append(part.where("mix_end IS NULL OR mix_d < mix_end.d").drop("mix_end", "mix_d"))
        part = part.where("mix_d = mix_end.d").withColumn("mix_rest", F.col("mix_rest") - F.col("mix_end.before")).drop("mix_end", "mix_d")
    running = F.sum("mix_tokens").over(Window.partitionBy(*leaf).orderBy("mix_order", "mix_id", "mix_tie").rowsBetween(Window.unboundedPreceding, 0))
    out.append(part.withColumn("mix_upto", running).where("mix_upto <= mix_rest").drop("mix_upto"))
    result = out[0].select("mix_row", *ADDED)
    for o in out[1:]:
        result = result.union(o.select("mix_row", *ADDED))
    return result.select(*(F.col("mix_row").getField(c).alias(c) for c in columns), *ADDED)


#: Targets of the query: domains, and English against the other languages of each; a leaf not named weighs 1.
TARGETS = [(f"domain{i}", None, None, w) for i, w in enumerate((4.0, 3.0, 2.0, 1.0))] + [(f"domain{i}", "en", None, 2.0) for i in range(4)]


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = weights_of(spark.createDataFrame(TARGETS, "domain string, lang string, source string, weight double"))
    taken = mix(table(spark, sf_dir, "documents"), weights=targets, columns=["doc_id", "lang", "source"])
    return taken.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"))


QUERIES = {"op9_source_mixing": op9_source_mixing}
