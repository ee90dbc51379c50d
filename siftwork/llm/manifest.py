"""Merkle manifest of a dataset: a leaf for each row, a tree for each group of leaves, a tree over the groups' roots.

1. Leaves are hashes of a row's fields. Places within a group come from one sort by range and a count of
   each range, so that no group, however large, is numbered by one task.
2. Build, bottom up. A level's nodes meet their STRIDE neighbours below one ancestor, LEVELS levels up; the levels
   between are made there by array functions and written with the nodes as one table. The ancestors are the next
   table's nodes, until one node is left. A level that has one node of a run alone hashes that one.
3. Proofs, top down. Each written table is joined to the one above: a child prepends its siblings at the levels
   between to the suffix that its ancestor inherited. The last join gives the leaves theirs; leaves
   travel only inside their nodes.

Everything runs in the JVM, and every join and grouping is by a node's place, STRIDE rows to a group.

Defined cases: null fields hash as `-`; null groups and ids come first. Rows of equal id in a group are ordered by
their leaf, so that the manifest does not depend on their order in the table. An empty table has no manifest
and gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .storage import discard, saved

LEVELS = 5
STRIDE = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a proof holds of each level: whether the sibling stands before, and its digest, null where a node is alone.
STEPS = "array<struct<before boolean, digest string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """H of the fields, each `-` if null, else its bytes in UTF-8, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def placed(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds place (0, 1, ... within the group in `order`) and size (of the group); a written table.

    Rows are sorted by range. A row's number within its range less that of the range's first row of its group, plus
    the group's rows in earlier ranges, is its place: the counts are one row a range and group. How many
    ranges there are follows the session's shuffle partitions."""
    ranged = leaves.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = saved(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = rows.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy("_group")
    starts = counts.select("_group", "_part", (F.sum("_n").over(of.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("size"))
    found = rows.join(starts, rows[group].eqNullSafe(starts["_group"]) & (part == starts["_part"]))
    out = saved(found.withColumn("place", F.col("_row") + F.col("_shift")).drop("_row", "_group", "_part", "_shift"))
    discard(rows)
    return out


def levels_left(size: Column) -> Column:
    """Levels above that many nodes: ceil(log2(size))."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1))).cast("int")


def above(nodes: Column) -> Column:
    """The level above an array of digests: H of each two, the last one alone if need be."""
    pair = lambda i: F.sha2(F.concat(nodes[2 * i], F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def built(nodes: DataFrame, group: str, most: int) -> list[DataFrame]:
    """Written tables of the levels from `nodes` (group, place, size, digest and more columns) up to the roots.

    A row of a table is a node LEVELS above (or the root): group, place, size (of its level), l0 (the table's own
    nodes below it, with all their columns), l1 to l5 (digests; those above the root repeat it), digest. `most` is the
    greatest size of a group."""
    out, current = [], nodes
    while True:
        own = F.sort_array(F.collect_list(F.struct("place", "digest", *[c for c in current.columns if c not in (group, "place", "size", "digest")])))
        t = current.groupBy(group, F.floor(F.col("place") / STRIDE).cast("long").alias("up"), "size").agg(own.alias("l0"))
        t = t.withColumn("_left", levels_left(F.col("size")))
        below: Column = F.transform("l0", lambda x: x["digest"])
        for k in range(1, LEVELS + 1):
            t = t.withColumn(f"l{k}", F.when(F.col("_left") >= k, above(below)).otherwise(below))
            below = F.col(f"l{k}")
        current = saved(t.select(group, F.col("up").alias("place"), F.ceil(F.col("size") / STRIDE).cast("long").alias("size"), F.least("_left", F.lit(LEVELS)).alias("depth"), "l0", *[f"l{k}" for k in range(1, LEVELS + 1)], F.col(f"l{LEVELS}")[0].alias("digest")))
        out.append(current)
        most = -(-most // STRIDE)
        if most <= 1:
            return out
        current = current.select(group, "place", "size", "digest")


def proven(tables: list[DataFrame], group: str, roots: DataFrame) -> DataFrame:
    """The nodes of the lowest table, with root and proof: the siblings from their own level up, before what `roots`
    (group, root, proof) has for the group. Tables above the lowest are read for the last time."""
    above: list[DataFrame] = []
    inherited = tables[-1].join(roots, tables[-1][group].eqNullSafe(roots[group])).select(tables[-1]["*"], "root", "proof")
    for k in range(len(tables) - 1, -1, -1):
        children = inherited.select(group, "root", "proof", "depth", *[f"l{i}" for i in range(LEVELS)], F.explode("l0").alias("child"))
        steps = []
        digests = [F.transform("l0", lambda x: x["digest"]), *[F.col(f"l{i}") for i in range(1, LEVELS)]]
        for i, level in enumerate(digests):
            at = F.shiftright(F.col("child.place").bitwiseAND(STRIDE - 1), i).cast("int")
            step = F.struct((at.bitwiseAND(1) == 1).alias("before"), F.get(level, at.bitwiseXOR(F.lit(1))).alias("digest"))
            steps.append(F.when(F.col("depth") > i, step))
        proof = F.concat(F.array_compact(F.array(*steps)), F.col("proof")).cast(STEPS)
        inherited = children.select(group, "root", proof.alias("proof"), "child.*")
        if k:
            given, t = saved(inherited.select(group, "place", "root", "proof")), tables[k - 1]
            discard(*above, tables[k])
            above = [given]
            inherited = t.join(given, t[group].eqNullSafe(given[group]) & (t["place"] == given["place"])).select(t["*"], "root", "proof")
    return inherited


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda d, s: F.sha2(F.when(s["digest"].isNull(), d).when(s["before"], F.concat(s["digest"], d)).otherwise(F.concat(d, s["digest"])), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, one after the other."""
    return F.array_join(F.transform(proof, lambda s: F.coalesce(s["digest"], F.lit(""))), "")


def manifest(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Every leaf (columns group, digest and others, ordered by `order` within its group) with subroot, root and proof.

    Groups are ordered by their names in UTF-8, null first."""
    rows = placed(leaves, group, [*order, "digest"])
    most = rows.agg(F.max("size")).first()[0]
    if most is None:
        nothing = F.lit(None).cast("string")
        return rows.drop("place", "size").withColumns({"subroot": nothing, "root": nothing, "proof": F.lit(None).cast(STEPS)})
    tables = built(rows, group, most)
    discard(rows)  # the lowest table has them
    top = tables[-1].select(F.lit(0).alias("_all"), F.col(group).alias("name"), "digest")
    heads = placed(top, "_all", ["name"])
    higher = built(heads, "_all", heads.agg(F.max("size")).first()[0])
    discard(heads)
    roots = higher[-1].select("_all", F.col("digest").alias("root"), F.array().cast(STEPS).alias("proof"))
    sub = saved(proven(higher, "_all", roots).select(F.col("name").alias(group), "root", "proof", F.col("digest").alias("subroot")))
    every = proven(tables, group, sub.select(group, "proof", F.struct("root", "subroot").alias("root")))
    return every.select("*", "root.subroot", F.col("root.root").alias("_root")).drop("root", "place").withColumnRenamed("_root", "root")


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))


def documents_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; rows that `tampered` names are
    folded from a leaf with one more in n_chars."""
    c = {k: F.col(k) for k in FIELDS}
    changed = F.when(tampered(c["doc_id"]), leaf([*(c[k] for k in FIELDS[:3]), c["n_chars"] + 1, c["text"]])).otherwise(leaf(list(c.values())))
    leaves = docs.select("doc_id", "lang", leaf(list(c.values())).alias("digest"), changed.alias("given"))
    found = manifest(leaves, "lang", ["doc_id"])
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.col("given"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


_ENC = lambda x: f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"
_LEAF = lambda n: "sha256(" + " || ".join(map(_ENC, ("doc_id", "source", "lang", n, "text"))) + ")"
_BYTES = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"
_FOLD = "sha256(CASE WHEN s.d IS NULL THEN f WHEN t.pos % 2 = 1 THEN s.d || f ELSE f || s.d END)"
#: Level by level; for small tables.
ORACLE_SQL = {
    "op12_merkle_manifest": f"""WITH RECURSIVE r AS (SELECT *, CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END AS more FROM documents),
l0 AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, {_LEAF("n_chars + more")} AS given FROM r),
lf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m, row_number() OVER () AS rid FROM l0),
up(lang, k, pos, m, d) AS (SELECT lang, 0, pos, m, leaf FROM lf UNION ALL SELECT lang, k + 1, pos // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE m > 1 GROUP BY lang, k, pos // 2, m),
sub AS MATERIALIZED (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM up WHERE m = 1),
top(k, pos, m, d) AS (SELECT 0, pos, m, subroot FROM sub UNION ALL SELECT k + 1, pos // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE m > 1 GROUP BY k, pos // 2, m),
w1(rid, lang, k, pos, m, f, p) AS (SELECT rid, lang, 0, pos, m, given, '' FROM lf UNION ALL SELECT t.rid, t.lang, t.k + 1, t.pos // 2, (t.m + 1) // 2, {_FOLD}, t.p || coalesce(s.d, '') FROM w1 t LEFT JOIN up s ON s.lang IS NOT DISTINCT FROM t.lang AND s.k = t.k AND s.pos = xor(t.pos, 1) WHERE t.m > 1),
w2(rid, k, pos, m, f, p) AS (SELECT rid, 0, sub.pos, sub.m, f, p FROM w1 JOIN sub ON sub.lang IS NOT DISTINCT FROM w1.lang WHERE w1.m = 1 UNION ALL SELECT t.rid, t.k + 1, t.pos // 2, (t.m + 1) // 2, {_FOLD}, t.p || coalesce(s.d, '') FROM w2 t LEFT JOIN top s ON s.k = t.k AND s.pos = xor(t.pos, 1) WHERE t.m > 1)
SELECT lf.doc_id, leaf, subroot, top.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = top.d AS verified FROM lf JOIN w2 ON w2.rid = lf.rid AND w2.m = 1 JOIN sub ON sub.lang IS NOT DISTINCT FROM lf.lang JOIN top ON top.m = 1""",
}
