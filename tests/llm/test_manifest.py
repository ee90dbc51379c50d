"""The Merkle manifest against one built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftwork.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i % 2 == 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i //= 2
    return out


def brute(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top, out = tree([trees[g][-1][0] for g in names]), []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = proof(trees[g], i) + proof(top, k)
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            d = leaf((*r[:3], r[3] + 1, r[4]) if changed else r)
            for before, s in path:
                d = h(d) if s is None else h(s, d) if before else h(d, s)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(s or "" for _, s in path)), d, d == top[-1][0]))
    return out


def rows(n, langs, seed=4):
    rng = random.Random(seed)
    weights = [2**-k for k in range(len(langs))]
    return [(i * 3 + 1, rng.choice(["a", None, "sö"]), rng.choices(langs, weights)[0], rng.choice([None, i]), rng.choice(["", None, "tëxt " * (i % 5)])) for i in range(n)]


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en"]), (33, ["en", None]), (700, ["en", "fr", None, "é", "z", "Z", "\U0001f600", "￿"]), (1030, ["en", "fr"])])
def test_manifest_equals_brute_force(spark, n, langs):
    data = rows(n, langs)
    random.Random(1).shuffle(data)
    got = listed(manifest.documents_manifest(spark.createDataFrame(data, SCHEMA).repartition(5)))
    assert got == sorted(brute(data), key=str)
    assert n < 30 or 0 < sum(not r[-1] for r in got) < n / 3


def test_manifest_of_odd_rows(spark):
    """Null and repeated ids, equal rows, other columns and an empty table."""
    data = [*rows(40, ["en", None]), (None, None, None, None, None), (None, "a", "en", 5, "x"), (None, "a", "en", 5, "x"), (7, "b", "en", 1, "y"), (7, "a", "en", 1, "z"), (7, "b", "en", 1, "y")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA + ", place string, size int").repartition(3)
    assert listed(manifest.documents_manifest(docs)) == sorted(brute(data), key=str)
    assert manifest.documents_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(1, "a", "en", 9, "word " * 200_000)]
    assert listed(manifest.documents_manifest(spark.createDataFrame(long, SCHEMA))) == brute(long)


def test_every_change_is_seen(spark):
    """A proof leads to the root only from its own leaf."""
    data = spark.createDataFrame(rows(200, ["en", "fr"]), SCHEMA)
    leaves = data.select("doc_id", "lang", manifest.leaf([F.col(k) for k in manifest.FIELDS]).alias("digest"))
    found = manifest.manifest(leaves, "lang", ["doc_id"]).withColumn("other", F.sha2(F.concat("digest", F.lit("x")), 256))
    got = found.select((manifest.folded(F.col("digest"), F.col("proof")) == F.col("root")).alias("own"), (manifest.folded(F.col("other"), F.col("proof")) == F.col("root")).alias("changed"))
    assert [tuple(r) for r in got.distinct().collect()] == [(True, False)]


def test_places_do_not_gather_a_group(spark):
    """One group over many ranges is numbered without a gap."""
    d = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("doc_id"), F.lit("en").alias("lang"))
    got = manifest.placed(d, "lang", ["doc_id"])
    assert got.where("place <> doc_id OR size <> 5000").count() == 0 and got.count() == 5000
