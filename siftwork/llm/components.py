"""Connected components of an edge table, by repeated contraction to the neighbour of least random rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, saved


#: A contracted graph of at most so many edges is finished by one task: 4 MB.
FEW = 1 << 18


def finish(it):
    """node, label (the least node of its component) of a graph that one task holds."""
    parent: dict = {}

    def root(v):
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = p
        return v

    for b in it:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(parent, np.int64, len(parent))), pa.array([root(v) for v in list(parent)], pa.int64())], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, label: one label for each component, of every node that has an edge, as a written table.

    Each round maps every node to the least of itself and its neighbours in a random order and keeps the
    edges between the images; a fixed share of the nodes disappears each round, so the number of rounds
    is logarithmic. All tables are distributed; the driver only asks how many edges are left. The last FEW
    need no more rounds."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), c.alias("n"))
    one_way = lambda a, b: F.when(a < b, F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))
    current = saved(edges.where("a <> b").select(one_way(F.col("a"), F.col("b")).alias("e")).distinct().select("e.*"))
    steps = []
    while (left := current.count()) > 0:
        if left <= FEW:
            steps.append(saved(current.coalesce(1).mapInArrow(finish, "node long, label long")))
            break
        ends = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
        step = saved(least.select("node", F.least("m", rank(F.col("node"))).alias("m")).select("node", F.col("m.n").alias("label")))
        x, y = step.select(F.col("node").alias("a"), F.col("label").alias("x")), step.select(F.col("node").alias("b"), F.col("label").alias("y"))
        mapped = current.join(x, "a").join(y, "b").where("x <> y")
        after = saved(mapped.select(one_way(F.col("x"), F.col("y")).alias("e")).distinct().select("e.*"))
        discard(current)
        steps.append(step)
        current = after
    if not steps:  # no edges: an empty table, which is read from its own files
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("label"), F.col("label").alias("end"))
        out = step.join(later, "label", "left").select("node", F.coalesce("end", "label").alias("label"))
    if len(steps) > 1:
        out = saved(out)
        discard(*steps)
    discard(current)
    return out
