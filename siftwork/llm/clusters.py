"""Centroid clustering by dual-tree Lloyd rounds.

1. Vectors become integers, floor(scale * x) a component, so that distances and means are exact. They are taken as they
   are read, TOGETHER at a time, each lot in a cover tree of its own: a node covers its vectors by a radius around one
   of them, its children by half of it, and their centres are more than that apart. Vectors lie in tree
   order, so that a node is a slice; the trees are written once and no vector is ever shuffled.
2. Each round makes a cover tree of the centroids and traverses both trees: of a pair of nodes the distance of their
   centres and their radii bound all distances between them, and a pair goes that is farther than the node's nearest
   other pair must be. A node that one centroid is left for is its, as a whole, and gives its sum by a difference of
   running sums; vectors of leaves are compared exactly with the centroids that are left, ties going
   to the smaller number. A task returns counts and sums of its centroids, which Spark adds up; only these,
   centroids x components, come to the driver.
3. After the rounds vectors are assigned once more.

Defined cases: vectors that are null, of another length, or with a null or non-finite component give no row. Rows of equal
or null id are vectors of their own; null ids start no centroid. Fewer vectors with an id than centroids
start as many as there are. Centroids without vectors stay where they are. An empty table gives no rows. A component beyond
2**27 after scaling raises an error, as squared distances would not fit a long. Columns other than the id and the vector
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table
from .storage import discard, saved

CLUSTERS, ROUNDS, COMPONENTS, SCALE = 8, 10, 64, 1024
TOGETHER, LEAF, MOST = 2_048, 16, 1 << 27
TREES = pa.schema([("ids", pa.binary()), ("nulls", pa.binary()), ("vectors", pa.binary()), ("nodes", pa.binary()), ("radius", pa.binary())])
#: Bounds are computed with doubles; pairs stay that are farther by less than this share.
SLACK = 1e-9


class CoverTree:
    """Nodes in order of depth: centre and slice [a, z) of `order`, radius, and the children's slice of the nodes."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        f = x.astype(np.float64)
        square = (f * f).sum(axis=1)
        near = square[:, None] + square[None] - 2 * (f @ f.T) if len(x) else np.zeros((0, 0))  # only to group by
        self.order = np.zeros(len(x), np.int64)
        nodes, radius = [], []
        todo = deque([(0, np.arange(len(x)), 0)] if len(x) else [])
        known = len(todo)
        while todo:
            centre, own, a = todo.popleft()
            r = np.sqrt(((f[own] - f[centre]) ** 2).sum(axis=1)).max()
            radius.append(r * (1 + SLACK))
            children = []
            if len(own) > leaf and r > 0:
                left, c = own, centre
                while len(left):
                    close = near[c, left] <= r * r / 4
                    close |= left == c
                    children.append((c, left[close]))
                    left = left[~close]
                    c = left[0] if len(left) else c
            if len(children) < 2:
                self.order[a : a + len(own)] = own
                nodes.append((centre, a, a + len(own), 0, 0))
                continue
            nodes.append((centre, a, a + len(own), known, known + len(children)))
            known += len(children)
            for c, some in children:
                todo.append((c, some, a))
                a += len(some)
        self.nodes = np.array(nodes, np.int64).reshape(-1, 5)
        self.radius = np.array(radius, np.float64)
        place = np.empty(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.nodes[:, 0] = place[self.nodes[:, 0]] if len(nodes) else 0


def opened(first: np.ndarray, end: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """All numbers of the slices [first, end), and the others repeated with them."""
    n = end - first
    at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return [at, *(np.repeat(o, n) for o in others)]


def nearest(x: np.ndarray, nodes: np.ndarray, radius: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list, int]:
    """label (the nearest centroid of each vector), the whole nodes decided as (a, z, label), and how many exact distances it took.

    x: vectors in the order of their tree."""
    tree = CoverTree(centroids, leaf=1)
    cx, cf, xf = centroids[tree.order], centroids[tree.order].astype(np.float64), x.astype(np.float64)
    number = tree.order
    label, whole, exact = np.full(len(x), -1, np.int64), [], 0
    # pairs of a node of vectors and a node of centroids, ordered by the first
    p, q = (np.zeros(1, np.int64), np.zeros(1, np.int64)) if len(x) else (np.zeros(0, np.int64),) * 2
    while len(p):
        d = np.sqrt(((xf[nodes[p, 0]] - cf[tree.nodes[q, 0]]) ** 2).sum(axis=1))
        both = radius[p] + tree.radius[q]
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        which = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]).astype(np.int64)]))
        most = np.minimum.reduceat(d + both, starts)[which]
        stay = d - both <= most * (1 + SLACK) + SLACK
        p, q = p[stay], q[stay]
        n = np.bincount(p, minlength=len(nodes))[p]
        single = tree.nodes[q, 2] - tree.nodes[q, 1] == 1
        done = (n == 1) & single
        for a, z, k in zip(nodes[p[done], 1].tolist(), nodes[p[done], 2].tolist(), number[tree.nodes[q[done], 1]].tolist()):
            label[a:z] = k
            whole.append((a, z, k))
        p, q, single = p[~done], q[~done], single[~done]
        if not len(p):
            break
        # the wider node of a pair is opened; of equal centroids, which have no children, all are compared
        closed = tree.nodes[q, 3] == tree.nodes[q, 4]
        end = nodes[p, 3] == nodes[p, 4]
        open_q = ~closed & (end | (tree.radius[q] >= radius[p]))
        waits = np.zeros(len(nodes), bool)
        waits[p[open_q]] = True  # its centroids first
        ready = end & ~waits[p]
        if ready.any():
            rows, cs = opened(nodes[p[ready], 1], nodes[p[ready], 2], q[ready])
            c, rows = opened(tree.nodes[cs, 1], tree.nodes[cs, 2], rows)
            exact += len(rows)
            step = max(1, (1 << 22) // x.shape[1])
            far = np.concatenate([((x[rows[i : i + step]] - cx[c[i : i + step]]) ** 2).sum(axis=1) for i in range(0, len(rows), step)])
            by = np.lexsort((number[c], far, rows))
            first = by[np.flatnonzero(np.concatenate([[True], rows[by][1:] != rows[by][:-1]]))]
            label[rows[first]] = number[c[first]]
        down = ~end & ~waits[p]
        same = waits[p] & ~open_q
        new_q, from_p = opened(tree.nodes[q[open_q], 3], tree.nodes[q[open_q], 4], p[open_q])
        new_p, from_q = opened(nodes[p[down], 3], nodes[p[down], 4], q[down])
        p, q = np.concatenate([p[same], from_p, new_p]), np.concatenate([q[same], new_q, from_q])
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
    return label, whole, exact


def forest(vectors: DataFrame, components: int, together: int) -> DataFrame:
    """A written table with a row for each lot of vectors (columns id and v, arrays of `components` longs) and its cover tree."""

    def lot(ids: list, parts: list):
        raw = np.concatenate(parts)
        if np.abs(raw).max() > MOST:
            raise ValueError(f"a component is beyond {MOST} after scaling")
        t = CoverTree(raw)
        x, own = raw[t.order].astype("<i4"), pa.concat_arrays(ids).take(pa.array(t.order))
        null = np.array(own.is_null())
        row = [np.asarray(own.fill_null(0)).astype("<i8").tobytes(), null.tobytes(), x.tobytes(), t.nodes.astype("<i8").tobytes(), t.radius.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in row], schema=TREES)

    def run(it):
        ids, parts, n = [], [], 0
        for b in it:
            for i in range(0, b.num_rows, together):
                some = b.slice(i, together)
                v = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
                ids.append(some.column(0))
                parts.append(v)
                n += len(v)
                if n >= together:
                    yield lot(ids, parts)
                    ids, parts, n = [], [], 0
        if n:
            yield lot(ids, parts)
        release()

    return saved(vectors.select("id", "v").mapInArrow(run, "ids binary, nulls binary, vectors binary, nodes binary, radius binary"))


def lots(it, components: int):
    for b in it:
        for ids, nulls, vectors, nodes, radius in zip(*(b.column(k).to_pylist() for k in TREES.names)):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(nulls, bool), np.frombuffer(vectors, "<i4").reshape(-1, components).astype(np.int64), np.frombuffer(nodes, "<i8").reshape(-1, 5), np.frombuffer(radius)
    release()


def sums(trees: DataFrame, centroids: np.ndarray, components: int) -> dict[int, tuple[int, list[int]]]:
    """For each centroid with vectors their number and sum."""

    def run(it):
        total, count = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, _, x, nodes, radius in lots(it, components):
            label, whole, _ = nearest(x, nodes, radius, centroids)
            running = np.concatenate([np.zeros((1, components), np.int64), np.cumsum(x, axis=0)])
            count += np.bincount(label, minlength=len(centroids))
            for a, z, k in whole:
                total[k] += running[z] - running[a]
                label[a:z] = -1
            for k in np.unique(label[label >= 0]).tolist():
                total[k] += x[label == k].sum(axis=0)
        k, c = np.nonzero(np.broadcast_to(count[:, None] > 0, (len(centroids), components + 1)))
        value = [int(count[i]) if j == components else int(total[i, j]) for i, j in zip(k.tolist(), c.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.int32()), pa.array(value, pa.int64())], names=["k", "c", "total"])

    got = trees.mapInArrow(run, "k int, c int, total long").groupBy("k", "c").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # centroids x components
    at = {(r.k, r.c): int(r.total) for r in got}
    return {k: (n, [at[k, j] for j in range(components)]) for (k, c), n in at.items() if c == components}


def cluster(vectors: DataFrame, start: list[list[int]], rounds: int = ROUNDS, together: int = TOGETHER) -> tuple[DataFrame, list[list[int]]]:
    """vectors: id, v (arrays of longs). Returns id, cluster and distance (squared) of every row, and the last centroids."""
    components = len(start[0])
    trees = forest(vectors, components, together)
    centroids = [list(map(int, c)) for c in start]
    for _ in range(rounds):
        found = sums(trees, np.array(centroids, np.int64), components)
        after = [[s // found[k][0] for s in found[k][1]] if k in found else c for k, c in enumerate(centroids)]
        if after == centroids:
            break  # further rounds would not change anything
        centroids = after
    last = np.array(centroids, np.int64)

    def run(it):
        for ids, nulls, x, nodes, radius in lots(it, components):
            label, _, _ = nearest(x, nodes, radius, last)
            far = ((x - last[label]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(label, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    out = saved(trees.mapInArrow(run, "id long, cluster int, distance long"))
    discard(trees)
    return out, centroids


def integers(table: DataFrame, id_column: str, vector: str, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id and v, the components as floor(scale * x), of the rows whose vector is whole and finite."""
    x = lambda c: c.cast("double")
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v")).where(F.size("v") == components)
    # NaN sorts above every number, so that one comparison is enough
    whole = rows.where(F.forall("v", lambda c: F.coalesce((x(c) < float("inf")) & (x(c) > float("-inf")), F.lit(False))))
    return whole.select("id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * x(c)).cast("long")).alias("v"))


def starts(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the least sha256 of `<seed>:<id>`; ties by their components."""
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in vectors.where("id IS NOT NULL").select(own.alias("h"), "v").orderBy("h", "v").limit(clusters).select("v").collect()]


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row of id, v."""
    start = starts(vectors, clusters, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return vectors.sparkSession.createDataFrame([], schema)
    rows, centroids = cluster(vectors, start, rounds)
    each = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    # one row a centroid
    about = [(k, n, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k, n in each.items()]
    of = F.broadcast(vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, centroid_sha256 string"))
    return rows.join(of, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(sum(each.values())).cast("long").alias("inertia"), "centroid_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def _sql() -> str:
    """All distances by brute force, the rounds one after the other."""
    out = [
        f"WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INT AS k, x AS c FROM v QUALIFY k < {CLUSTERS})",
    ]
    far = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := {far}, k := k)) AS m FROM v, c{r} GROUP BY vec_id)")
        if r < ROUNDS:
            mean = "(s - ((s % n) + n) % n) // n"
            out.append(f"s{r} AS MATERIALIZED (SELECT k, list(CAST({mean} AS BIGINT) ORDER BY i) AS c FROM (SELECT m.k AS k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {COMPONENTS + 1}) g(i) GROUP BY ALL) GROUP BY k)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (k))")
    return ",\n".join(out) + f"\nSELECT vec_id, m.k AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.k)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON k = m.k"


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE_SQL = {"op13_centroid_clustering": _sql()}
