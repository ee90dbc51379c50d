"""Copies among images by local descriptors: cropped, shifted, turned, half-size, brightened or otherwise edited ones too.

Images are rows (image_id, pixels, width): pixels are grey values row by row. At each of two scales, corners
are the local maxima of the Harris response, placed between pixels by a parabola; around each, binary tests
compare smoothed values at places of a fixed pattern turned by the corner's own direction (that of its
intensity centroid). Two descriptors match if at most DISTANCE bits differ. A match also tells how far one
image is turned against the other, and by the two scales which of 1/2, 1 and 2 it is resized by. Two images
are copies if enough of their matches agree on one such turn, ratio and shift: at least VOTES corners, and a
fifth of the corners of the image that has fewer.

Hamming tables: the bits are cut into BANDS bands, one more than DISTANCE, so every match agrees in a whole
band and meets in that band's table; no match is lost. Equal images are one entry (class). Groups of copies
are the components of the copies' graph, found without all pairs of a group:

1. Stars. The entries of each band value are dealt to blocks of at most about BLOCK, and all of a block are
   compared with LEADERS of it. Matches vote, and what they prove is joined. Each of ROUNDS deals anew.
2. The rest. Band values that still have entries of several groups are compared fully, but only entries of
   different groups; hot values do so block by block. What agrees joins the groups, which are then exact.

Defined cases: null or ill-sized pixels, and images without a corner, are in a class by equality of
pixels and match nothing else; null ids go along with their class; an empty table gives an empty result;
columns besides image_id, pixels and width are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .components import components
from .storage import saved

BITS, BANDS, DISTANCE, VOTES, TURNS, STEP = 128, 5, 4, 3, 12, 4
WIDTH = BITS // BANDS  # bits of a band
BLOCK, SIDE, SHARE, LEADERS, ROUNDS = 2048, 48, 5, 8, 2
POINT = "class string, x float, y float, angle float, size int, high long, low long"
PA_POINT = pa.schema([("class", pa.string()), ("x", pa.float32()), ("y", pa.float32()), ("angle", pa.float32()), ("size", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
MATCH = "q long, no long, q_x float, q_y float, x float, y float, turn float, ratio float"
PA_MATCH = pa.schema([("q", pa.int64()), ("no", pa.int64())] + [(k, pa.float32()) for k in ("q_x", "q_y", "x", "y", "turn", "ratio")])
#: Margin within which a corner's patch and pattern stay inside the picture.
MARGIN, REACH, DISC = 8, 7.0, 30


@functools.lru_cache(maxsize=1)
def pattern() -> np.ndarray:
    """Pairs of test places around a corner: (bit, end, axis)."""
    base = np.random.default_rng(11).normal(0, 4.0, (BITS, 2, 2))
    return base * np.minimum(1.0, REACH / np.linalg.norm(base, axis=2, keepdims=True))


@functools.lru_cache(maxsize=1)
def disc() -> tuple[np.ndarray, np.ndarray]:
    """The places whose values give a corner its direction."""
    v, u = np.mgrid[-5:6, -5:6].astype(float)
    inside = u * u + v * v <= DISC
    return u[inside], v[inside]


def box(g: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of radius r."""
    p = np.pad(g, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / (n * n)


def between(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values at places between pixels, by their four neighbours."""
    j, i = np.clip(x.astype(int), 0, g.shape[1] - 2), np.clip(y.astype(int), 0, g.shape[0] - 2)
    f, h = x - j, y - i
    return (g[i, j] * (1 - f) + g[i, j + 1] * f) * (1 - h) + (g[i + 1, j] * (1 - f) + g[i + 1, j + 1] * f) * h


def corners(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the local maxima of the Harris response that stand out from the image's own range."""
    none = np.zeros(0), np.zeros(0)
    if min(g.shape) <= 2 * MARGIN:
        return none
    dy, dx = np.gradient(g)
    a, b, c = box(dx * dx, 2), box(dy * dy, 2), box(dx * dy, 2)
    r = box(a * b - c * c - 0.05 * (a + b) ** 2, 1)
    if not r.max() > 1e-12:
        return none
    near = np.max([np.roll(np.roll(r, i, 0), j, 1) for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
    top = (r == near) & (r > 0.01 * r.max())
    top[:MARGIN] = top[-MARGIN:] = False
    top[:, :MARGIN] = top[:, -MARGIN:] = False
    y, x = np.nonzero(top)
    return x + summit(r[y, x - 1], r[y, x], r[y, x + 1]), y + summit(r[y - 1, x], r[y, x], r[y + 1, x])


def summit(before: np.ndarray, top: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where, from -1/2 to 1/2, the parabola through three values has its maximum."""
    bend = before - 2 * top + after
    return np.where(bend < 0, np.clip((before - after) / (2 * np.where(bend < 0, bend, -1.0)), -0.5, 0.5), 0.0)


def describe(pixels: np.ndarray) -> list[tuple[float, float, float, int, int, int]]:
    """(x, y, angle, size, high, low) of each corner, x and y in the full image and from its centre."""
    out: list = []
    g = pixels.astype(float)
    middle_y, middle_x = (np.array(g.shape) - 1) / 2
    du, dv = disc()
    p = pattern()
    for size in (1, 2):
        smooth = box(g, 1)
        x, y = corners(smooth)
        if len(x):
            patch = between(smooth, x[:, None] + du, y[:, None] + dv)
            patch = patch - patch.mean(1, keepdims=True)
            angle = np.arctan2((patch * dv).sum(1), (patch * du).sum(1))
            cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            v = between(smooth, x[:, None, None] + p[:, :, 0] * cos - p[:, :, 1] * sin, y[:, None, None] + p[:, :, 0] * sin + p[:, :, 1] * cos)
            bits = np.packbits(v[:, :, 0] > v[:, :, 1], axis=1).view(">i8")
            shift = (size - 1) / 2  # a pixel of the half-size picture stands for four
            out += zip(x * size + shift - middle_x, y * size + shift - middle_y, angle, [size] * len(x), bits[:, 0].tolist(), bits[:, 1].tolist())
        h, w = g.shape[0] // 2, g.shape[1] // 2
        g = g[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean((1, 3))
        if min(g.shape) <= 2 * MARGIN:
            break
    return out


def classes(images: DataFrame) -> DataFrame:
    """image_id, pixels, width and class: the hash of width and pixels."""
    same = F.sha2(F.concat_ws("|", F.coalesce(F.col("width").cast("string"), F.lit("")), F.coalesce(F.hex("pixels"), F.lit("null"))), 256)
    return images.select("image_id", "pixels", "width", same.alias("class"))


def points(images: DataFrame) -> DataFrame:
    """POINT rows of one image a class."""

    def run(it):
        for b in it:
            rows = []
            for c, p, w in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in ("class", "pixels", "width"))):
                if p and w and w > 0 and len(p) % w == 0:
                    rows += [(c, *d) for d in describe(np.frombuffer(p, np.uint8).reshape(-1, w))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), PA_POINT)], schema=PA_POINT)

    one = images.groupBy("class").agg(F.first("pixels").alias("pixels"), F.first("width").alias("width"))
    return one.mapInArrow(run, POINT)


def numbered(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, no and number of points of each class with a point; the points with no instead of class)."""
    found = saved(points(images))
    numbers = saved(found.groupBy("class").agg(F.count("*").alias("points")).withColumn("no", F.monotonically_increasing_id()))
    return numbers, saved(found.join(numbers.select("class", "no"), "class").drop("class"))


def band(i: int) -> Column:
    """The value of band i, below it in the number of its table."""
    at, mask = i * WIDTH, (1 << WIDTH) - 1
    up = 128 - at - WIDTH  # bits below the band
    if up >= 64:
        v = F.shiftrightunsigned("high", up - 64)
    elif up + WIDTH <= 64:
        v = F.shiftrightunsigned("low", up)
    else:
        v = F.shiftleft("high", 64 - up).bitwiseOR(F.shiftrightunsigned("low", up))
    return F.lit(i << WIDTH) + v.bitwiseAND(F.lit(mask))


def entries(index: DataFrame) -> DataFrame:
    """A row for each point and band: cell is the band with its value."""
    return index.withColumn("cell", F.explode(F.array(*(band(i) for i in range(BANDS)))))


def grouped(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` with grp, the group that labels (node, label) give their no, or else no itself."""
    if labels is None:
        return rows.withColumn("grp", F.col("no"))
    of = labels.select(F.col("node").alias("no"), F.col("label").alias("to"))
    return rows.join(of, "no", "left").withColumn("grp", F.coalesce("to", "no")).drop("to")


def shared(rows: DataFrame) -> DataFrame:
    """The entries whose cell has several groups, with the number of blocks for its cell."""
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("grp").alias("least"), F.max("grp").alias("most")).where("least < most")
    return rows.join(cells.select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks")), "cell")


def whole_groups(it, keys: int, at_least: int = 8192):
    """Tables of whole groups, from batches sorted by their first `keys` columns."""
    held, n, wanted = [], 0, at_least
    for b in it:
        held.append(b)
        n += b.num_rows
        if n < wanted:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        k = [t.column(i).to_numpy() for i in range(keys)]
        last = n - int(np.logical_and.reduce([x == x[-1] for x in k]).sum())
        if last:
            yield t.slice(0, last)
        held, n = t.slice(last).to_batches(), n - last
        wanted = max(at_least, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row begins a group, in sorted columns."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def ranges(low: np.ndarray, count: np.ndarray, together: int = 1 << 20):
    """(row, other) of every row and each of the `count` rows from `low` on, some at a time."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, "right")))
        c = count[at:stop]
        yield np.repeat(np.arange(at, stop), c), np.arange(c.sum()) + np.repeat(low[at:stop] - (np.cumsum(c) - c), c)
        at = stop


def within(c: dict, a: np.ndarray, b: np.ndarray):
    """MATCH rows of those pairs of rows that differ in at most DISTANCE bits and are of different groups."""
    ok = c["grp"][a] != c["grp"][b]
    a, b = a[ok], b[ok]
    ok = np.bitwise_count(c["high"][a] ^ c["high"][b]).astype(np.int32) + np.bitwise_count(c["low"][a] ^ c["low"][b]) <= DISTANCE
    a, b = a[ok], b[ok]
    if len(a):
        q, o = np.where(c["no"][a] < c["no"][b], a, b), np.where(c["no"][a] < c["no"][b], b, a)
        row = [c["no"][q], c["no"][o], c["x"][q], c["y"][q], c["x"][o], c["y"][o], c["angle"][o] - c["angle"][q], c["size"][o] / c["size"][q]]
        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, PA_MATCH)], schema=PA_MATCH)


def columns(t: pa.Table) -> dict:
    c = {k: t.column(k).to_numpy() for k in t.column_names}
    return c | {k: c[k].view(np.uint64) for k in ("high", "low")}


def star(it):
    """MATCH rows of rows sorted by cell, block and rank: each row with the first LEADERS of its block."""
    for t in whole_groups(it, 2):
        c = columns(t)
        new = firsts(c["cell"], c["block"])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        place = np.arange(len(new)) - start[group]
        for a, b in ranges(start[group], np.minimum(place, LEADERS)):
            yield from within(c, a, b)


def near(it):
    """MATCH rows of rows sorted by cell, i, j, side and grp: all pairs of different groups."""
    for t in whole_groups(it, 3):
        c = columns(t)
        new = firsts(c["cell"], c["i"], c["j"])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        left = np.add.reduceat(c["side"] == 0, start)  # rows of the first side
        own = firsts(c["cell"], c["i"], c["j"], c["side"], c["grp"])
        before = np.maximum.accumulate(np.where(own, np.arange(len(own)), 0)) - start[group]  # rows of lesser groups
        count = np.where(c["i"] == c["j"], before, np.where(c["side"] == 1, left[group], 0))
        for a, b in ranges(start[group], count):
            yield from within(c, a, b)


GEOMETRY = ("x", "y", "angle", "size", "high", "low")


def star_matches(index: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """MATCH rows of entries of one block of a cell with LEADERS of it; all are matches, but not all matches."""
    block, rank = F.pmod(F.xxhash64("no", F.lit(seed)), F.col("blocks")), F.xxhash64(F.lit(seed), "no")
    dealt = shared(grouped(entries(index), labels)).select("cell", block.alias("block"), rank.alias("rank"), "no", "grp", *GEOMETRY)
    return dealt.repartition("cell", "block").sortWithinPartitions("cell", "block", "rank").mapInArrow(star, MATCH)


def matches(index: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """MATCH rows: all pairs of points of different groups (without labels: of different images) that differ in at
    most DISTANCE bits; a pair that agrees in several bands comes for each.

    Every two blocks of a cell meet in a group of their own, so a hot cell is spread over many tasks and loses nothing."""
    own, other = F.pmod(F.xxhash64("no", "x", "y", "size"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = shared(grouped(entries(index), labels)).withColumn("own", own).withColumn("other", other)
    sides = met.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "grp", "no", *GEOMETRY)
    return sides.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "grp").mapInArrow(near, MATCH)


def vote(it):
    """q, no, votes of rows of MATCH sorted by q and no: pairs with at least VOTES corners that agree on a turn, a ratio and a shift.

    Each match moves its query corner by its own turn and ratio; the shift is what is then left, in the other image's
    pixels and between the centres. A turn or shift near a cell's edge also counts for the next cell."""
    for t in whole_groups(it, 2):
        c = {k: t.column(k).to_numpy() for k in t.column_names}
        start = np.flatnonzero(firsts(c["q"], c["no"]))
        size = np.diff(np.append(start, t.num_rows))
        # groups of too few matches have too few votes; the others are taken some at a time
        start, size = start[size >= VOTES], size[size >= VOTES]
        ends, at = np.cumsum(size), 0
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), "right")))
            n = size[at:stop]
            rows = np.arange(n.sum()) + np.repeat(start[at:stop] - (np.cumsum(n) - n), n)
            pair = np.repeat(np.arange(stop - at), n)
            m = {k: v[rows].astype(float) for k, v in c.items() if k not in ("q", "no")}
            cos, sin = np.cos(m["turn"]) * m["ratio"], np.sin(m["turn"]) * m["ratio"]
            dx, dy = m["x"] - (cos * m["q_x"] - sin * m["q_y"]), m["y"] - (sin * m["q_x"] + cos * m["q_y"])
            turn, dx, dy = (np.floor(v).astype(np.int64) for v in (m["turn"] / (2 * np.pi) * TURNS, dx / STEP, dy / STEP))
            ratio = np.rint(np.log2(m["ratio"])).astype(np.int64) + 1
            point = np.unique(np.stack([m["q_x"], m["q_y"]], 1).view(complex).ravel(), return_inverse=True)[1]
            head = np.concatenate([(pair * 3 + ratio) * TURNS + (turn + i) % TURNS for i in (0, 1) for _ in range(4)])
            tail = np.concatenate([((dx + i) << 32) + (dy + j) for _ in range(2) for i in (0, 1) for j in (0, 1)])
            point = np.tile(point, 8)
            order = np.lexsort((point, tail, head))
            head, tail, point = head[order], tail[order], point[order]
            cell = firsts(head, tail)
            once = firsts(head, tail, point)
            votes = np.add.reduceat(once, np.flatnonzero(cell), dtype=np.int64)
            best = np.zeros(stop - at, np.int64)
            np.maximum.at(best, head[cell] // (3 * TURNS), votes)
            ok = best >= VOTES
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[k][start[at:stop][ok]]) for k in ("q", "no")] + [pa.array(best[ok])], names=["q", "no", "votes"])
            at = stop


def agreed(close: DataFrame, numbers: DataFrame) -> DataFrame:
    """q, no, votes: pairs of classes with at least VOTES matches that agree on one turn, ratio and shift, and a fifth of the corners."""
    best = close.repartition("q", "no").sortWithinPartitions("q", "no").mapInArrow(vote, "q long, no long, votes long")
    sizes = numbers.select("no", "points")
    sized = best.join(sizes, "no").join(sizes.select(F.col("no").alias("q"), F.col("points").alias("q_points")), "q")
    return sized.where(F.col("votes") * SHARE >= F.least("points", "q_points")).select("q", "no", "votes")


def find_copies(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_id and class of every row; query class, class and votes of every pair of classes that are copies, both ways round).

    Within a group of m copies these are m * m rows; `find_groups` gives the groups without them."""
    named = saved(classes(images))
    numbers, index = numbered(named)
    pairs = saved(agreed(matches(index), numbers))
    name = numbers.select("no", "class")
    one = pairs.join(name, "no").join(name.select(F.col("no").alias("q"), F.col("class").alias("query")), "q").select("query", "class", "votes")
    return named.select("image_id", "class"), one.unionByName(one.select(F.col("class").alias("query"), F.col("query").alias("class"), "votes"))


def find_groups(images: DataFrame) -> DataFrame:
    """image_id, class_id, members, copy_id and corners of every row of `images`.

    class_id is the least image_id of equal images and members their number of rows; copy_id is the least image_id
    that links between copies reach, its own included; corners is the number of descriptors of the image."""
    named = saved(classes(images))
    numbers, index = numbered(named)
    links, labels = None, None
    for seed in range(ROUNDS + 1):
        close = star_matches(index, labels, seed) if seed < ROUNDS else matches(index, labels)
        found = saved(agreed(close, numbers).select(F.col("q").alias("a"), F.col("no").alias("b")))
        links = found if links is None else links.union(found)
        labels = components(links)
    least = named.groupBy("class").agg(F.min("image_id").alias("class_id"), F.count("*").alias("members"))
    of = labels.select(F.col("node").alias("no"), "label")
    known = saved(least.join(numbers, "class", "left").join(of, "no", "left"))
    reach = known.where("label IS NOT NULL").groupBy("label").agg(F.min("class_id").alias("copy_id"))
    every = known.join(reach, "label", "left").select("class", "class_id", "members", F.coalesce("copy_id", "class_id").alias("copy_id"), F.coalesce("points", F.lit(0)).alias("corners"))
    return named.select("image_id", "class").join(every, "class").drop("class")


@functools.lru_cache(maxsize=4)
def textures(n: int, side: int) -> np.ndarray:
    """n fixed pictures of smoothed noise."""
    noise = np.random.default_rng(5).normal(size=(n, side, side))
    smooth = np.array([box(box(g, 1), 1) for g in noise])
    return (smooth / smooth.std((1, 2), keepdims=True)).reshape(n, -1)


def picture(vectors: DataFrame, vector: str = "embedding", side: int = SIDE) -> DataFrame:
    """Grey pictures of vectors, a stand-in for decoded images: the sum of fixed textures weighted by a vector's values.

    Like a photograph's, a patch of it depends on many values, so that only pictures of close vectors look alike corner
    by corner. Null and empty vectors, and those with a value that is null or not finite, have no picture."""

    def run(it):
        for b in it:
            ids, out = b.column(0), []
            for v in b.column(1).to_pylist():
                if not v or any(x is None or not np.isfinite(x) for x in v):
                    out.append(None)
                    continue
                wide = np.array(v, float) @ textures(len(v), side)
                low, high = wide.min(), wide.max()
                out.append(((wide - low) / (high - low or 1.0) * 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()), pa.array([side] * len(out), pa.int32())], names=["image_id", "pixels", "width"])

    return vectors.select(F.col("vec_id").cast("long").alias("image_id"), vector).mapInArrow(run, "image_id long, pixels binary, width int")


def op4_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every image: its class of equal images and its group of copies."""
    return find_groups(picture(table(spark, sf_dir, "embeddings")))


QUERIES = {"op4_media_copies": op4_media_copies}
