"""Components of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, by signature trees.

1. Copies. Equal sets are found by their 128-bit hashes; the one of the least doc_id stands for all.
2. Filter. Of a set of n shingles in hash order, the first n - ceil(0.8 n) + n/10 are sent to their hash
   buckets and come back with the number of sets that have them. Linked sets share at least a tenth of
   the smaller one there, so a set with fewer shared shingles has no partner and leaves.
3. Blocks. The rarest of those shingles, enough for linked sets to have one in common, connect the
   remaining sets to blocks; a linked pair is never in two blocks.
4. Trees. Each block gets a signature tree: leaves of sets in size order, nodes with OR-combined token
   bitmaps and size ranges. A dual traversal drops node pairs whose greatest possible overlap is too
   small for the similarity, and the remaining pairs are compared exactly; pairs connected already
   are passed over. A block with more than BLOCK sets or BYTES bytes of them is dealt to several trees in
   size order (sets of one size by hash), and each pair of trees that their size ranges allow is traversed
   in a task of its own.
5. Components. Only sets that stand for others are linked; their copies follow their owner, so a
   group of thousands of copies is one node.

Every link between different sets that is not implied by links
already found is kept, so components are exact.

Defined cases: null text and text without words have no shingles, n_shingles 0 and their own component;
fewer words than `words` make one shingle of all of them. Rows of equal doc_id share a component;
a null doc_id keeps its row, with a null component. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Exchange, groups, meet, parts
from .common import table
from .components import components
from .hashing import U, Words, grams
from .storage import discard, saved

WORDS, NUM, DEN = 5, 4, 5  # shingle width; similarity NUM / DEN
BLOCK, BYTES, LEAF, FAN, BITS = 2_048, 4 << 20, 8, 8, 4_096
REST, SEVERAL = (1 << 31) - 1, 1 << 31
SETS, STARS, ALL = range(3)


class Sets:
    """The shingle sets of a chunk's documents: `values` ascending within each of the slices `first`."""

    def __init__(self, texts: list, words: int):
        w = Words(texts, lower=True)
        h, ok = grams(w.hash, words), w.inside(words)
        at = np.flatnonzero(ok)
        short = np.flatnonzero((w.count > 0) & (w.count < words))
        by = [short[w.count[short] == n] for n in range(1, words)]  # all words of the short ones
        h = np.concatenate([h[at], *(grams(w.hash, n)[w.first[some]] for n, some in enumerate(by, 1) if len(some))])
        doc = np.concatenate([w.doc[at], *by])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
        self.values, self.doc = h[new], doc[new]
        self.n = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.key = [xxhash.xxh3_128_digest(self.values[a:z].tobytes()) for a, z in zip(self.first[:-1], self.first[1:])]
        seen: dict[bytes, int] = {}
        #: the first document of the chunk with the same set
        self.model = np.array([seen.setdefault(k, i) for i, k in enumerate(self.key)], np.int64)

    def rank(self) -> np.ndarray:
        return np.arange(len(self.values)) - self.first[self.doc]


def needed(n):
    """Least overlap with any partner."""
    return -(-n * NUM // DEN)


def spare(n):
    return np.maximum(1, n // 10)


def sent(n):
    """How many shingles of a set are sent, so that linked sets share spare() of the smaller among them."""
    return np.minimum(n, n - needed(n) + spare(n))


def shared(n):
    """How many of those any partner must have."""
    return np.minimum(n, spare(needed(n)))


class Rarest:
    """Keys by which similar sets meet: the first shingles in hash order, of which the rarest connect sets to blocks."""

    def keys(self, s: Sets, stands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values that are sent for the standing documents, and whose they are."""
        lead = np.flatnonzero((s.rank() < sent(s.n)[s.doc]) & stands[s.doc])
        return s.values[lead], s.doc[lead]

    def shared(self, n):
        """How many of its values a set has in common with others, if it has a partner."""
        return shared(n)

    def leading(self, n):
        """How many of its shared values, the rarest first, include one that any partner has too."""
        return sent(n) - shared(n) + 1


def join_sets(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles) of every row, and (a, b): links that connect exactly the linked documents."""
    every, links, _ = owned_sets(docs, words, block)
    copies = every.where("owner <> doc_id").select(F.col("doc_id").alias("a"), F.col("owner").alias("b"))
    return every.drop("owner"), links.union(copies)


def counted(docs: DataFrame, words: int, rule):
    """The first two visits: equal sets find their owner, and keys by which similar sets meet (see Rarest) come back counted.

    Returns the exchange, the replies for a third visit, and look(s, chunk, ids, got), which tells that visit owner (the doc_id that
    stands for each document's set), stands (whether a document does), and of the keys of those that do value, document and number of sets that have it;
    and takes the second visit's note out of `got`."""
    x = Exchange(docs)
    buckets = x.buckets

    def owners(s, ids, reply: bytes):
        """For each document the doc_id that stands for its set: from the reply, or the chunk's first with the set."""
        elsewhere = {reply[i : i + 16]: int.from_bytes(reply[i + 16 : i + 24], "little", signed=True) for i in range(0, len(reply), 24)}
        return [elsewhere.get(s.key[m], ids[m]) for m in s.model.tolist()]

    def standing(s, ids, own):
        """Whether a document stands for its set."""
        return np.array([i is not None and o == i and m == k for k, (i, o, m) in enumerate(zip(ids, own, s.model.tolist()))], bool) & (s.n > 0)

    def send_sets(chunk, ids, texts):
        s = Sets(texts, words)
        out: dict[int, list] = {}
        for i in np.unique(s.model).tolist():
            if s.n[i] and ids[i] is not None:
                out.setdefault(int.from_bytes(s.key[i][:8], "little") * buckets >> 64, []).append(s.key[i] + ids[i].to_bytes(8, "little", signed=True))
        for b, some in out.items():
            yield b, b"".join(some)

    def own_sets(key, chunks, payloads):
        least: dict[bytes, int] = {}
        each = [(c, p[i : i + 16], int.from_bytes(p[i + 16 : i + 24], "little", signed=True)) for c, p in zip(chunks, payloads) for i in range(0, len(p), 24)]
        for _, k, d in each:
            least[k] = min(d, least.get(k, d))
        back: dict[int, list] = {}
        for c, k, d in each:
            if least[k] != d:
                back.setdefault(c, []).append(k + least[k].to_bytes(8, "little", signed=True))
        for c, some in back.items():
            yield c, b"".join(some)

    def tokens(s, stands):
        """Sent keys of the standing documents: each distinct one, its number of sets, all of them in order with their documents, and where each begins."""
        v, doc = rule.keys(s, stands)
        order = np.argsort(v, kind="stable")
        v = v[order]
        g = groups(v)
        return v[g], np.diff(np.append(g, len(v))), v, doc[order], g

    def send_tokens(chunk, ids, texts, got):
        s = Sets(texts, words)
        reply = b"".join(got.values())
        yield -1 - chunk, reply  # comes back with the counts
        h, n, *_ = tokens(s, standing(s, ids, owners(s, ids, reply)))
        packed = (h & U(REST)).astype(np.uint32) | np.where(n > 1, SEVERAL, 0).astype(np.uint32)
        for b, i, j in parts(h, buckets):
            yield b, packed[i:j].tobytes() + n[i:j][n[i:j] > 1].astype(np.uint32).tobytes()

    def count(key, chunks, payloads):
        hashes, numbers = [], []
        for p in payloads:
            v = np.frombuffer(p, np.uint32)
            m = len(v)
            lo, hi = 0, m
            flags = np.cumsum(v >> np.uint32(31))
            while lo < hi:  # the entries are followed by a number for each flagged one
                mid = (lo + hi) // 2
                if mid + (int(flags[mid - 1]) if mid else 0) >= m:
                    hi = mid
                else:
                    lo = mid + 1
            e = v[:lo]
            n = np.ones(lo, np.int64)
            n[e >> np.uint32(31) > 0] = v[lo:]
            hashes.append(e & np.uint32(REST))
            numbers.append(n)
        e, n = np.concatenate(hashes), np.concatenate(numbers)
        order = np.argsort(e, kind="stable")
        g = groups(e[order])
        back = np.empty(len(e), np.int64)
        back[order] = np.repeat(np.add.reduceat(n[order], g), np.diff(np.append(g, len(e))))
        i = 0
        for c, p in zip(chunks, hashes):
            mine = back[i : i + len(p)]
            if (mine > 1).any():
                yield c, np.packbits(mine > 1).tobytes() + np.minimum(mine[mine > 1], (1 << 32) - 1).astype(np.uint32).tobytes()
            i += len(p)

    def look(s, chunk, ids, got):
        own = owners(s, ids, got.pop(-1 - chunk, b""))
        stands = standing(s, ids, own)
        h, _, value, doc, g = tokens(s, stands)
        df = np.ones(len(h), np.int64)
        for b, i, j in parts(h, buckets):
            if (reply := got.get(b)) is None:
                continue
            m = -(-(j - i) // 8)
            bits = np.unpackbits(np.frombuffer(reply, np.uint8, m), count=j - i).astype(bool)
            df[i:j][bits] = np.frombuffer(reply, np.uint32, -1, m)
        each = np.repeat(df, np.diff(np.append(g, len(value)))) if len(g) else df[:0]
        return own, stands, value, doc, each

    owned = meet(x.first(send_sets), own_sets)
    return x, meet(x.again(owned, send_tokens), count), look


def everyone(s, ids, own) -> bytes:
    """A note of all documents of a chunk, which `_all` reads."""
    who = np.array([-1 if i is None else i for i in ids], np.int64)
    none = np.array([i is None for i in ids], bool)
    owner = np.array([d if not n or o is None else o for d, o, n in zip(who.tolist(), own, s.n.tolist())], np.int64)
    return np.column_stack([who, s.n, none, owner]).astype(np.int64).tobytes()


def whole_sets(s, ids, which) -> bytes:
    """The sets of some of a chunk's documents, which `_sets` reads."""
    return b"".join(int(ids[i]).to_bytes(8, "little", signed=True) + int(s.n[i]).to_bytes(8, "little") + s.values[s.first[i] : s.first[i + 1]].tobytes() for i in which)


def owned_sets(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(doc_id, n_shingles, owner) of every row, owner being the least doc_id with the same set, the links (a, b) between owners,
    and the written tables that the links are read from."""
    rule = Rarest()
    x, counts, look = counted(docs, words, rule)
    buckets = x.buckets

    def send_blocks(chunk, ids, texts, got):
        s = Sets(texts, words)
        note = lambda kind: -1 - (chunk * 3 + kind)
        who = np.array([-1 if i is None else i for i in ids], np.int64)
        own, stands, value, doc, each = look(s, chunk, ids, got)
        yield note(ALL), everyone(s, ids, own)
        enough = np.bincount(doc, each > 1, minlength=len(ids)) >= rule.shared(s.n)
        stay = enough & stands
        # the rarest come first; linked sets have one of the first sent - shared + 1 in common
        by = np.lexsort((value, each, doc))
        doc, each, value = doc[by], each[by], value[by]
        start = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))])
        lead = (np.arange(len(doc)) - start[doc] < rule.leading(s.n)[doc]) & (each > 1) & stay[doc]
        doc, value = doc[lead], value[lead]
        by = np.lexsort((who[doc], value))
        doc, value = doc[by], value[by]
        g = groups(value)
        least = who[doc[g]] if len(g) else who[:0]
        star = np.column_stack([who[doc], np.repeat(least, np.diff(np.append(g, len(doc)))) if len(g) else least])
        star = np.unique(star[star[:, 0] != star[:, 1]], axis=0)
        yield note(STARS), star.tobytes()
        yield note(SETS), whole_sets(s, ids, np.unique(doc).tolist())
        v = value[g] if len(g) else value
        for b, i, j in parts(v, buckets):
            yield b, v[i:j].tobytes() + least[i:j].tobytes()

    def connect(key, chunks, payloads):
        v = np.concatenate([np.frombuffer(p, U, len(p) // 16) for p in payloads])
        d = np.concatenate([np.frombuffer(p, np.int64, len(p) // 16, len(p) // 2) for p in payloads])
        order = np.lexsort((d, v))
        v, d = v[order], d[order]
        g = groups(v)
        star = np.column_stack([d, np.repeat(d[g], np.diff(np.append(g, len(d))))])
        star = np.unique(star[star[:, 0] != star[:, 1]], axis=0)
        yield chunks[0], star.tobytes()

    notes = saved(x.again(counts, send_blocks))
    kind = F.pmod(-1 - F.col("key"), F.lit(3))
    of = lambda k: notes.where((F.col("key") < 0) & (kind == k)).select("payload")
    sets = of(SETS).mapInArrow(_sets, "doc_id long, n int, hashes binary")
    # only the shingles of the stars move again; the sets wait where they were written
    stars = of(STARS).union(meet(notes.where("key >= 0"), connect).select("payload"))
    blocks = components(stars.mapInArrow(_pairs, "a long, b long").distinct())
    every = saved(of(ALL).mapInArrow(_all, "doc_id long, n_shingles long, owner long"))
    links, read = _trees(sets, blocks, block, dual_join)
    return every, links, [notes, blocks, *read]


def _pairs(it):
    for b in it:
        for p in b.column(0).to_pylist():
            m = np.frombuffer(p, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(m[:, 0]), pa.array(m[:, 1])], names=["a", "b"])


def _all(it):
    for b in it:
        for p in b.column(0).to_pylist():
            m = np.frombuffer(p, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(m[:, 0], mask=m[:, 2] > 0), pa.array(m[:, 1]), pa.array(m[:, 3], mask=m[:, 2] > 0)], names=["doc_id", "n_shingles", "owner"])


def _sets(it):
    for b in it:
        for p in b.column(0).to_pylist():
            ids, sizes, hashes, at = [], [], [], 0
            while at < len(p):
                n = int.from_bytes(p[at + 8 : at + 16], "little")
                ids.append(int.from_bytes(p[at : at + 8], "little", signed=True))
                sizes.append(n)
                hashes.append(p[at + 16 : at + 16 + 8 * n])
                at += 16 + 8 * n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary())], names=["doc_id", "n", "hashes"])


def _trees(sets: DataFrame, blocks: DataFrame, block: int, join) -> tuple[DataFrame, list[DataFrame]]:
    """Links found in all blocks, and the tables written for them."""
    # the labels grow with the input: never broadcast, so that the plan is the same at every size
    placed = sets.join(blocks.select(F.col("node").alias("doc_id"), F.col("label").alias("block")).hint("merge"), "doc_id")
    # a row for each size of set in a block, with what comes before it in size order, in units of one tree
    share = F.greatest(F.sum(F.lit(1.0 / block)), F.sum(F.length("hashes") / F.lit(float(BYTES))))
    sizes = saved(placed.groupBy("block", "n").agg(share.alias("share"), F.sum(F.length("hashes")).alias("bytes")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bins = int(total // BYTES) + 1
    large = sizes.groupBy("block").agg(F.sum("share").alias("s")).where(F.col("s") > 1).select("block")
    small = placed.join(large, "block", "left_anti")
    alone = small.select(F.pmod(F.xxhash64("block"), F.lit(bins)).alias("task"), "block", F.lit(0).alias("side"), F.lit(True).alias("same"), "doc_id", "hashes")
    before = F.sum("share").over(Window.partitionBy("block").orderBy("n")) - F.col("share")
    # sizes that share a tree have its number; one that fills several gets them to itself, by hash
    cut = sizes.join(large, "block").withColumn("first", F.floor(before).cast("int"))
    cut = cut.withColumn("trees", F.greatest(F.floor(before + F.col("share")).cast("int") - F.col("first"), F.lit(1))).select("block", "n", "first", "trees")
    dealt = placed.join(cut, ["block", "n"]).withColumn("part", F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("trees")).cast("int"))
    # trees with their size ranges, and the pairs of them that may hold linked sets; a row a tree, not a set
    trees = cut.select("block", "n", F.explode(F.sequence("first", F.col("first") + F.col("trees") - 1)).alias("part")).groupBy("block", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = trees.select("block", F.col("part").alias("j"), F.col("low").alias("j_low"), F.col("high").alias("j_high"))
    near = trees.join(other, "block").where((F.col("part") <= F.col("j")) & (F.col("high") * DEN >= F.col("j_low") * NUM) & (F.col("j_high") * DEN >= F.col("low") * NUM))
    met = near.select("block", "part", "j")
    met = met.select("block", "part", F.col("part").alias("i"), "j", F.lit(0).alias("side")).union(met.where("part < j").select("block", F.col("j").alias("part"), F.col("part").alias("i"), "j", F.lit(1).alias("side")))
    pair = F.xxhash64("block", "i", "j")
    grid = dealt.join(met, ["block", "part"]).select(pair.alias("task"), pair.alias("block"), "side", (F.col("i") == F.col("j")).alias("same"), "doc_id", "hashes")

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t.column(k).to_pylist() for k in ("block", "side", "doc_id", "hashes", "same"))), key=lambda r: r[:3])
        a, b = [], []
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            part = rows[i:j]
            one = [(d, np.frombuffer(h, U)) for _, side, d, h, _ in part if not side]
            two = [(d, np.frombuffer(h, U)) for _, side, d, h, _ in part if side]
            for p, q in join(one, one if part[0][4] else two):
                a.append(p)
                b.append(q)
            i = j
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return alone.union(grid).groupBy("task").applyInArrow(run, "a long, b long"), [sizes]


class Tree:
    """A signature tree over sets in size order: nodes[level] are slices of LEAF * FAN**level sets."""

    def __init__(self, sets: list):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i][1]), sets[i][1][:1].tolist(), sets[i][0]))
        self.name = [sets[i][0] for i in order]
        self.size = np.array([len(sets[i][1]) for i in order], np.int64)
        self.bits = np.zeros((len(sets), BITS // 64), U)
        for row, i in enumerate(order):
            h = sets[i][1] % U(BITS)
            np.bitwise_or.at(self.bits[row], (h >> U(6)).astype(np.int64), U(1) << (h & U(63)))
        #: shingles beyond the set bits: what a bitmap's overlap can miss
        self.extra = self.size - np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.sets = [frozenset(sets[i][1].tolist()) for i in order]
        self.levels = []
        width, n = LEAF, len(sets)
        while True:
            at = np.arange(0, n, width)
            self.levels.append((np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.size, at), np.maximum.reduceat(self.size, at), np.maximum.reduceat(self.extra, at), width))
            if width >= n:
                break
            width *= FAN


def possible(overlap, least_a, least_b, most_a, most_b):
    """Whether sets of these sizes, with at most this overlap, can be similar enough."""
    overlap = np.minimum(overlap, np.minimum(most_a, most_b))
    return (overlap * (NUM + DEN) >= NUM * (least_a + least_b)) & (most_a * DEN >= least_b * NUM) & (most_b * DEN >= least_a * NUM)


def dual_join(one: list, two: list):
    """Links (name, name) between similar sets of two lists of (name, hashes), or within one list."""
    if not one or not two or one is two and len(one) < 2:
        return
    a = Tree(one)
    b = a if two is one else Tree(two)
    parent: dict = {}

    def root(v):
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = p
        return v

    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        p, i, q, j = stack.pop()
        x, y = a.levels[p], b.levels[q]
        if (p, i, q, j) and not possible(int(np.bitwise_count(x[0][i] & y[0][j]).sum()) + min(x[3][i], y[3][j]), x[1][i], y[1][j], x[2][i], y[2][j]):
            continue
        if p or q:  # open the higher node, both where they are level
            left = [(p - 1, k) for k in range(i * FAN, min((i + 1) * FAN, len(a.levels[p - 1][1])))] if p and p >= q else [(p, i)]
            right = [(q - 1, k) for k in range(j * FAN, min((j + 1) * FAN, len(b.levels[q - 1][1])))] if q and q >= p else [(q, j)]
            stack += [(*u, *v) for u in left for v in right if a is not b or u[1] * a.levels[u[0]][4] <= v[1] * b.levels[v[0]][4]]
            continue
        us, vs = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        overlap = np.bitwise_count(a.bits[us][:, None] & b.bits[vs][None]).sum(axis=2, dtype=np.int64) + np.minimum(a.extra[us][:, None], b.extra[vs][None])
        su, sv = a.size[us][:, None], b.size[vs][None]
        for u, v in np.argwhere(possible(overlap, su, sv, su, sv)).tolist():
            u, v = u + i * LEAF, v + j * LEAF
            if a is b and u >= v:
                continue
            m, n = root(a.name[u]), root(b.name[v])
            if m != n:
                both = len(a.sets[u] & b.sets[v])
                if DEN * both >= NUM * (len(a.sets[u]) + len(b.sets[v]) - both):
                    parent[max(m, n)] = min(m, n)
                    yield a.name[u], b.name[v]


def labelled(every: DataFrame, links: DataFrame, read: list[DataFrame]) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row; what the links are read from goes."""
    labels = components(links)
    discard(*read)
    least = labels.groupBy("label").agg(F.min("node").alias("component_id"))
    of = labels.join(least, "label").select(F.col("node").alias("owner"), "component_id")
    # an owner is the least of its copies, so the least owner is the least of all
    return every.join(of, "owner", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "owner").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of every row."""
    return labelled(*owned_sets(docs, words))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
#: All windows by brute force; for small tables.
ORACLE_SQL = {
    "op7_jaccard_join": r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM d WHERE len(l) > 0),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(l[i:i + 4], ' ')) AS h FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
t(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, c FROM t JOIN e ON e.x = t.doc_id)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM t LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""",
}
