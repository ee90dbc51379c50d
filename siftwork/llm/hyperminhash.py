"""Components of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, by HyperMinHash.

1. Copies. Equal sets are found by their 128-bit hashes; the one of the least doc_id stands for all.
2. Sketches. The shingles of a set are dealt to REGISTERS buckets by their hash. A register keeps of the least
   hash of its bucket the number of leading zeros and the MANTISSA bits after the first one: 16 bits instead
   of 64, which follow sets of any size.
3. Bands. Each ROWS registers are a band, whose hash goes to a bucket of the hash space and comes back with the number of
   sets that have it. Shared ones go there again, with BRIEF of the set's registers cut to a byte.
4. Blocks. Sets with a common band are connected if the estimate from those bytes is within SIGMAS standard deviations of the
   similarity; what is connected is written as a star, never as pairs, and makes blocks. Without estimates,
   chains of passages that documents share would join most of a corpus to one block. A band of more than PART
   sets is dealt to parts, and each two of them meet in a task of their own.
5. Estimates. Within a block, sets with a common band are compared by all their registers. Registers of unequal least
   hashes agree by chance; that number follows from the sets' sizes and is taken off. A pair whose
   estimate is more than SIGMAS standard deviations below the similarity is dropped.
6. Verification. What is left is compared on the full sets. In a dense group the set that agrees most with all
   registers comes first, and sets connected already are not compared again.

A pair of similarity 0.8 lacks a common band with a probability of (1 - 0.8**ROWS)**BANDS = 4e-9 (2e-17 at 0.85); sets
of few shingles leave registers empty, and at five of them the probability is 6e-8. An estimate drops such a
pair with a probability of 1e-9. Links are never wrong.

Defined cases: null text and text without words have no shingles, n_shingles 0 and their own component;
fewer words than `words` make one shingle of all of them. Rows of equal doc_id share a component;
a null doc_id keeps its row, with a null component and null `kept`. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import groups, meet, parts
from .common import table
from .components import components
from .hashing import U, after, mix
from .jaccard import BLOCK, DEN, NUM, Sets, _all, _pairs, _sets, _trees, counted, everyone, labelled, whole_sets
from .storage import saved

WORDS, BANDS, ROWS, MANTISSA, SIGMAS = 4, 64, 6, 10, 6.0
REGISTERS, BRIEF, PART = BANDS * ROWS, 192, 2_048
PRECISION = 40  # bits of a hash that registers are made from
EMPTY = (1 << 16) - 1
TOGETHER = 1 << 14  # sets sketched together


def registers(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS: the sketches of sets 0 to n - 1, given their shingles' hashes and whose they are (at most TOGETHER sets)."""
    bucket = (mix(values) >> U(32)) * U(REGISTERS) >> U(32)
    both = ((owner.astype(U) * U(REGISTERS) + bucket) << U(PRECISION)) | (mix(values ^ U(0xD6E8FEB86659FD93)) >> U(64 - PRECISION))
    both.sort()
    place = both >> U(PRECISION)
    first = groups(place)
    least = (both[first] & U((1 << PRECISION) - 1)).astype(np.int64)
    size = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits from the first one on
    mantissa = np.where(size > MANTISSA, least >> np.maximum(size - MANTISSA - 1, 0), least << np.maximum(MANTISSA + 1 - size, 0)) & ((1 << MANTISSA) - 1)
    out = np.full(n * REGISTERS, EMPTY, np.uint16)
    out[place[first].astype(np.int64)] = ((PRECISION - size) << MANTISSA | mantissa).astype(np.uint16)
    return out.reshape(n, REGISTERS)


def bands(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x BANDS: hash of each band, and whether it has a register that is not empty."""
    r = regs.reshape(len(regs), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), r.shape[:2])
    for k in range(ROWS):
        out = after(out, r[:, :, k].astype(U))
    return out, (r != EMPTY).any(axis=2)


#: What a set sends to a shared band: the band, its id and size, and its first registers, 0 where empty.
ENTRY = np.dtype([("band", "<u8"), ("id", "<i8"), ("n", "<u4"), ("brief", "u1", (BRIEF,))])
COUNTED = 255


def brief(regs: np.ndarray) -> np.ndarray:
    r = regs[:, :BRIEF]
    return np.where(r == EMPTY, 0, 1 + r % COUNTED).astype(np.uint8)


def sketched(s, which: np.ndarray):
    """Batches of a chunk's documents (their numbers) with their registers."""
    for i in range(0, len(which), TOGETHER):
        some = which[i : i + TOGETHER]
        local = np.full(len(s.n), -1, np.int64)
        local[some] = np.arange(len(some))
        own = local[s.doc]
        of = np.flatnonzero(own >= 0)
        yield some, registers(s.values[of], own[of], len(some))


class Banded:
    """Rule by which sets meet (see jaccard.Rarest): any common band."""

    def keys(self, s, stands):
        values, docs = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for some, regs in sketched(s, np.flatnonzero(stands)):
            h, filled = bands(regs)
            values.append(h[filled])
            docs.append(np.repeat(some, filled.sum(axis=1)))
        return np.concatenate(values), np.concatenate(docs)


def near(n: np.ndarray, one: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and brief registers may be similar enough."""
    used = (one > 0) | (other > 0)
    k = used.sum(axis=-1)
    agree = ((one == other) & used).sum(axis=-1) / np.maximum(k, 1)
    j = (agree - 1 / COUNTED) / (1 - 1 / COUNTED)
    n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
    # sets without any of the brief registers tell nothing
    return (n * DEN >= m * NUM) & (m * DEN >= n * NUM) & ((k == 0) | (j + SIGMAS * np.sqrt(NUM * (DEN - NUM) / DEN**2 / np.maximum(k, 1)) >= NUM / DEN))


def stars(e: np.ndarray) -> np.ndarray:
    """Of entries in the order of their bands, for each the number of the entry that its connected ones meet at; -1 if it is connected with none."""
    out = np.full(len(e), -1, np.int64)
    g = groups(e["band"])
    size = np.diff(np.append(g, len(e)))
    two = g[size == 2]
    step = 1 << 14
    for i in range(0, len(two), step):
        a = two[i : i + step]
        ok = a[near(e["n"][a], e["brief"][a], e["n"][a + 1], e["brief"][a + 1])]
        out[ok] = out[ok + 1] = ok
    for a, n in zip(g[size > 2].tolist(), size[size > 2].tolist()):
        left = np.arange(a, a + n)
        while len(left) > 1:
            head, left = int(left[0]), left[1:]
            todo = [head]
            while todo and len(left):
                u = todo.pop()
                ok = near(e["n"][left], e["brief"][left], e["n"][u], e["brief"][u])
                some = left[ok]
                if len(some):
                    out[head] = out[some] = head
                    todo += some.tolist()
                    left = left[~ok]
    return out


def link(key, chunks, payloads):
    """A meeting of entries: to each chunk (id, id of the star's centre) of its connected sets."""
    e = np.concatenate([np.frombuffer(p, ENTRY) for p in payloads])
    chunk = np.repeat(np.array(chunks, np.int64), [len(p) // ENTRY.itemsize for p in payloads])
    order = np.lexsort((e["id"], e["band"]))
    e, chunk = e[order], chunk[order]
    to = stars(e)
    found = np.flatnonzero(to >= 0)
    pairs, chunk = np.column_stack([e["id"][found], e["id"][to[found]]]), chunk[found]
    by = np.argsort(chunk, kind="stable")
    g = groups(chunk[by])
    for a, z in zip(g.tolist(), [*g[1:].tolist(), len(by)]):
        yield int(chunk[by[a]]), np.unique(pairs[by[a:z]], axis=0).astype("<i8").tobytes()


def owned_sets(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(doc_id, n_shingles, owner) of every row, owner being the least doc_id with the same set, the links (a, b) between owners,
    and the written tables that the links are read from."""
    x, counts, look = counted(docs, words, Banded())
    buckets = x.buckets

    def send_bands(chunk, ids, texts, got):
        s = Sets(texts, words)
        own, stands, value, doc, each = look(s, chunk, ids, got)
        yield -1 - chunk, everyone(s, ids, own)
        keep = each > 1
        value, doc, each = value[keep], doc[keep], each[keep]
        short = np.zeros((len(ids), BRIEF), np.uint8)
        for some, regs in sketched(s, np.unique(doc)):
            short[some] = brief(regs)
        e = np.zeros(len(value), ENTRY)
        e["band"], e["id"], e["n"], e["brief"] = value, [ids[i] for i in doc.tolist()], s.n[doc], short[doc]
        small = each <= 2 * PART
        rest = e[small]  # values ascend
        for b, i, j in parts(rest["band"], buckets):
            yield b, rest[i:j].tobytes()
        hot: dict[int, list] = {}
        for i in np.flatnonzero(~small).tolist():  # each two parts of a hot band meet
            n = int(-(-each[i] // PART))
            own_part = int(mix(e["id"][i : i + 1].astype(U))[0] % U(n))
            for other in range(n):
                if other != own_part:
                    pair = min(own_part, other) * n + max(own_part, other)
                    hot.setdefault(buckets + int(mix(value[i : i + 1] + U(pair))[0] >> U(16)), []).append(i)
        for k, some in hot.items():
            yield k, e[some].tobytes()

    def send_found(chunk, ids, texts, got):
        yield -1 - 2 * chunk, got.pop(-1 - chunk)
        if not got:
            return
        star = np.unique(np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in got.values()]), axis=0)
        s = Sets(texts, words)
        found = set(star[:, 0].tolist())
        which = [i for i in np.unique(s.model).tolist() if ids[i] in found and s.n[i]]
        yield -2 - 2 * chunk, star[star[:, 0] != star[:, 1]].tobytes()
        yield 0, whole_sets(s, ids, which)

    notes = saved(x.again(meet(x.again(counts, send_bands), link), send_found))
    of = lambda where: notes.where(where).select("payload")
    blocks = components(of("key < 0 AND key % 2 = 0").mapInArrow(_pairs, "a long, b long").distinct())
    sets = of("key >= 0").mapInArrow(_sets, "doc_id long, n int, hashes binary")
    every = saved(of("key < 0 AND key % 2 <> 0").mapInArrow(_all, "doc_id long, n_shingles long, owner long"))
    links, read = _trees(sets, blocks, block, sketch_join)
    return every, links, [notes, blocks, *read]


@functools.lru_cache(maxsize=4096)
def _by_chance(m: int, n: int) -> float:
    """Expected share of registers that agree although their least hashes differ, for disjoint sets of 2**(m/4) and 2**(n/4) shingles."""
    edge = 2.0 ** -np.arange(PRECISION + 1)[:, None] * (1 - np.arange((1 << MANTISSA) + 1)[None] / (2 << MANTISSA))  # upper ends of cells, descending
    none = lambda k: np.exp(-(2.0 ** (k / 4)) / REGISTERS * edge)  # noqa: E731  chance that a bucket has no hash below
    a, b = none(m), none(n)
    return float(((a[:, 1:] - a[:, :-1]) * (b[:, 1:] - b[:, :-1])).sum())


def by_chance(m: np.ndarray, n: int) -> np.ndarray:
    level = lambda x: np.round(4 * np.log2(x)).astype(np.int64)
    own, at = np.unique(level(m), return_inverse=True)
    return np.array([_by_chance(int(k), int(level(np.array([n]))[0])) for k in own])[at]


def estimates(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of a sketch to others, corrected for agreement by chance, and the number of registers that it rests on."""
    used = (others != EMPTY) | (one != EMPTY)
    n = used.sum(axis=1)
    agree = ((others == one) & used).sum(axis=1)
    chance = REGISTERS * by_chance(sizes, size)
    return (agree - chance) / np.maximum(n - chance, 1e-9), n


def sketch_join(one: list, two: list):
    """Links (name, name) between similar sets of two lists of (name, hashes), or within one list: enough of them to connect what is linked."""
    if not one or not two or one is two and len(one) < 2:
        return
    sets = one if one is two else one + two
    side = np.zeros(len(sets), bool)
    side[len(one) :] = True
    size = np.array([len(h) for _, h in sets], np.int64)
    values, owner = np.concatenate([h for _, h in sets]), np.repeat(np.arange(len(sets)), size)
    first = np.concatenate([[0], np.cumsum(size)])
    regs = np.concatenate([registers(values[first[i] : first[j]], owner[first[i] : first[j]] - i, j - i) for i in range(0, len(sets), TOGETHER) for j in [min(i + TOGETHER, len(sets))]])
    key, filled = bands(regs)
    full: dict[int, frozenset] = {}
    label = np.arange(len(sets))

    def whole(i):
        if i not in full:
            full[i] = frozenset(sets[i][1].tolist())
        return full[i]

    for k in range(BANDS):
        have = np.flatnonzero(filled[:, k])
        have = have[np.argsort(key[have, k], kind="stable")]
        edges = groups(key[have, k])
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(have)]):
            if z - a < 2:
                continue
            m = have[a:z]
            if (label[m] == label[m[0]]).all() or one is not two and (side[m] == side[m[0]]).all():
                continue
            if len(m) > 2:  # what agrees most with all comes first
                usual = np.sort(regs[m], axis=0)[len(m) // 2]  # what more than half of them have, if any value is so frequent
                m = m[np.argsort(-(regs[m] == usual).sum(axis=1), kind="stable")]
            for i, u in enumerate(m[:-1].tolist()):
                v = m[i + 1 :]
                v = v[(label[v] != label[u]) & (size[v] * DEN >= size[u] * NUM) & (size[u] * DEN >= size[v] * NUM)]
                if one is not two:
                    v = v[side[v] != side[u]]
                if k and len(v):  # not those that met in an earlier band
                    v = v[~((key[v, :k] == key[u, :k]) & filled[u, :k]).any(axis=1)]
                if not len(v):
                    continue
                j, n = estimates(regs[u], int(size[u]), regs[v], size[v])
                good = j + SIGMAS * np.sqrt(NUM * (DEN - NUM) / DEN**2 / n) >= NUM / DEN
                for w in v[good][np.argsort(-j[good], kind="stable")].tolist():
                    if label[w] == label[u]:
                        continue
                    both = len(whole(u) & whole(w))
                    if DEN * both >= NUM * (size[u] + size[w] - both):
                        label[label == label[w]] = label[u]
                        yield sets[u][0], sets[w][0]


def deduplicated(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept of every row."""
    return labelled(*owned_sets(docs, words, block)).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op11_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


QUERIES = {"op11_hyperminhash_dedup": op11_hyperminhash_dedup}
#: All shingles by brute force; for small tables.
ORACLE_SQL = {
    "op11_hyperminhash_dedup": r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM d WHERE len(l) > 0),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(l[i:i + 3], ' ')) AS h FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
t(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT y, c FROM t JOIN e ON e.x = t.doc_id)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, t.doc_id = min(c) AS kept FROM t LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""",
}
