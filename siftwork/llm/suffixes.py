"""Removal of repeated byte strings through a logarithmic family of suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere else too; with `first`, only if that
string also starts earlier (in a document of smaller id, or earlier in the same one), so that one place keeps it.
Repeats of other lengths can be measured by the way (`also`).

1. Every window of LENGTH bytes is represented by an anchor, the leftmost of its GRAM-byte substrings
   with the least hash: equal windows have equal anchors at equal offsets. An anchor stands for a run
   of neighbouring windows, so a document has about one anchor in LENGTH - GRAM bytes.
2. Anchors whose whole neighbourhood (all bytes of its windows) occurs twice settle their windows at
   once; those whose gram occurs once have no repeat. Both need only hashes, counted by bucket.
3. The rest, at the ends of repeats, become suffixes: in each bucket of the gram's hash, batches of
   them get a suffix array (the texts right of the anchor in order, and the reversed texts left of
   it), are merge-scanned against the existing levels, and levels of equal size merge, so that level
   sizes double (class Family). Two windows that hold their anchor at offset o are equal if the right
   texts agree in LENGTH - o bytes and the left ones in o; both are runs between low places of the
   arrays' common-prefix lengths.
4. An anchor with more than HOT different neighbourhoods would make a bucket's array unbounded; its
   windows are counted by their own hashes instead, each once a chunk.

Defined cases: null text is empty, and an empty or short text (below LENGTH bytes) loses nothing unless
repeated itself at LENGTH bytes or more; matches never cross documents; overlaps with itself count.
Rows with equal or null doc_id are separate documents; with `first`, null ids come last, and of equal ids the
one in the lower chunk, then of the lesser text, is the earlier. A cut may end inside a character: as text, its
bytes go. Columns other than doc_id, text and those carried along are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Exchange, groups, meet, numbers, parts
from .common import table
from .hashing import BYTE, U, prefix, spans

LENGTH, PASSAGE, GRAM, HOT, BATCH = 400, 250, 100, 2_000, 2_048
SEGMENT, PLACE = 1 << 19, U((1 << 20) - 1)
NONE, EDGE, WHOLE, HOTLY, MODEL, HOTMODEL = range(6)
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.int64())), ("kept_text", pa.string()), ("n_repeated", pa.list_(pa.int64()))])


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[p:p+w]) for each p."""
    n = len(v)
    m = -(-n // w) * w
    u = np.full(m, np.iinfo(np.uint64).max, U)
    u[:n] = v
    u = u.reshape(-1, w)
    right = np.minimum.accumulate(u, axis=1).ravel()
    left = np.minimum.accumulate(u[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1 : n])


class Anchors:
    """Of a chunk's documents: place x of each anchor, its first and last window a and z, and its hashes."""

    def __init__(self, buf: bytes, begin: np.ndarray, length: int, gram: int, least: np.ndarray):
        self.buf, self.begin, self.length = buf, begin, length
        n = len(least)
        end = np.zeros(n, bool)  # windows that run over their document's end
        for e in begin[1:-1].tolist():
            end[max(0, e - length + 1) : e] = True
        least[end] = -1
        # a run also ends where a document begins
        first = np.union1d(groups(least), begin[:-1][begin[:-1] < n]) if n else np.zeros(0, np.int64)
        last = np.append(first[1:], n) - 1
        ok = least[first] >= 0
        self.a, self.z = first[ok], last[ok]
        self.x = least[self.a].astype(np.int64)
        digest = xxhash.xxh3_64_intdigest
        self.gram = np.array([digest(buf[x : x + gram]) for x in self.x.tolist()], U)
        self.near = np.array([digest(buf[a : z + length], x - a) for a, z, x in zip(self.a.tolist(), self.z.tolist(), self.x.tolist())], U) & ~U(1)

    @staticmethod
    def of(texts: list, lengths: list[int], gram: int) -> list["Anchors"]:
        """The anchors for each length; the grams' hashes are made once."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        buf = b"".join(raw)
        begin = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        b, widest = np.frombuffer(buf, np.uint8), max(lengths)
        least = [np.zeros(max(len(b) - k + 1, 0), np.int32 if len(b) < 1 << 31 else np.int64) for k in lengths]
        for i in range(0, max(map(len, least)), SEGMENT):
            part = b[i : i + SEGMENT + widest - 1]
            at = np.arange(len(part) - gram + 1)
            h = (spans(prefix(BYTE[part]), at, at + gram) & ~PLACE) | at.astype(U)
            for k, out in zip(lengths, least):
                m = min(SEGMENT, len(out) - i)
                if m > 0:
                    w = k - gram + 1
                    out[i : i + m] = (sliding_least(h[: m + w - 1], w) & PLACE).astype(out.dtype) + out.dtype.type(i)
        return [Anchors(buf, begin, k, gram, out) for k, out in zip(lengths, least)]

    def owner(self, ids: list) -> np.ndarray:
        """The number of each anchor's document; null ids come last."""
        return numbers(ids)[np.searchsorted(self.begin, self.x, side="right") - 1] if len(self.x) else np.zeros(0, np.int64)

    def distinct(self):
        """Each distinct (gram, neighbourhood) once, in order: first anchor that has it; whether it comes again."""
        order = np.lexsort((self.near, self.gram))
        g, e = self.gram[order], self.near[order]
        at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (e[1:] != e[:-1])])) if len(g) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(order)))
        first = np.minimum.reduceat(order, at) if len(at) else at
        kind = np.zeros(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(at)), n)
        return g[at], e[at], n > 1, first, kind


class Level:
    """A suffix array: records in the order of the texts right of their anchors, and of the reversed left ones."""

    def __init__(self, right: list, left: list, low: np.ndarray, high: np.ndarray, name: np.ndarray):
        self.right, self.left, self.low, self.high, self.name = right, left, low, high, name
        self.by_right = np.array(sorted(range(len(right)), key=right.__getitem__), np.int64)
        self.by_left = np.array(sorted(range(len(left)), key=left.__getitem__), np.int64)

    def __len__(self) -> int:
        return len(self.right)

    def merged(self, other: "Level") -> "Level":
        out = Level.__new__(Level)
        out.right, out.left = self.right + other.right, self.left + other.left
        out.low, out.high, out.name = (np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("low", "high", "name"))
        for k, keys in (("by_right", out.right), ("by_left", out.left)):
            both = getattr(self, k).tolist() + (getattr(other, k) + len(self)).tolist()
            both.sort(key=keys.__getitem__)  # two ascending runs: a linear merge
            setattr(out, k, np.array(both, np.int64))
        return out


def common(keys: list, order: np.ndarray) -> np.ndarray:
    """Common-prefix length of each key with the one before it in order."""
    n = len(keys)
    sizes = np.array([len(k) for k in keys], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(keys), np.uint8)
    out = np.zeros(n, np.int64)
    step = 2_048
    for i in range(1, n, step):
        p, q = order[i - 1 : min(n, i + step) - 1], order[i : min(n, i + step)]
        size = np.minimum(sizes[p], sizes[q])
        width = int(size.max(initial=0))
        col = np.arange(width)
        inside = col < size[:, None]
        same = flat[np.where(inside, starts[p][:, None] + col, 0)] == flat[np.where(inside, starts[q][:, None] + col, 0)]
        out[i : i + len(q)] = np.where((~same | ~inside).any(axis=1), (~same | ~inside).argmax(axis=1), width)
    return out


class Family:
    """Levels of suffix arrays whose sizes double. add() gives, by record name, the offsets found repeated.

    With `first`, those found in a record of a lesser name."""

    def __init__(self, length: int, batch: int = BATCH, first: bool = False):
        self.length, self.batch, self.levels, self.first = length, batch, [], first
        self.found: dict[int, np.ndarray] = {}

    def add(self, new: Level) -> None:
        self.scan(new)
        for level in self.levels:
            self.scan(level.merged(new))
        while self.levels and len(self.levels[-1]) <= len(new):
            new = self.levels.pop().merged(new)
        self.levels.append(new)

    def scan(self, both: Level) -> None:
        """Marks every window equal to one of another record: same run of the right order and of the left."""
        n = len(both)
        if n < 2:
            return
        right, left = common(both.right, both.by_right), common(both.left, both.by_left)
        rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
        rank_r[both.by_right], rank_l[both.by_left] = np.arange(n), np.arange(n)
        lowest, highest = int(both.low.min()), int(both.high.max())
        seen = np.zeros((n, highest - lowest + 1), bool)
        for o in range(lowest, highest + 1):
            live = np.flatnonzero((both.low <= o) & (o <= both.high))
            if len(live) < 2:
                continue
            r = np.cumsum(right < 8 + self.length - o)[rank_r[live]]
            q = np.cumsum(left < 8 + o)[rank_l[live]]
            key = r * (n + 1) + q
            order = np.lexsort((both.name[live], key)) if self.first else np.argsort(key)
            s = key[order]
            same = np.concatenate([[False], s[1:] == s[:-1]])
            if not self.first:
                same[:-1] |= same[1:]
            seen[live[order[same]], o - lowest] = True
        for i in np.flatnonzero(seen.any(axis=1)).tolist():
            name = int(both.name[i])
            a, z = both.low[i] - lowest, both.high[i] - lowest + 1
            self.found[name] = seen[i, a:z] | self.found.get(name, False)


class Search:
    """The steps that find the repeated strings of one length; keys of buckets run from 0 to 2 * buckets."""

    def __init__(self, length: int, hot: int, first: bool, buckets: int):
        self.length, self.hot, self.first, self.buckets = length, hot, first, buckets

    def send_hashes(self, t, ids):
        g, e, again, at, _ = t.distinct()
        who = t.owner(ids)[at]
        for b, i, j in parts(g, self.buckets):
            yield b, g[i:j].tobytes() + (e[i:j] | again[i:j].astype(U)).tobytes() + (who[i:j].tobytes() if self.first else b"")

    def sort_out(self, chunks, payloads):
        hot, first = self.hot, self.first
        size = 24 if first else 16
        sizes = [len(p) // size for p in payloads]
        g = np.concatenate([np.frombuffer(p, U, n) for p, n in zip(payloads, sizes)])
        e = np.concatenate([np.frombuffer(p, U, n, 8 * n) for p, n in zip(payloads, sizes)])
        who = np.concatenate([np.frombuffer(p, np.int64, n, 16 * n) for p, n in zip(payloads, sizes)]) if first else np.zeros(len(g), np.int64)
        order = np.lexsort((who, e & ~U(1), g))  # the order of chunks decides between equal ids
        gs, es, again = g[order], (e & ~U(1))[order], (e & U(1))[order] > 0
        new_gram = np.concatenate([[True], gs[1:] != gs[:-1]])
        new = new_gram | np.concatenate([[True], es[1:] != es[:-1]])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(order)))
        twice = (n > 1) | np.logical_or.reduceat(again, at)
        of = np.cumsum(new_gram[at]) - 1  # gram of each distinct pair
        kinds = np.bincount(of)[of]
        edges = np.bincount(of, ~twice)[of]
        part = np.where(kinds > hot, HOTLY, np.where(kinds > 1, EDGE, NONE))
        code = np.where(twice, WHOLE, part)
        if first:  # the earliest place of a neighbourhood keeps what no other neighbourhood has earlier
            model = part
        else:  # the first chunk that has a repeated neighbourhood shows it to the others
            model = np.where(twice & (edges > 0), np.where(kinds > hot, HOTMODEL, MODEL), code)
        each = np.repeat(code, n)
        each[at] = model
        back = np.empty(len(order), np.uint8)
        back[order] = each
        i = 0
        for c, m in zip(chunks, sizes):
            if (mine := back[i : i + m]).any():
                yield c, mine.tobytes()
            i += m

    def codes_of(self, g, got):
        codes = np.zeros(len(g), np.uint8)
        for b, i, j in parts(g, self.buckets):
            if b in got:
                codes[i:j] = np.frombuffer(got[b], np.uint8)
        return codes

    def windows(self, t, kinds, at):
        """All windows of the anchors that at[kinds] names: two hashes and place."""
        p = np.concatenate([np.arange(t.a[i], t.z[i] + 1) for i in at[kinds]]) if len(kinds) else np.zeros(0, np.int64)
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.buf[i : i + self.length]) for i in p.tolist()), U).reshape(-1, 2)
        return h, p

    def hot_windows(self, t, codes, at, ids):
        """Of the windows of hot anchors, each distinct one: hashes, whether again, owner of the first place; and all places with their number."""
        h, p = self.windows(t, np.flatnonzero((codes == HOTLY) | (codes == HOTMODEL)), at)
        order = np.lexsort((p, h[:, 1], h[:, 0]))
        h, p = h[order], p[order]
        new = np.ones(len(p), bool)
        new[1:] = (h[1:] != h[:-1]).any(axis=1)
        g = np.flatnonzero(new)
        n = np.diff(np.append(g, len(p)))
        who = numbers(ids)[np.searchsorted(t.begin, p[g], side="right") - 1] if len(g) else np.zeros(0, np.int64)
        return h[g], n > 1, who, p, np.cumsum(new) - 1, new

    def send_edges(self, t, ids, got):
        length = self.length
        g, _, _, at, kind = t.distinct()
        codes = self.codes_of(g, got)
        who = t.owner(ids)
        whole = np.isin(codes, (WHOLE, MODEL, HOTMODEL))[kind] if len(kind) else np.zeros(0, bool)
        if self.first and len(kind):  # later places of a neighbourhood in this chunk
            whole |= np.arange(len(kind)) != at[kind]
        kinds = np.flatnonzero((codes == EDGE) | (codes == MODEL))
        edges = []
        for b, i, j in parts(g[kinds], self.buckets):
            out = []
            for k in kinds[i:j].tolist():
                i = at[k]
                out.append(struct.pack("<QqqHHH", int(g[k]), int(who[i]), t.x[i], t.x[i] - t.a[i], t.z[i] - t.a[i], t.z[i] + length - t.a[i]) + t.buf[t.a[i] : t.z[i] + length])
                edges.append((b, t.a[i], t.z[i]))
            yield b, b"".join(out)
        h, again, own, p, of, new = self.hot_windows(t, codes, at, ids)
        hot = []
        for b, i, j in parts(h[:, 0], self.buckets):
            yield self.buckets + b, h[i:j].tobytes() + own[i:j].tobytes() + again[i:j].tobytes()
            hot.append((b, i, j))
        # a note to the chunk itself: all that the last visit has to know of the anchors
        yield -1, pickle.dumps((union(t.a[whole], t.z[whole] + length), np.array(edges, np.int64).reshape(-1, 3), hot, p, of, new))

    def match(self, key, chunks, payloads):
        first = self.first
        if key >= self.buckets:
            sizes = [len(p) // 25 for p in payloads]
            h = np.concatenate([np.frombuffer(p, U, 2 * n).reshape(-1, 2) for p, n in zip(payloads, sizes)])
            own = np.concatenate([np.frombuffer(p, np.int64, n, 16 * n) for p, n in zip(payloads, sizes)])
            again = np.concatenate([np.frombuffer(p, bool, n, 24 * n) for p, n in zip(payloads, sizes)])
            order = np.lexsort((own, h[:, 1], h[:, 0]))
            new = np.ones(len(order), bool)
            new[1:] = (h[order[1:]] != h[order[:-1]]).any(axis=1)
            g = np.flatnonzero(new)
            n = np.diff(np.append(g, len(order)))
            gone = np.empty(len(order), bool)
            gone[order] = ~new if first else np.repeat((n > 1) | np.logical_or.reduceat(again[order], g), n)
            i = 0
            for c, m in zip(chunks, sizes):
                yield c, np.packbits(gone[i : i + m]).tobytes()
                i += m
            return
        records, sent = [], []
        for k, p in enumerate(payloads):
            at = 0
            sent.append(len(records))
            while at < len(p):
                h, who, place, off, more, size = struct.unpack_from("<QqqHHH", p, at)
                records.append((who, k, place, h, off, more, at + 30, size))
                at += 30 + size
        sent.append(len(records))
        # names go by owner, chunk and place, so that of two records the earlier has the lesser one
        name = np.empty(len(records), np.int64)
        name[sorted(range(len(records)), key=lambda i: records[i][:3])] = np.arange(len(records))
        family, batch = Family(self.length, first=first), []
        for (who, k, _, h, off, more, at, size), i in zip(records, name.tolist()):
            body, top = payloads[k][at : at + size], struct.pack(">Q", h)
            batch.append((top + body[off:], top + body[:off][::-1], off - more, off, i))
            if len(batch) >= BATCH:
                family.add(level(batch))
                batch = []
        if batch:
            family.add(level(batch))
        for c, i, j in zip(chunks, sent, sent[1:]):
            out = [family.found.get(k, np.zeros(records[m][5] + 1, bool)) for m, k in zip(range(i, j), name[i:j].tolist())]
            if out:
                yield c, np.concatenate(out).tobytes()

    def gone(self, size: int, got) -> np.ndarray:
        """Whether each byte of a chunk of so many goes."""
        cover = np.zeros(size + 1, np.int32)
        (begin, end), edges, hot, p, of, new = pickle.loads(got[-1])
        np.add.at(cover, begin, 1)
        np.add.at(cover, end, -1)
        dup = []
        for b in np.unique(edges[:, 0]).tolist():
            if b in got:
                marks, m = np.frombuffer(got[b], bool), 0
                for _, a, z in edges[edges[:, 0] == b].tolist():
                    dup.append(z - np.flatnonzero(marks[m : m + z - a + 1]))  # marks go by offset of the anchor: low first
                    m += z - a + 1
        if hot:
            gone = np.zeros(hot[-1][2], bool)
            for b, i, j in hot:
                if self.buckets + b in got:
                    gone[i:j] = np.unpackbits(np.frombuffer(got[self.buckets + b], np.uint8), count=j - i).astype(bool)
            dup.append(p[gone[of] | (~new if self.first else False)])
        for q in dup:
            np.add.at(cover, q, 1)
            np.add.at(cover, q + self.length, -1)
        return np.cumsum(cover[:-1], out=cover[:-1]) > 0


def union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs that intervals with ascending begins cover."""
    if not len(begin):
        return begin, end
    far = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > far[:-1]])
    return begin[new], np.append(far[:-1][new[1:]], far[-1])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: bool = True, first: bool = False, carry: tuple = (), also: tuple = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), spans (start, end, start, ...), kept_text, and the columns `carry` of docs.

    also: lengths whose repeated strings are only measured: n_repeated has, for each, the bytes that they cover."""
    x = Exchange(docs, carry=carry)
    lengths = [length, *also]
    searches = [Search(k, hot, first, x.buckets) for k in lengths]
    span = 2 * x.buckets

    def answers(got) -> list[dict]:
        """The answers to each search."""
        own: list[dict] = [{} for _ in searches]
        for k, p in got.items():
            if k < 0:
                own[(-1 - k) % len(searches)][-1] = p
            else:
                own[k // span][k % span] = p
        return own

    def send_hashes(chunk, ids, texts):
        for n, (s, t) in enumerate(zip(searches, Anchors.of(texts, lengths, gram))):
            for b, p in s.send_hashes(t, ids):
                yield n * span + b, p

    def sort_out(key, chunks, payloads):
        return searches[key // span].sort_out(chunks, payloads)

    def send_edges(chunk, ids, texts, got):
        for n, (s, t, own) in enumerate(zip(searches, Anchors.of(texts, lengths, gram), answers(got))):
            for b, p in s.send_edges(t, ids, own):
                yield n * span + b if b >= 0 else -1 - (chunk * len(searches) + n), p

    def match(key, chunks, payloads):
        return searches[key // span].match(key % span, chunks, payloads)

    def finish(chunk, ids, texts, got):
        rows, z = [], 0
        every = [(x or "").encode("utf-8", "replace") for x in texts]
        gone, *more = [s.gone(sum(map(len, every)), own) for s, own in zip(searches, answers(got))]
        more = [np.concatenate([[0], np.cumsum(g)]) for g in more]
        for i, (doc, raw) in enumerate(zip(ids, every)):
            a, z = z, z + len(raw)
            edge = np.flatnonzero(np.diff(gone[a:z].view(np.int8), prepend=0, append=0))
            body = b"".join(raw[p:q] for p, q in zip([0, *edge[1::2].tolist()], [*edge[::2].tolist(), len(raw)])) if len(edge) else raw
            text = None if texts[i] is None or not keep else body.decode("utf-8", "ignore")
            rows.append((doc, z - a, len(raw) - len(body), len(edge) // 2, hashlib.sha256(body).hexdigest(), body if keep else None, edge.tolist() if keep else None, text, [int(m[z] - m[a]) for m in more]))
        return list(zip(*rows))

    edges = meet(x.again(meet(x.first(send_hashes), sort_out), send_edges), match)
    return x.last(edges, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>, kept_text string, n_repeated array<long>", SCHEMA)


def level(batch: list) -> Level:
    right, left, low, high, name = zip(*batch)
    return Level(list(right), list(left), np.array(low, np.int64), np.array(high, np.int64), np.array(name, np.int64))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of LENGTH bytes remove, and how many bytes those of PASSAGE bytes, about fifty short words, would cover."""
    out = remove_repeats(table(spark, sf_dir, "documents"), keep=False, also=(PASSAGE,))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.get("n_repeated", F.lit(0)).alias("n_passage"))


QUERIES = {"op6_suffix_array_dedup": op6_suffix_array_dedup}
#: All windows by brute force; for small tables.
ORACLE_SQL = {
    "op6_suffix_array_dedup": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
s AS (SELECT doc_id, x, unnest(range(0, octet_length(x) - 399)) AS p FROM d WHERE octet_length(x) >= 400),
w AS (SELECT doc_id, p, hash(x[p + 1:p + 400]) AS h FROM s),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
b AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 400, true) AS new FROM w SEMI JOIN m USING (h)),
i AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY doc_id, k),
q AS (SELECT doc_id, k, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS y FROM r),
g AS (SELECT q.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(hex(x[y + 1:a]), '' ORDER BY k) AS head FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id),
s2 AS (SELECT doc_id, x, unnest(range(0, octet_length(x) - 249)) AS p FROM d WHERE octet_length(x) >= 250),
w2 AS (SELECT doc_id, p, hash(x[p + 1:p + 250]) AS h FROM s2),
m2 AS (SELECT h FROM w2 GROUP BY h HAVING count(*) > 1),
c2 AS (SELECT doc_id, least(250, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 250)) AS c FROM w2 SEMI JOIN m2 USING (h)),
v AS (SELECT doc_id, sum(c) AS n FROM c2 GROUP BY doc_id)
SELECT d.doc_id, octet_length(x) AS n_bytes, coalesce(v.n, 0) AS n_passage, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN g.doc_id IS NULL THEN hex(x) ELSE head || hex(x[last + 1:]) END)) AS kept_sha256 FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id""",
}
