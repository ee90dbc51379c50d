"""Removal of word windows that a document with a smaller id has too, by fixed-block anchors.

Every document is an index of non-overlapping blocks of BLOCK words, and a query whose every rolling
window of BLOCK words probes that index. As 2 * BLOCK - 1 <= WINDOW, each repeated window of WINDOW
words holds a whole block of its other place, so no repeat is missed. Hits are then
extended a word at a time: each window of WINDOW words around a hit goes to where it is held against the
same windows of all documents, and stays if one of a smaller id has it. Adjoining windows that stay make
the maximal repeats, whose words are removed.

Probes travel as 30 bits each (false hits only cost a confirmation). Windows are compared by 96 bits of two
independent hashes of their words' bytes, so that among the 1.6e13 windows of 100 TB less than one false
equality is expected.

Defined cases: null text has no words; the sha256 of no words is that of empty bytes. A null doc_id is
larger than any other, and rows with equal doc_id are one document's copies: neither removes from the
other. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import Exchange, groups, meet, numbers, parts
from .common import table
from .hashing import U, Words, grams

WINDOW, BLOCK = 13, 7
REST, ALIGNED, SEVERAL = (1 << 30) - 1, 1 << 30, 1 << 31
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _probes(w: Words, ids: np.ndarray, block: int):
    """Each distinct window of `block` words: hash; whether a block; whether in several documents; and its places."""
    h, ok = grams(w.hash, block), w.inside(block)
    at = np.flatnonzero(ok)
    order = at[np.argsort(h[at])]
    s = h[order]
    g = groups(s)
    if not len(g):
        return s, np.zeros(0, bool), np.zeros(0, bool), order, g
    doc = ids[w.doc[order]]
    aligned = np.logical_or.reduceat(w.place[order] % block == 0, g)
    several = np.maximum.reduceat(doc, g) != np.minimum.reduceat(doc, g)
    return s[g], aligned, several, order, g


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space)."""
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block wherever it starts")
    x = Exchange(docs)
    buckets = x.buckets

    def send_probes(chunk, ids, texts):
        h, aligned, several, _, _ = _probes(Words(texts), numbers(ids), block)
        packed = (h & U(REST)).astype(np.uint32) | np.where(aligned, np.uint32(ALIGNED), 0).astype(np.uint32) | np.where(several, np.uint32(SEVERAL), 0).astype(np.uint32)
        for b, i, j in parts(h, buckets):
            yield b, packed[i:j].tobytes()

    def match(key, chunks, payloads):
        probes = [np.frombuffer(p, np.uint32) for p in payloads]
        v = np.concatenate(probes)
        order = np.argsort(v & np.uint32(REST), kind="stable")
        rest = (v & np.uint32(REST))[order]
        g = groups(rest)
        n = np.diff(np.append(g, len(rest)))
        flags = np.bitwise_or.reduceat(v[order] >> np.uint32(30), g)
        hit = (flags & 1 > 0) & ((n > 1) | (flags & 2 > 0))
        back = np.zeros(len(v), bool)
        back[order] = np.repeat(hit, n)
        at = 0
        for c, p in zip(chunks, probes):
            if (mine := back[at : at + len(p)]).any():
                yield c, np.packbits(mine).tobytes()
            at += len(p)

    def send_windows(chunk, ids, texts, got):
        w = Words(texts)
        who = numbers(ids)
        h, _, _, order, g = _probes(w, who, block)
        hit = np.zeros(len(h), bool)
        for b, i, j in parts(h, buckets):
            if b in got:
                hit[i:j] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=j - i).astype(bool)
        near = np.zeros(len(w.hash) + 1, np.int64)
        near[order[np.repeat(hit, np.diff(np.append(g, len(order))))]] = 1
        near = np.concatenate([[0], np.cumsum(near)])
        f, ok = grams(w.hash, window), w.inside(window)
        at = np.flatnonzero(ok & (near[np.arange(len(ok)) + window - block + 1] > near[: len(ok)])) if len(ok) else np.zeros(0, np.int64)
        order = at[np.argsort(f[at], kind="stable")]
        s = f[order]
        g = groups(s)
        if not len(g):
            return
        least = np.minimum.reduceat(who[w.doc[order]], g)
        more = (grams(w.hashed(seed=1), window)[order[g]] >> U(32)).astype(np.uint32)
        s = s[g]
        for b, i, j in parts(s, buckets):
            yield b, s[i:j].tobytes() + least[i:j].tobytes() + more[i:j].tobytes()

    def smaller(key, chunks, payloads):
        sizes = [len(p) // 20 for p in payloads]
        hashes = [np.frombuffer(p, U, n) for p, n in zip(payloads, sizes)]
        h, d = np.concatenate(hashes), np.concatenate([np.frombuffer(p, np.int64, n, 8 * n) for p, n in zip(payloads, sizes)])
        more = np.concatenate([np.frombuffer(p, np.uint32, n, 16 * n) for p, n in zip(payloads, sizes)])
        order = np.lexsort((more, h))
        g = np.flatnonzero(np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (more[order[1:]] != more[order[:-1]])]))
        back = np.zeros(len(h), bool)
        back[order] = np.repeat(np.minimum.reduceat(d[order], g), np.diff(np.append(g, len(h)))) < d[order]
        at = 0
        for c, p in zip(chunks, hashes):
            if (mine := back[at : at + len(p)]).any():
                yield c, p[mine].tobytes()
            at += len(p)

    def finish(chunk, ids, texts, got):
        w = Words(texts)
        who = numbers(ids)
        f, ok = grams(w.hash, window), w.inside(window)
        at = np.flatnonzero(ok)
        order = at[np.argsort(f[at], kind="stable")]
        s = f[order]
        g = groups(s)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        if len(g):
            n = np.diff(np.append(g, len(s)))
            doc = who[w.doc[order]]
            elsewhere = np.isin(s[g], np.frombuffer(b"".join(got.values()), U))
            dup = order[np.repeat(elsewhere, n) | (doc > np.repeat(np.minimum.reduceat(doc, g), n))]
            cover[dup] += 1
            np.add.at(cover, dup + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[w.first[1:]] - total[w.first[:-1]]
        kept, shas = [], []
        for i in range(len(ids)):
            a, z = w.first[i], w.first[i + 1]
            if a == z:
                text = b""
            elif removed[i]:
                k = np.flatnonzero(~gone[a:z]) + a
                text = b" ".join([w.buf[p:q] for p, q in zip(w.start[k].tolist(), w.end[k].tolist())])
            else:
                text = b" ".join(w.buf[w.start[a] : w.end[z - 1]].split())
            shas.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if keep_text else None)
        return ids, w.count, removed, shas, kept

    hits = meet(x.first(send_probes), match)
    confirmed = meet(x.again(hits, send_windows), smaller)
    return x.last(confirmed, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", SCHEMA)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
#: All windows by brute force; for small tables.
ORACLE_SQL = {
    "op8_substring_dedup": r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
s AS (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM d WHERE len(l) >= 13),
w AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
c AS (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM w JOIN m USING (h) WHERE least < doc_id),
u AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS j FROM d),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM u ANTI JOIN (SELECT DISTINCT doc_id, j FROM c) g ON g.doc_id = u.doc_id AND g.j = u.j GROUP BY u.doc_id)
SELECT d.doc_id, len(l) AS n_words, len(l) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
}
