"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. Each round joins runs of one name, labels every
name by deterministic coin tossing (twice the lowest bit in which it differs from the name before it, plus
that bit's value; three times over, which leaves six labels of which neighbours differ), begins a phrase at
each local maximum of the labels, and names the phrases by their content. A phrase depends on a few names
around it only, so equal substrings get equal names away from their ends, at every round and wherever they
stand. The fingerprint is the SKETCH least of the names of the rounds from LONG on, to which short texts add
those of the earlier rounds, marked as such; likeness is the share of equal names in the least of both, and
leaves the marked ones out unless both texts are short.

Defined cases: null text is empty; the fingerprint of an empty text is empty, like only other empty ones
(1.0). The document after the last is the first; with one row it is that row itself. Rows of equal doc_id
follow each other in the order of their texts; null doc_ids come first. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ROW_BYTES, groups
from .common import table
from .hashing import BASE, U, mix, prefix, spans

SKETCH, ROUNDS, PART = 64, 7, 8 << 20
LONG, SHORT, EARLY = 2, 48, 1 << 31
#: Bounds of what the driver holds: ids of parts, and ranges from which they are found.
MOST_PARTS, COARSE = 1 << 20, 512
TOGETHER = 1 << 19  # code points parsed together
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def firsts(doc: np.ndarray) -> np.ndarray:
    """Whether a name is the first of its text."""
    out = np.ones(len(doc), bool)
    np.not_equal(doc[1:], doc[:-1], out=out[1:])
    return out


def toss(v: np.ndarray, head: np.ndarray) -> np.ndarray:
    """One round of coin tossing: labels of one byte; head marks the first name of each text."""
    differ = np.empty_like(v)
    differ[1:] = v[1:] ^ v[:-1]
    differ[head] = ~v.dtype.type(0)
    low = differ & np.negative(differ)
    return (np.bitwise_count(low - v.dtype.type(1)) << np.uint8(1)) | ((v & low) != 0)


def phrases(v: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next round's names and their texts."""
    new = firsts(doc)
    new[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(v)))
    v, doc = v[at], doc[at]
    runs = np.flatnonzero(n > 1)
    v[runs] = mix(v[runs] + n[runs].astype(U))
    head = firsts(doc)
    # the upper half of a name is enough to tell it from its neighbour; where it is not, the labels still follow the text
    label = toss(toss(toss((v >> U(32)).astype(np.uint32), head), head), head).astype(np.int8)
    begin = head.copy()
    peak = begin[1:-1]
    peak |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~head[2:]
    begin = np.flatnonzero(begin)
    return spans(prefix(v), begin, np.append(begin[1:], len(v))), doc[begin]


def sketches(codes: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of code points its SKETCH least phrase names, ascending.

    Names of the rounds from LONG on have a clear top bit. Texts below SHORT code points have the names of the earlier
    rounds too, with the bit set."""
    size = np.array([len(c) for c in codes], np.int64)
    doc = np.repeat(np.arange(len(codes), dtype=np.int32), size)
    if not len(doc):
        return [np.zeros(0, np.uint32)] * len(codes)
    v = (np.concatenate(codes).astype(U) + U(1)) * U(BASE)
    short = size < SHORT
    names, owners = [], []
    for k in range(ROUNDS):
        w, d = (v, doc) if k >= LONG else (v[short[doc]], doc[short[doc]]) if short.any() else (v[:0], doc[:0])
        names.append((mix(w ^ U(k)) >> U(33)).astype(np.uint32) | np.uint32(0 if k >= LONG else EARLY))
        owners.append(d)
        if k + 1 < ROUNDS:
            v, doc = phrases(v, doc)
    v, doc = np.concatenate(names), np.concatenate(owners)
    both = np.unique((doc.astype(U) << U(32)) | v)
    v, doc = (both & U((1 << 32) - 1)).astype(np.uint32), (both >> U(32)).astype(np.int64)
    at = groups(doc)
    out = [np.zeros(0, np.uint32)] * len(codes)
    for i, a, z in zip(doc[at].tolist(), at.tolist(), [*at[1:].tolist(), len(doc)]):
        out[i] = v[a : min(z, a + SKETCH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases, 0 to 1. The early rounds' names count only if both have them."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (a[-1] < EARLY) != (b[-1] < EARLY):
        a, b = a[a < EARLY], b[b < EARLY]
    both = np.union1d(a, b)[:SKETCH]
    return float(np.isin(both, np.intersect1d(a, b)).mean())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def part_edges(keyed: DataFrame) -> list[int]:
    """The least id of each part, ascending: parts hold about PART bytes of texts next to each other in the order of ids.

    At most MOST_PARTS ids; with more text than they hold at PART bytes, parts are larger."""
    own = F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES  # rows without text have a weight too
    size = keyed.agg(F.sum(own), F.min("at"), F.count("*")).first()
    if not size[2]:
        return []
    part = max(PART, (size[0] or 0) // MOST_PARTS + 1)
    if (size[0] or 0) <= part:
        return [size[1]]
    # running totals: first of coarse ranges, which are few, then within each
    coarse = min(COARSE, size[0] // part + 1)
    quantiles = sorted(set(keyed.approxQuantile("at", [i / coarse for i in range(1, coarse)], 0.1 / coarse)))
    # approxQuantile gives doubles: any ascending numbers will do as bounds of ranges
    bounds = F.array(*(F.lit(float(q)) for q in quantiles)) if quantiles else F.array().cast("array<double>")
    sized = keyed.select("at", own.alias("b")).withColumn("range", F.size(F.filter(bounds, lambda q: q < F.col("at").cast("double"))))
    totals = sized.groupBy("range").agg(F.sum("b").alias("n")).withColumn("offset", F.sum("n").over(Window.orderBy("range")) - F.col("n"))  # at most COARSE rows
    running = sized.join(F.broadcast(totals.select("range", "offset")), "range")
    before = F.sum("b").over(Window.partitionBy("range").orderBy("at")) - F.col("b") + F.col("offset")
    firsts = running.withColumn("part", F.floor(before / F.lit(part))).groupBy("part").agg(F.min("at").alias("at"))
    return sorted({size[1], *(r[0] for r in firsts.select("at").collect())})


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for every row: its fingerprint and that of the text with its last quarter exchanged
    for the beginning of the next document, in the order of doc_id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    heads = part_edges(keyed)
    edges = np.array(heads[1:], np.int64)

    @F.pandas_udf("long")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right"))

    dealt = keyed.withColumn("part", part_of("at"))
    # the document of each part's least id also goes to the part before; at most MOST_PARTS rows
    extra = keyed.sparkSession.createDataFrame([(h, (i or len(heads)) - 1) for i, h in enumerate(heads)], "at long, to long")
    again = keyed.join(F.broadcast(extra), "at").select("doc_id", "text", "at", F.col("to").alias("part"), F.lit(True).alias("next"))

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("next").to_pylist(), t.column("at").to_pylist(), (x or "" for x in t.column("text").to_pylist()), t.column("doc_id").to_pylist()), key=lambda r: r[:3])
        n = sum(not r[0] for r in rows)
        rows = rows[: n + 1]
        codes = [code_points(r[2]) for r in rows]
        own: list = []
        edited: list = []
        shas = []
        i = 0
        while i < len(rows):
            j, some = i, 0
            while j < len(rows) and (j == i or some + len(codes[j]) <= TOGETHER):
                some += len(codes[j])
                j += 1
            own += sketches(codes[i:j])
            changed = []
            for k in range(i, min(j, n)):
                q = len(codes[k]) // 4
                text = np.concatenate([codes[k][: len(codes[k]) - q], codes[k + 1][:q]]) if q else codes[k]
                changed.append(text)
                shas.append(hashlib.sha256(text.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")).hexdigest())
            edited += sketches(changed)
            i = j
        text = lambda s: s.astype(">u4").tobytes().hex()
        columns = (
            [r[3] for r in rows[:n]], [len(c) for c in codes[:n]], shas, [text(s) for s in own[:n]], [text(s) for s in edited],
            [likeness(own[k], edited[k]) for k in range(n)], [likeness(own[k], own[k + 1]) for k in range(n)],
        )
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    return dealt.select("doc_id", "text", "at", "part", F.lit(False).alias("next")).union(again).groupBy("part").applyInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op2_document_fingerprints": op2_document_fingerprints}
