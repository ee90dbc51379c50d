"""Chunk and bucket exchange: how these operators compare every document with all others.

Documents are dealt to chunks of about CHUNK bytes by a hash of their id and text. A `visit` function sees one chunk's
documents and sends packed arrays of hashes, each distinct value once, to buckets of the hash space; a
`meet` function sees one bucket of all chunks and replies to each chunk. As a chunk sends a value once
however often it has it, a hot value costs its bucket one entry a chunk, not one a row. The next visit
gets the documents again, with the replies. All visits read the same exchange of the texts, which
Spark makes once and reuses. Chunks and buckets grow in number with the input, not in size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded, release

CHUNK, BUCKET = 2 << 20, 16 << 20
#: A row counts as so many bytes besides its text, so that chunks of short or no texts stay small too.
ROW_BYTES = 64
ROW = "key long, chunk long, payload binary"
PA_ROW = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("payload", pa.binary())])


def rows(items) -> pa.Table:
    """items: (key, chunk, payload)."""
    k, c, p = [list(x) for x in zip(*items)] or ([], [], [])
    return pa.table([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.binary())], schema=PA_ROW)


def _rows(items) -> pa.Table:
    items = list(items)
    return rows(items) if items else PA_ROW.empty_table()


class Exchange:
    """`carry` names columns that come back with the result of `last` (as c0, c1, ... inside)."""

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK, bucket_bytes: int = BUCKET, carry: tuple = ()):
        size = bounded(docs).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
        self.chunks = int(size // chunk_bytes) + 1
        self.buckets = max(8, int(size // bucket_bytes) + 1)
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.chunks))  # by the text too: ids may be null or repeated
        self.carried = [(c, docs.schema[c].dataType) for c in carry]
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", place.alias("chunk"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))

    def first(self, visit: Callable[[int, list, list], Iterator]) -> DataFrame:
        """visit(chunk, ids, texts) yields (bucket, payload)."""

        def run(key, docs):
            c = key[0].as_py()
            out = _rows((k, c, p) for k, p in visit(c, *documents(docs)))
            release()
            return out

        return self.docs.groupBy("chunk").applyInArrow(run, ROW)

    def again(self, replies: DataFrame, visit: Callable) -> DataFrame:
        """visit(chunk, ids, texts, {key: payload}) yields (bucket, payload)."""

        def run(key, docs, got):
            c = key[0].as_py()
            out = _rows((k, c, p) for k, p in visit(c, *documents(docs), answers(got)))
            release()
            return out

        return self.docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, ROW)

    def last(self, replies: DataFrame, visit: Callable, schema: str, pa_schema: pa.Schema) -> DataFrame:
        """visit(chunk, ids, texts, {key: payload}) returns the columns of the result, to which the carried ones are added."""
        names = [f"c{i}" for i in range(len(self.carried))]
        full = pa_schema
        for n, (_, kind) in zip(names, self.carried):
            full = full.append(pa.field(n, to_arrow_type(kind)))

        def run(key, docs, got):
            if not docs.num_rows:
                return full.empty_table()
            columns = visit(key[0].as_py(), *documents(docs), answers(got))
            more = docs.select(names).take(pa.array(placed(docs), pa.int64()))
            release()
            out = [pa.array(c, type=f.type) for c, f in zip(columns, pa_schema)] + [more.column(n).combine_chunks().cast(full.field(n).type) for n in names]
            return pa.table(out, schema=full)

        more = "".join(f", {n} {kind.simpleString()}" for n, (_, kind) in zip(names, self.carried))
        out = self.docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema + more)
        return out.withColumnsRenamed({n: c for n, (c, _) in zip(names, self.carried)})


def meet(sent: DataFrame, join: Callable[[int, list, list], Iterator]) -> DataFrame:
    """join(key, chunks, payloads) yields (chunk, payload); rows with negative keys pass unchanged."""

    def run(key, got):
        k = key[0].as_py()
        if k < 0:
            return got.select(PA_ROW.names)
        order = np.argsort(got.column("chunk").to_numpy(), kind="stable")
        chunks, payloads = got.column("chunk").to_pylist(), got.column("payload").to_pylist()
        out = _rows((k, c, p) for c, p in join(k, [chunks[i] for i in order], [payloads[i] for i in order]))
        release()
        return out

    return sent.groupBy("key").applyInArrow(run, ROW)


def placed(t: pa.Table) -> list[int]:
    """A fixed order of a chunk's rows, by id and text (null ids last), so that every visit sees a chunk alike."""
    ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))


def documents(t: pa.Table) -> tuple[list, list]:
    """Ids and texts in the order of `placed`."""
    ids, texts, order = t.column("doc_id").to_pylist(), t.column("text").to_pylist(), placed(t)
    return [ids[i] for i in order], [texts[i] for i in order]


def answers(t: pa.Table) -> dict[int, bytes]:
    return dict(zip(t.column("key").to_pylist(), t.column("payload").to_pylist()))


def numbers(ids: list) -> np.ndarray:
    """Ids as numbers; null ones come last."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)


def parts(sorted_hashes: np.ndarray, buckets: int):
    """(bucket, first, end) of each bucket of the hash space that has some of an ascending array's values.

    The work follows the array, not the number of buckets, which grows with the input."""
    at, n = 0, len(sorted_hashes)
    if n * 4 < buckets:  # few values: walk from one occupied bucket to the next
        while at < n:
            b = int(sorted_hashes[at]) * buckets >> 64
            end = at + int(np.searchsorted(sorted_hashes[at:], np.uint64(min(-(-((b + 1) << 64) // buckets), (1 << 64) - 1)), side="left")) if b + 1 < buckets else n
            yield b, at, end
            at = end
    elif n:
        edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
        c = [0, *np.searchsorted(sorted_hashes, edges).tolist(), n]
        for b in range(buckets):
            if c[b] < c[b + 1]:
                yield b, c[b], c[b + 1]


def groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
