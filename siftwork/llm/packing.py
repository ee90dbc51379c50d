"""Packing of token sequences by minimum bin slack.

Each text is encoded with a public byte-level vocabulary and ended by id 0; longer ones than `capacity`
are cut into pieces of `capacity`, the first piece taking the remainder. Pieces are packed with as little
slack as possible: for one bin at a time, a subset-sum dynamic program over the lengths still available
(a Python integer as the bitset of reachable sums) finds the fullest combination that holds the longest
available piece, and the combination is removed as often as the lengths' counts allow.

The plan is made from the histogram of lengths, whose size is bounded by `capacity`, so the driver's work
does not grow with the input. Pieces get their places by rank among equal lengths: ranks within a chunk
of rows plus the number of such pieces in earlier chunks, so that no length's pieces meet in one task.

Defined cases: null text is empty and is one piece [0]; an empty table gives an empty result; rows of
equal doc_id are packed one by one. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bounded, table
from .hashing import equal, strings
from .storage import saved

CAPACITY, END, VOCABULARY, SPECIAL = 2_048, 0, "byte_bpe_50k", "<|endoftext|>"
RANKED = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CHUNKED = 20_000  # pieces ranked together
CACHED = 150_000  # pre-tokens kept by a worker
NEAR = 1 << 18  # code points encoded together
LETTER, NUMBER, BLANK, OTHER, BREAK = range(5)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point, as the vocabulary's splitting pattern tells them apart."""
    import sys

    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(sys.maxunicode + 1))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


class Encoder:
    """Ids of texts. Splits them into pre-tokens with array operations and encodes each distinct one once.

    The ids equal those of the tokenizers library for the same vocabulary; a text with the vocabulary's
    special token goes to that library itself."""

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers as public
        import tiktoken

        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # texts come as pre-tokens already, so nothing is left to split
        self.piece = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.path, self.slow = public.path(f"{name}.json"), None
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(1 << 18, np.uint32), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        some, size = [], 0
        for i, t in enumerate(texts):
            if SPECIAL in t:
                out[i] = self.whole(t)
            else:
                some.append(i)
                size += len(t) + 1
            if some and (size >= NEAR or i == len(texts) - 1):
                for k, ids in zip(some, self.together([texts[k] for k in some])):
                    out[k] = ids
                some, size = [], 0
        for k, ids in zip(some, self.together([texts[k] for k in some]) if some else []):
            out[k] = ids
        return out

    def together(self, texts: list[str]) -> list[np.ndarray]:
        text = "\0".join(texts) + "\0"
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(size) - 1
        kind = classes()[code]
        kind[ends] = BREAK
        begin = starts(code, kind)
        a = np.flatnonzero(begin)
        a = a[kind[a] != BREAK]
        z = np.append(a[1:], len(code))
        # a token ends at the next start or at its text's end
        z = np.minimum(z, ends[np.searchsorted(ends, a)])
        top = int(code.max())
        width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
        raw = code.astype(f"<u{width}").tobytes()
        _, first, which = np.unique(strings(raw, width * a, width * z), return_index=True, return_inverse=True)
        model, size = first[which], width * (z - a)
        same = size == size[model]
        same &= equal(raw, np.where(same, size, 0), width * a, width * a[model])
        if not same.all():
            # a pre-token that only has the hash of another one stands for itself
            odd = np.flatnonzero(~same)
            which[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        if len(self.at) > CACHED:
            self.known, self.at = {}, np.zeros(1, np.int64)
        known, used, keys = self.known, int(self.at[-1]), [text[i:j] for i, j in zip(a[first].tolist(), z[first].tolist())]
        found = list(map(known.get, keys))
        fresh, places = [], []
        for k, key in enumerate(keys):
            if found[k] is not None:
                continue
            known[key] = found[k] = len(self.at) - 1 + len(fresh)
            ids = self.piece(key.encode("utf-8", "replace"))
            fresh.append(ids)
            used += len(ids)
            places.append(used)
        if fresh:
            while used > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[int(self.at[-1]) : used] = [v for ids in fresh for v in ids]
            self.at = np.concatenate([self.at, np.array(places, np.int64)])
        token = np.array(found, np.int64)[which]
        n = self.at[token + 1] - self.at[token]
        stop = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[token] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        cut = np.concatenate([[0], np.searchsorted(a, ends)])
        stop = np.concatenate([[0], stop])
        return [flat[stop[cut[i]] : stop[cut[i + 1]]] for i in range(len(texts))]


def starts(code: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where a pre-token begins: at each change of class, a single space joining what follows it; of a run of
    blanks before something else the last one stands apart; and apostrophe endings of English stand alone."""
    n = len(code)
    before = np.concatenate([[BREAK], kind[:-1]]).astype(np.uint8)
    after = np.concatenate([kind[1:], [BREAK]]).astype(np.uint8)
    joined = np.concatenate([[False], code[:-1] == 32]) & (before == BLANK)
    begin = (kind != before) & ~((kind != BLANK) & (kind != BREAK) & joined)
    begin |= (kind == BLANK) & (before == BLANK) & (after != BLANK) & (after != BREAK)
    for i in np.flatnonzero((code == 39) & begin & (kind == OTHER)).tolist():
        if not begin[i]:
            continue
        one = chr(code[i + 1]) if i + 1 < n and kind[i + 1] == LETTER else ""
        two = one + (chr(code[i + 2]) if i + 2 < n and kind[i + 2] == LETTER else "") if one else ""
        end = i + 2 if one and one in "stmd" else i + 3 if two in ("re", "ve", "ll") else 0
        if end:
            begin[i + 1 : end] = False
            if end < n and not (joined[end] and kind[end] != BLANK):
                begin[end] = True
    return begin


def pieces(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every text's pieces."""

    def run(it):
        encode = None
        for ids, texts in batches(it, "doc_id", "text"):
            encode = encode or Encoder(name)
            rows = []
            for d, tokens in zip(ids, encode([t or "" for t in texts])):
                t = np.append(tokens, np.uint32(END)).astype("<u4")
                start = 0
                stops = range(len(t) % capacity or min(capacity, len(t)), len(t) + 1, capacity)
                for k, stop in enumerate(stops):
                    rows.append((d, k, start, stop - start, zlib.crc32(t[start:stop].tobytes())))
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RANKED)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """(length, how often) of the fullest bin that holds the longest length available."""
    top = max(counts)
    room = capacity - top
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        left, block = min(counts[n] - (n == top), room // n), 1
        while left > 0 and not reach >> room & 1:  # counts in powers of two: each step adds block x n or nothing
            take = min(block, left)
            steps.append((n, take, reach))
            reach |= reach << (n * take) & mask
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used = Counter({top: 1})
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            at -= n * take
            used[n] += take
    return list(used.items())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, times in a sequence, offset) for all pieces."""
    counts = {n: c for n, c in histogram.items() if c}
    rank, rows, sequence = Counter(), [], 0
    while counts:
        used = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in used)
        offset = 0
        for n, k in sorted(used, reverse=True):
            rows.append((n, rank[n], rank[n] + k * times, sequence, k, offset))
            rank[n] += k * times
            offset += n * k
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return rows


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (which must not change between reads)."""
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = sorted(plan(histogram, capacity))
    chunks = sum(histogram.values()) // CHUNKED + 1
    keyed = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    if chunks > 1:
        from pyspark.sql import Window

        tally = keyed.groupBy("length", "chunk").count()
        tally = tally.select("length", "chunk", (F.sum("count").over(Window.partitionBy("length").orderBy("chunk")) - F.col("count")).alias("before"))
    else:
        tally = None
    by = {}
    for n, *rest in rows:
        by.setdefault(n, []).append(rest)
    tables = {n: np.array(v, np.int64) for n, v in by.items()}
    shared = spark.sparkContext.broadcast(tables)  # a few rows a length, whatever the input

    def run(t: pa.Table) -> pa.Table:
        known = shared.value
        t = t.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = t.column("length").to_numpy()
        first = np.concatenate([[True], length[1:] != length[:-1]])
        at = np.flatnonzero(first)
        rank = np.arange(len(length)) - np.repeat(at, np.diff(np.append(at, len(length)))) + t.column("before").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(length)]):
            m = known[int(length[i])]
            r = rank[i:j]
            row = m[np.searchsorted(m[:, 0], r, side="right") - 1]
            turn = r - row[:, 0]
            sequence[i:j] = row[:, 2] + turn // row[:, 3]
            offset[i:j] = row[:, 4] + turn % row[:, 3] * length[i:j]
        return pa.table([t.column(k) for k in PIECES.names] + [pa.array(sequence), pa.array(offset)], names=[*PIECES.names, "sequence_id", "offset"])

    ready = keyed.withColumn("before", F.lit(0).cast("long")) if tally is None else keyed.join(tally, ["length", "chunk"])
    return ready.select("chunk", *PIECES.names, "before").groupBy("chunk").applyInArrow(lambda t: run(t), RANKED + ", sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, name: str = VOCABULARY) -> DataFrame:
    return place(saved(pieces(docs, capacity, name)), capacity)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
