"""Language identification by compression.

Each language is represented by a raw-content zstandard dictionary. A text, in lower case, is cut into
blocks, every block is compressed with every dictionary, and the language with the smallest total wins. If the
runner-up is within `margin` of the winner, the text counts as rejected (`accepted` false).

Defined cases: null text, and text without a letter, give `und` with score 0; without any training
row every text is `und`. Rows with null lang are never learned from but are predicted. Ties go to
the language first in alphabetical order. Columns of the input other than doc_id, text and lang are
ignored; repeated doc_ids give a row each.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, fold, record, sampled, table

#: Bounds of what is learned: sampled rows of a language, characters of an excerpt of each, bytes of a dictionary.
SAMPLE_ROWS, EXCERPT, DICTIONARY = 400, 600, 96_000
BLOCK = 65_536
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def learn(docs: DataFrame, label: str = "lang", size: int = DICTIONARY) -> dict[str, bytes]:
    """One raw dictionary a language, from a bounded sample of labelled rows (see SAMPLE_ROWS)."""
    some = sampled(docs.where(F.length("text") > 0), label, SAMPLE_ROWS)
    # an excerpt begins anywhere in its text, by a hash, and not always at its beginning
    start = 1 + F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - EXCERPT + 1, F.lit(1)))
    rows = some.select("doc_id", F.substr("text", start.cast("int"), F.lit(EXCERPT)), label).collect()
    texts: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (str(r[2]), hash_key(r[1]))):
        if LETTER.search(r[1]):
            texts.setdefault(r[2], []).append(r[1].lower())
    return {k: "\n".join(dict.fromkeys(v)).encode()[:size] for k, v in sorted(texts.items())}


def hash_key(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 5, margin: float = 0.01):
        import zstandard as z

        self.langs, self.margin, self.packers = list(dictionaries), margin, []
        for content in dictionaries.values():
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packers.append(z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(p.compress(b)) for b in blocks) for p in self.packers]
        best = min(sizes)
        rest = sorted(sizes)[1:2] or [2 * best]
        score = 1.0 / sum(math.exp(max(-700.0, (best - s) / 4.0)) for s in sizes)
        return self.langs[sizes.index(best)], score, (rest[0] - best) >= self.margin * best


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and accepted (false: the margin was too narrow)."""

    def run(it):
        classify = Classifier(dictionaries, margin=margin)
        for ids, texts in batches(it, "doc_id", "text"):
            found = [classify(t) for t in texts]
            yield record(SCHEMA, ids, *([f[k] for f in found] for k in range(3)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where(fold(F.col("doc_id"), 4) != 2)
    out = identify(docs, learn(train))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op1_language_id": op1_language_id}
