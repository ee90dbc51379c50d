"""Column functions. All stay in the JVM except byte_entropy, hmac and canonical_hash, which are Arrow-batched."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L


def choose(key: Column, table: dict, default=None) -> Column:
    """A constant lookup as one CASE expression."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


def identifier_hash(name: Column) -> Column:
    return F.concat(F.lit("ID_"), F.substring(F.sha2(name, 256), 1, 8))


def byte_entropy(text: Column) -> Column:
    """Shannon entropy of the UTF-8 bytes, in bits a byte; 0 for empty, null for null."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            c = np.bincount(np.frombuffer(t.encode("utf-8", "replace"), np.uint8))
            p = c[c > 0] / max(1, c.sum())
            return float(-(p * np.log2(p)).sum()) + 0.0

        return texts.map(one)

    return run(text)


def lines(text: Column) -> Column:
    """Lines as str.splitlines gives them: no empty last line."""
    parts = F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: Characters that end a line; \r and \n together end one.
ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def line_stats(text: Column) -> Column:
    """struct(total, blank, blank_ratio), counted without cutting the text into lines.

    With all ends of lines written as \n and blanks left out, a blank line is a \n after another one or at the beginning, so
    their number is that of the \n less that of their runs."""
    plain = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), ENDS + " \t", "\n" * len(ENDS))
    breaks = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    open_ = (F.length(text) > 0) & ~F.right(text, F.lit(1)).isin(*ENDS)  # a last line that nothing ends
    total = breaks + open_.cast("int")
    blank = breaks + 1 - F.regexp_count(F.concat(F.lit("\n"), plain), F.lit("\n+")) + (open_ & ((plain == "") | plain.endswith("\n"))).cast("int")
    return F.struct(total.alias("total"), blank.alias("blank"), (blank / F.greatest(total, F.lit(1))).alias("blank_ratio"))


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def text_of(content: Column) -> Column:
    """Text of bytes as UTF-8; each ill-formed sequence becomes a replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def decode_utf8(content: Column) -> Column:
    """Text of bytes that are valid UTF-8; others null (kept apart for a quarantine)."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def strip_comments(source: Column, hashed: bool) -> Column:
    if hashed:
        return F.regexp_replace(source, "#[^\\n]*+", "")
    return F.regexp_replace(F.regexp_replace(source, "/\\*(?s:.*?)\\*/", ""), "//[^\\n]*+", "")


def strip_strings(source: Column) -> Column:
    """Empties string literals: triple-quoted ones, backticks, then double and single quotes."""
    out = F.regexp_replace(source, '"""(?s:.*?)"""', '""')
    out = F.regexp_replace(out, "'''(?s:.*?)'''", "''")
    out = F.regexp_replace(out, "`[^`]*+`", "``")
    for q in "\"'":  # unrolled and possessive, so that long literals need no stack
        out = F.regexp_replace(out, f"{q}[^{q}\\\\]*+(?:\\\\.[^{q}\\\\]*+)*+{q}", q + q)
    return out


def whole_word(word: str) -> str:
    return f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"


def keyword_complexity(source: Column, words: list[str]) -> Column:
    return F.regexp_count(source, F.lit(whole_word(f"(?:{'|'.join(words)})"))) + 1


def magnitude_class(v: Column) -> Column:
    a = F.abs(v)
    return F.when(v.isNull(), "unknown").when(a == 0, "zero").when(a < 256, "byte_range").when(a < 65536, "word_range").when(a < 4294967296, "dword_range").otherwise("large")


def truthy(v: Column) -> Column:
    """Whether a property is a number other than 0 or the word true."""
    return F.coalesce(v.try_cast("double") != 0, F.lower(v) == "true", F.lit(False))


def edge_label(ir_type: Column) -> Column:
    return choose(ir_type, L.EDGE_LABELS, "uses")


def edge_weight(risk: Column) -> Column:
    return risk / F.lit(10.0)


def writes(mode: Column) -> Column:
    return F.coalesce(mode.contains("w") | mode.contains("a") | mode.contains("x"), F.lit(False))


def risk_colour(risk: Column) -> Column:
    return F.when(risk > 0.7, "crit").when(risk > 0.5, "high").when(risk > 0.25, "med").otherwise("low")


def decision_badge(decision: Column) -> Column:
    return F.when(decision == "APPROVE", "ok").when(decision == "REJECT", "bad").otherwise("warn")


def repo_of(url: Column) -> Column:
    """struct(owner, repo) of a repository address."""
    parts = F.split(F.regexp_replace(F.parse_url(url, F.lit("PATH")), "^/+|/+$", ""), "/")
    return F.struct(F.get(parts, F.lit(0)).alias("owner"), F.regexp_replace(F.get(parts, F.lit(1)), "\\.git$", "").alias("repo"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def canonical_hash(record: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys and ASCII escapes, without its own chain_hash."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        def one(r):
            if r is None:
                return None
            d = {k: v for k, v in json.loads(r).items() if k != "chain_hash"}
            return hashlib.sha256(json.dumps(d, sort_keys=True, default=str).encode()).hexdigest()

        return rows.map(one)

    return run(record)


def hmac_sha256(key: str, message: Column) -> Column:
    """Hexadecimal HMAC of a text, from two hashes over padded keys."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(c ^ pad for c in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def signature(key: str, agent: Column, ts: Column, payload: Column) -> Column:
    return hmac_sha256(key, F.concat_ws(":", agent, ts.cast("string"), F.sha2(payload, 256)))


def fresh(ts: Column, now: Column, age: int = 60, skew: int = 5) -> Column:
    return (now - ts <= age) & (now - ts >= -skew)


def seal(content: Column, dek: Column, kek: Column) -> Column:
    """struct(ciphertext, wrapped key, ciphertext_sha256): AES-256-GCM with the key wrapped by another."""
    # encryption draws a nonce, so it must be evaluated once for the ciphertext and its hash: as a lambda's argument
    once = F.transform(F.array(F.aes_encrypt(content, dek, F.lit("GCM"))), lambda c: F.struct(c.alias("ciphertext"), F.aes_encrypt(dek, kek, F.lit("GCM")).alias("wrapped"), F.sha2(c, 256).alias("ciphertext_sha256")))
    return F.get(once, F.lit(0))


def unseal(sealed: Column, kek: Column) -> Column:
    return F.aes_decrypt(sealed["ciphertext"], F.aes_decrypt(sealed["wrapped"], kek, F.lit("GCM")), F.lit("GCM"))
