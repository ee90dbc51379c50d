"""The opN_ queries as queries, on the smallest tables: their columns, folds and digests, against plain Python."""

import hashlib
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from siftwork.llm import media, packing, registry, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


def run(spark, name):
    df = registry.queries()[name](spark, SF)
    return df, df.collect()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def types(df, **want):
    assert {k: v for k, v in df.dtypes if k in want} == want


def test_op1(spark, docs):
    df, rows = run(spark, "op1_language_id")
    types(df, doc_id="bigint", held_out="boolean", lang_pred="string", score="double")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    learned = {d["lang"] for i, d in docs.items() if fold(i, 4) != 2 and d["lang"]}
    assert {r.lang_pred for r in rows} <= learned | {"und"}
    lettered = [r for r in rows if r.held_out and any(c.isalpha() for c in docs[r.doc_id]["text"] or "")]
    assert sum(r.lang_pred == docs[r.doc_id]["lang"] for r in lettered) >= 0.9 * len(lettered) > 10
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id]["text"] or "")) for r in rows)


def test_op2(spark, docs):
    df, rows = run(spark, "op2_document_fingerprints")
    types(df, doc_id="bigint", n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double")
    ids = sorted(docs)
    text = lambda i: docs[i]["text"] or ""
    got = {r.doc_id: r for r in rows}
    assert sorted(got) == ids
    by: dict = {}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        q = len(text(i)) // 4
        edited = text(i)[: len(text(i)) - q] + text(j)[:q]
        assert got[i].n_chars == len(text(i)) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        by.setdefault(text(i), set()).add(got[i].fingerprint)
        if edited == text(i):
            assert got[i].edited_fingerprint == got[i].fingerprint and got[i].near_edited == 1
    assert all(len(v) == 1 for v in by.values())
    assert np.mean([r.near_edited for r in rows]) > 0.4 > 0.1 > np.mean([r.near_next for r in rows])


def test_op3(spark, docs):
    df, rows = run(spark, "op3_best_fit_packing")
    types(df, doc_id="bigint", piece="int", start="bigint", length="bigint", ids_crc32="bigint", sequence_id="bigint", offset="bigint")
    ids = sorted(docs)
    codes = dict(zip(ids, (np.append(x, 0).astype("<u4") for x in packing.Encoder()([docs[i]["text"] or "" for i in ids]))))
    pieces: dict = {}
    bins: dict = {}
    for r in rows:
        assert zlib.crc32(codes[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r["offset"], r.length))
    for i, x in codes.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(x)
        assert len(own) == 1 if len(x) <= 2048 else all(r.length == 2048 for r in own[1:])
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(map(len, codes.values())) // 2048) + 2


def test_op4(spark):
    df, rows = run(spark, "op4_media_copies")
    ids = pq.read_table(f"{SF}/embeddings.parquet").column("vec_id").to_pylist()
    assert sorted(r.image_id for r in rows) == sorted(ids)
    assert all(r.copy_id <= r.class_id <= r.image_id and r.members >= 1 for r in rows)
    assert media.BANDS > media.DISTANCE  # a match shares a band


def test_op5(spark, docs):
    _, rows = run(spark, "op5_license_scan")
    for r in rows:
        assert 0 <= r.start < r.stop <= len(docs[r.doc_id]["text"]) and r.alike >= 0.75 and r.saving >= 0.25
    # lines that the tables hold word for word
    for i, d in docs.items():
        for line, name in (("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")):
            if line in (d["text"] or ""):
                assert any(r.doc_id == i and r.license == name for r in rows)


def test_op9(spark, docs):
    df, rows = run(spark, "op9_source_mixing")
    count: dict = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert (r.lang, r.source) == (docs[r.doc_id]["lang"], docs[r.doc_id]["source"]) and r.epoch in (0, 1)
    total = sum(len((d["text"] or "").split()) for d in docs.values())
    assert set(count) <= set(docs) and max(count.values()) <= 2
    # a prefix ends before the document that passes its budget, and leaves are small here
    assert 0.2 * total < sum(r.tokens for r in rows) <= 0.5 * total


def test_op10(spark, docs):
    df, rows = run(spark, "op10_toxicity")
    types(df, doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD) for r in rows)


@pytest.mark.parametrize("name", ["op6_suffix_array_dedup", "op7_jaccard_join", "op8_substring_dedup"])
def test_types_of_the_dedup_queries(spark, name):
    df = registry.queries()[name](spark, SF)
    assert dict(df.dtypes)["doc_id"] == "bigint" and all(t in ("bigint", "string") for _, t in df.dtypes)
