"""The pipeline's stages on a small corpus: what each decides, and that the next one sees it."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from siftwork.llm import packing

from .test_llm import brute_components, brute_first, corpus, frame


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    texts = corpus(n=80)
    for i in range(2, 80, 9):
        if texts[i]:
            texts[i] += " you grobian."
    d = frame(spark, texts)
    d.coalesce(2).write.parquet(str(at / "documents.parquet"))
    labels = [(i, 1, int(i % 9 == 2 and bool(texts[i]))) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at), texts


def test_stages(spark, folder):
    at, texts = folder
    docs = spark.read.parquet(at + "/documents.parquet")
    out = {}
    for name, stage in P.STAGES:
        docs = out[name] = stage(spark, docs, at).cache()
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    kept = {r.doc_id: r.text for r in out["toxicity"].collect()}
    assert {i for i, t in enumerate(texts) if not t or "grobian" not in t} == set(kept)
    ids = sorted(kept)
    parts = brute_components([kept[i] for i in ids])
    first = {r.doc_id: r.text for r in out["near_duplicates"].collect()}
    assert sorted(first) == [i for i, (_, c) in zip(ids, parts) if ids[c] == i]
    ids = sorted(first)
    left = dict(zip(ids, brute_first([first[i] for i in ids], P.PASSAGE)))
    cut = {r.doc_id: r for r in out["repeated_strings"].collect()}
    assert sum(n > 0 for n, _ in left.values()) > 5
    assert {i: r.text for i, r in cut.items()} == {i: (first[i] and b.decode("utf-8", "ignore")) for i, (n, b) in left.items() if not n or b.decode("utf-8", "ignore")}
    assert all(r.n_chars == (r.text and len(r.text)) for i, r in cut.items() if left[i][0])
    mixed = [r.doc_id for r in out["source_mixing"].collect()]
    assert set(mixed) <= set(cut) and len(mixed) > 5
    assert sorted(r.doc_id for r in out["packing"].where("piece = 0").collect()) == sorted(mixed)


def test_run(spark, folder):
    assert P.run(spark, folder[0]).agg(F.sum("length")).first()[0] > 0
    assert packing.CAPACITY == 2048


def test_stages_with_odd_rows(spark, folder):
    """Repeated and null ids, null columns, extra columns, empty tables."""
    at, _ = folder
    p = " ".join(f"q{i}" for i in range(200))
    rows = [(1, p + " one", "en", "s"), (1, p + " one", "en", "s"), (1, "two " + p, None, None), (None, p, "en", "s"), (None, None, "en", "s"), (2, "", "en", "s")]
    d = spark.createDataFrame([(*r, None, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for docs in (d, d.limit(0)):
        for name, stage in P.STAGES:
            docs = stage(spark, docs, at).cache()
            n = docs.count()
            assert n == 0 or name == "packing" or docs.columns == list(P.COLUMNS)
    assert P.drop_near_copies(spark, d, at).count() == 6
    left = [(r.doc_id, r.text) for r in P.drop_repeats(spark, d, at).collect()]
    # p stays in the first row of doc 1; its equal row and the row without an id lose all, and the third its p
    assert sorted(left, key=str) == sorted([(1, p + " one"), (1, "two "), (None, None), (2, "")], key=str)


def test_stages_with_a_very_long_text(spark, folder):
    at, _ = folder
    t = " ".join(f"w{i % 7919}" for i in range(200_000))
    docs = spark.createDataFrame([(1, t, "en", "s", None), (2, t[:3000] + " tail", "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, at).cache()
        assert docs.count() > 0
        if name == "repeated_strings":  # the text is its own period over and over, and the other one is a part of it
            assert {r.doc_id: len(r.text) for r in docs.collect()} == {1: len(" ".join(f"w{i}" for i in range(7919))) + 1, 2: 5}
