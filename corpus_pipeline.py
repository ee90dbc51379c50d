"""A corpus pipeline of five stages over `documents`; each works on what the one before it kept.

Defined cases, for every stage: empty tables give empty results; columns besides those of documents are left
behind; null lang, source and n_chars do no harm. Null and empty texts are not toxic, nobody's copy and without
repeats, and stay. Rows with a null doc_id stay in the second stage, and rows of equal doc_id share their fate
there; in the third, which cuts texts, one place keeps a repeated string, so that of equal rows one stays whole
and the others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import jaccard, mixing, packing, storage, suffixes, toxicity
from siftwork.llm.common import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated string that the third stage removes: about fifty short words.
PASSAGE = 250


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from the labels, does not reject."""
    docs = docs.select(*COLUMNS)
    grammar = toxicity.learn(docs, toxicity.training(table(spark, sf_dir, "labels")))
    return toxicity.clean(docs, grammar)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id."""
    docs = docs.select(*COLUMNS)
    found = jaccard.near_duplicates(docs).where("doc_id = component_id OR doc_id IS NULL").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE bytes that occur before, in a document of smaller id or in the same one.

    A text of which nothing is left goes; one that was null or empty before stays."""
    docs = docs.select(*COLUMNS)
    cut = suffixes.remove_repeats(docs, length=PASSAGE, first=True, carry=("lang", "source", "n_chars"))
    left = cut.where((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the budgets that target weights give their domain, language and source; at most two epochs of a document."""
    docs = docs.select(*COLUMNS)
    targets = mixing.weights_of(spark.createDataFrame(mixing.TARGETS, "domain string, lang string, source string, weight double"))
    return mixing.mix(docs, share=1.0, epochs=2, weights=targets).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_strings", drop_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]
#: No stage but the fourth's counting is expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, storage.saved(stage(spark, docs, sf_dir))
        storage.discard(before)  # the table of the stage before; nothing was written for the first
    return docs
