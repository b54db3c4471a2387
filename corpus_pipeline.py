"""A corpus from ``documents``: toxic texts go, one of each group of near copies stays, repeated
passages are cut, documents with benchmark passages go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of ``documents``, whatever other columns there are.
Rows with a null or empty text stay until they are packed, and so do rows without a doc_id that no
stage finds fault with; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.cluster import ship
from tidelog.llm import ngram_join, toxicity
from tidelog.llm.decontam import drop_found
from tidelog.llm.packing import pack
from tidelog.llm.queries import TOKENIZER, table
from tidelog.llm.substring import remove_repeats
from tidelog.stage import Stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones, doesn't mark as toxic.

    Each row is judged by its own text: repeated rows go or stay alike, null and empty texts stay,
    and without labels, or without a toxic one, all stay.
    """
    lexicon = toxicity.train(docs, table(ship(spark), sf_dir, "labels"), Stage(spark, "pipeline-toxicity"))
    return toxicity.keep_clean(docs.select(*COLUMNS), lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each component under five-word Jaccard links of 0.8 or more.

    Rows repeated with one doc_id are one document and stay or go together. Rows with a null doc_id
    stay: there is no id by which one of them could be the least.
    """
    found = ngram_join.join(docs, Stage(ship(spark), "pipeline-ngram-join"), k=5, percent=80)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 13-word passages that a document of a smaller doc_id has.

    Rows of one doc_id, with equal texts or not, take nothing from each other, null texts stay null,
    and rows with a null doc_id stay as they are.
    """
    kept = remove_repeats(docs.select(*COLUMNS), Stage(ship(spark), "pipeline-substring"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``.

    Each row is judged by its own text: repeated rows go or stay alike, null and empty texts stay,
    and with an empty ``benchmark`` all stay.
    """
    return drop_found(docs.select(*COLUMNS), table(ship(spark), sf_dir, "benchmark"))


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 1024 tokens; every row has at least its end token."""
    ship(spark)
    return pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("substring", cut_repeats),
    ("decontamination", drop_benchmark),
    ("packing", pack_rest),
]

#: SQL has no words for the tokenizer and the learned lexicon; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again by the next."""
    stage = Stage(ship(spark), "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        docs = stage.save(f(spark, docs, sf_dir), name)
        if last is not None:
            stage.drop(last)
        last = name
    return docs
