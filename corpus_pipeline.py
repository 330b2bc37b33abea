"""A training-data pipeline over the documents table: reject, deduplicate, cut, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept. All but the last return the columns of documents, whatever else their
names are. Null texts count as empty; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import jaccard, mixing, packing, substring, toxicity
from paperloom.llm.store import drop, scope, table
from paperloom.session import ship


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go, each row by its own text: rows that share a doc_id or have none are judged each, equal texts alike. Rows without text have the score of no evidence."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id (rows without one come last; of equal rows one stays). Rows without words all stay."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that start in a document with a smaller doc_id are cut from the texts; n_chars follows. No row goes; rows without a doc_id, and rows that share one, cut nothing from each other."""
    found = substring.remove_repeats(docs, as_is=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources come nearer to equal weight. Null sources and languages are a category of their own; rows that share a doc_id stay or go together."""
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 4096: every row, empty ones with the end id only."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Toxicity scores and token ids are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. Tables of a stage go when its rows are written, and these when the next stage's are."""
    docs, folder = table(ship(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs, after = keep(stage(spark, docs, sf_dir), name)
        if folder:
            drop(spark, folder)
        folder = after
    return STAGES[-1][1](spark, docs, sf_dir)
