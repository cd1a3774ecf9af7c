"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays,
contaminated documents go, and what is left is packed into sequences.

Nulls, repeats and empties, at every stage: a null text is an empty one, and may come out as either; rows that repeat are rows of their own (all
copies of a line, or of a document, go but the first); an empty table gives an empty one; without labels of both kinds nothing is toxic; an
empty benchmark rejects nothing.

STAGES names the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.llm import decontaminate, line_dedup, packing, simhash, toxicity
from geolith.llm.common import cut, labelled_sample

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.select("doc_id", "text", "lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of these documents; those scored 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(labelled_sample(docs, labels, "toxic", 5, 0, toxicity.BOUND))
    return _as_documents(toxicity.score(docs, model, with_spans=False).where("score < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or one within two edits of it, go; every document stays."""
    return _as_documents(line_dedup.dedup_lines(docs, shortest=1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays: the one of the smallest doc_id, of rows that share it the first;
    rows without an id come last. Rows are told apart by a number of their own."""
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "simhash-rows")
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    stay = found.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return _as_documents(rows.join(stay.select("first.row"), "row", "left_semi"))


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which windows of two benchmark items or more occur go, and so do those that hold half or more of one item."""
    found = decontaminate.find_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _as_documents(found.where(~(decontaminate.contaminated() | decontaminate.holds_item())))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its sequence and place in it."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", reject_contaminated),
    ("best_fit_packing", pack),
]

#: A learned model, fingerprints and a tokenizer: none of the stages but one can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
