"""A corpus from documents to packed sequences, in stages that each work on all that the one before kept.

Each stage takes (spark, docs, sf_dir). All but the last return docs' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.llm import decontam, jaccard, packing, secrets, toxicity
from crawlweave.llm.registry import tokenizer_files
from crawlweave.runtime import dropped, new_path, ship, small, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores below its threshold."""
    ship(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.kept(docs, model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that sets of five-word shingles link at a similarity of 0.8 or more: the least doc_id.

    Rows without doc_id stay, and so do all rows of a doc_id that stays; an id whose rows have different texts goes as a whole if any of
    them is linked to a smaller id."""
    ship(spark)
    found = jaccard.jaccard_components(docs, words=5, num=80, den=100)
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("gone"))
    return rows.join(small(gone), "gone", "left_anti").select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, with their own columns, whatever their names."""
    ship(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    ship(spark)
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = secrets.scan(versions, new_path(spark, "blob-ledger"))
    return secrets.redacted(docs, found.select("blob", "spans"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into sequences."""
    ship(spark)
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_tokens),
]

#: SQL can't express the classifier, the tokenizer or the packing. tests/llm/test_pipeline.py holds the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        old, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(old)
    return STAGES[-1][1](spark, docs, sf_dir)
