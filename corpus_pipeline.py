"""A training corpus from documents: toxicity, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns of documents, and
so have the results of all stages but the last, whose rows are the pieces of
the packed sequences. run() writes each stage's result as Parquet to the shared
folder and reads it again as the next one's docs. Empty tables give empty
results in every stage; null texts are empty ones, which no stage but the
near-duplicates' drops; columns besides text pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate as leaks
from gridloom.llm import packing, pii, simhash, toxicity
from gridloom.llm.common import docs_of, staged

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the operator's rejection threshold. The model learns from a bounded sample of all labelled rows."""
    model = toxicity.train(docs, docs_of(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, out_col="__toxicity")
    return scored.where(F.col("__toxicity.score") < toxicity.REJECT).drop("__toxicity")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: SimHash of five-word shingles, linked at an estimated similarity of 0.8. Null and blank texts are one group."""
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: eight equal words in a row leak the item, be it one or several."""
    found = leaks.find_contamination(docs, docs_of(spark, sf_dir, "benchmark"), out_col="__contamination")
    return found.where(F.size("__contamination.items") == 0).drop("__contamination")


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text where it changes."""
    found = pii.sanitise(docs, out_col="__pii")
    changed = F.size("__pii.spans") > 0
    return found.select(*[F.when(changed, F.length("__pii.text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col("__pii.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.digested(packing.pack(docs))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_copies), ("decontamination", drop_leaks), ("pii", hide_persons), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
