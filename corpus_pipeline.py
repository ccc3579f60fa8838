"""A corpus pipeline of five operators over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but
the last return the columns of documents.  The last returns the mixture: a row for each
time a document is taken, with the words it adds in all (``taken``) and ``repeat``.

Defined results: documents with a null id are judged by their text like all others; null and
empty texts, and texts without words, aren't toxic, have no duplicates and hold nothing to
find, so they reach the mixture, which takes none of their words; rows of one id with different
texts are different documents, repeated rows copies of one; a null source is a source of its own;
further columns stay as they are, but for ``taken`` and ``repeat``; texts of any length are taken
whole; an empty table of documents gives an empty mixture, without labels nothing is toxic, and
without benchmark items nothing contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfold.llm import decontamination, jaccard_join, mixing, pii, toxicity
from holdfold.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
