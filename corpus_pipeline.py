"""A corpus pipeline: language, toxicity, near-duplicates, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which ``run`` writes as Parquet in the
shared folder and reads again as the next stage's documents.  All stages but the last return the
columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from casegraph.llm import decontamination, language_id, likeness, packing, simhash, toxicity
from casegraph.llm.common import table
from casegraph.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network recognises; the others go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not score as toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group.

    Fingerprints of five-word shingles find most groups; of what they leave, texts whose shingles are
    alike in 0.8 or more, which fingerprints can tell apart, are groups too.
    """
    firsts = simhash.group_firsts(docs, words=5)
    return simhash.rows_of(docs, likeness.alike_firsts(docs, firsts))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.keep_unleaked(docs, table(spark, sf_dir, "benchmark"), decontamination.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in full sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", language),
    ("toxicity", clean),
    ("simhash_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: The stages learn models, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
