"""A training corpus from raw documents: five stages, each one operator of siltstone.llm.

Each stage works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the packed pieces. `run` cuts lineage between stages in the
cluster's shared checkpoint folder, so that a stage's passes do not repeat the stages
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.batches import bounded_batches
from siltstone.llm.decontaminate import drop_contaminated
from siltstone.llm.jaccard import keep_one_of_each
from siltstone.llm.packing import pack
from siltstone.llm.queries import vocabulary_path
from siltstone.llm.secrets import redact_secrets
from siltstone.llm.toxicity import fit_toxicity, keep_clean
from siltstone.session import ensure_checkpoint_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, rejects go."""
    bounded_batches(spark)
    return keep_clean(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles, the one of least id stays."""
    bounded_batches(spark)
    return keep_one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    bounded_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; n_chars follows."""
    bounded_batches(spark)
    return redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become token pieces, placed in sequences of at most 2048 tokens."""
    bounded_batches(spark)
    return pack(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

#: Classifier, sketches and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = docs.checkpoint()
    return docs
