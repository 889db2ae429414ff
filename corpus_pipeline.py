"""A corpus from raw documents: toxic ones go, near duplicates go, benchmark leaks go, secrets are masked, sources are mixed.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``sf_dir`` holds the tables
``labels`` and ``benchmark``. All stages but the last give the columns of their input. SQL can't express a trained classifier,
so there is no ORACLE_SQL; tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm import _store, decontam, minhash, mixing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score toxicity.THRESHOLD or more go."""
    model = toxicity.train(toxicity.sample(docs, _store.read(spark, sf_dir, "labels")))
    return toxicity.below(docs, model, toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document of the smallest doc_id stays; rows without doc_id stay."""
    return minhash.without_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, _store.read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; live-looking secrets in their texts are masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): how often each document is taken."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _store.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        began = _store.mark()
        docs = _store.table(stage(spark, docs, sf_dir), name)
        _store.forget(began)
    return docs
