"""The corpus pipeline: stages from raw documents to shards, each one of the operators."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from siteindex.llm import decontaminate, mixing, quality, sharding, simhash
from siteindex.llm.common import table, written
from siteindex.llm.queries import labelled_domains
from siteindex.session import configure

#: Shares of the tokens that prose, poor and toxic text are to have.
MIXTURE = {"prose": 0.96, "poor": 0.02, "toxic": 0.02}


def prepared(stage):
    """The stage in a session with small Arrow batches and the package on its workers."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run_stage


@prepared
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject."""
    texts = table(spark, sf_dir, "documents")
    model = quality.fit(texts, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(docs, model) >= quality.THRESHOLD)


@prepared
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of three-word shingles that
    differ in two bits or fewer link."""
    return simhash.one_of_each(docs, simhash.SHINGLE_WORDS, simhash.MAX_BITS)


@prepared
def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of the benchmark."""
    items = table(spark, sf_dir, "benchmark")
    return docs.where(~decontaminate.is_contaminated(docs, items))


@prepared
def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture wants them."""
    labelled = labelled_domains(table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs, labelled, MIXTURE)


@prepared
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; every shard has the mixture of sources."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded),
]

#: A trained classifier decides the first stage; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage returns is written and read again by the next."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
