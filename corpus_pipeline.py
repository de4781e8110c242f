"""A training-data pipeline: documents in, packed token sequences out.

Each stage calls one operator of ``topiloom.llm`` on all rows that the stage before
has kept.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topiloom.llm import decontam, langid, minhash, packing, secrets
from topiloom.llm.common import cut, table
from topiloom.llm.queries import default_tokenizer
from topiloom.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or a clear language go."""
    return langid.drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in the packed sequences."""
    return packing.pack_documents(docs, default_tokenizer())


def _stage(operator):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return operator(spark, docs, sf_dir)

    return operator.__name__, run_stage


STAGES = [_stage(f) for f in (language_id, near_dedup, decontamination, secret_scan, best_fit_packing)]

# The first stage is a trained model and the last a tokenizer and a local search,
# which SQL cannot express; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
