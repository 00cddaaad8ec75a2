"""A training corpus from raw documents, as five stages that are each written and read again.

Quality rules drop junk, the similarity join keeps one document of each group of near copies, documents
that hold benchmark windows go, personal data is masked, and what is left is encoded.

Defined cases: null and empty texts are rejected by the quality rules; rows that repeat stay or go together, as
the similarity join keeps all rows of the id and text that it keeps; rows with a null id stay there; nulls in other columns, extra columns of any names and very long texts pass through all stages; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuespan.llm import bpe, jaccard, pii, quality_rules, winnow
from cuespan.llm.common import local_file, shared_dir


def small_batches(spark: SparkSession) -> None:
    """This application's sessions send Python workers a few megabytes at once; one value for all stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of the benchmark."""
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked and terms that disclose it generalised or removed."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids."""
    small_batches(spark)
    return bpe.encode(docs, local_file("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality_rules", quality), ("jaccard_join", near_duplicates), ("decontamination", decontaminate), ("pii", personal_data), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


#: The PII and encoding stages are beyond SQL; the tests of both operators compare them with brute-force versions.
ORACLE_SQL = None
