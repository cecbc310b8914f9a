"""From raw documents to token counts: language, toxicity, near-duplicates, benchmark passages, tokens.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept; what it returns is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Cases: rows without words go in the first stage, as no language is likely; an empty table stays empty; no labels: nothing is toxic; no benchmark: nothing is
contaminated. Repeated rows are copies, of which one stays; rows of one id with unlike texts all stay. Rows with a null id stay until the end. Ties in language go to the
first in order. Very long texts are taken whole. Extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import bpe, decontaminate, language_id, near_dedup, toxicity
from vellumine.llm.queries import default_tokenizer, table
from vellumine.plans.scratch import Scratch, prepare


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told."""
    prepare(spark)
    return language_id.keep_identified(spark, docs, language_id.fit(spark, docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic by a model of the labelled rows."""
    prepare(spark)
    return toxicity.drop_toxic(spark, docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: shingles of five words, similarity 0.8."""
    prepare(spark)
    return near_dedup.deduplicate(spark, docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark."""
    prepare(spark)
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    prepare(spark)
    return bpe.encode_documents(spark, docs, default_tokenizer(), ("ids_sha256", "decoded_sha256"))


STAGES = [("language_id", languages), ("toxicity", not_toxic), ("near_dedup", one_of_each), ("decontamination", decontaminated), ("bpe", tokens)]

#: Trained models, set similarity and tokenisation are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
