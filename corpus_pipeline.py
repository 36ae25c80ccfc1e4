"""From raw documents to packed training tokens: five stages, each the work of one operator.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

1. toxicity: documents that the classifier rejects go.
2. near-duplicates: one document of each component stays; links are similarities of 0.8 or more.
3. decontamination: documents with a benchmark window go.
4. mixing: documents are repeated, or left out, to meet the sources' targets.
5. tokens: what is left is packed into token files, and their digest is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from closebook.llm import bitpack, decontam, mixing, neardup, toxicity
from closebook.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bitpack.read_digests(spark, bitpack.write_tokens(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", pack_tokens),
]

#: The classifier, the similarity components and the tokenizer have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
