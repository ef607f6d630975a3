"""A training-data pipeline over documents: five stages, each one of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. Stages 1 to 4 return the columns of documents:

1. quality: documents that fail the base rules or lie outside their group's robust estimate go.
2. near_duplicates: of each component of near-duplicate fingerprints and of texts whose five-word shingles have a
   similarity of 0.8 or more the least doc_id stays.
3. personal_data: spans of personal data are masked and n_chars is brought up to date.
4. mixing: each document is repeated as often as its source's target asks.
5. encoding: doc_id, n_tokens, ids, and digests of the ids and of the text they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modgauge.llm import bpe, mixing, pii, quality_rules, simhash
from modgauge.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and short texts go; repeated rows are judged alike; an empty table stays empty."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a word are near-duplicates of one another; rows that repeat id and text become one; ties go to the least doc_id."""
    return simhash.deduplicated(docs, alike=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; null texts stay null, repeated rows are masked alike, and an empty table stays empty."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source; no document comes more than three times; an empty table stays empty."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no ids; repeated rows are encoded one by one; an empty table gives no row."""
    return bpe.encoded(docs, bpe.word_vocabulary(), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("encoding", encoding)]

#: Robust estimates, connected components over XXH64 and BPE are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
