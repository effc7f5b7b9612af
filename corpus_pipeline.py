"""The corpus pipeline: quality rules, near duplicates, secrets, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the last return the
columns of documents; each result is written as Parquet and read again as the next one's docs.

In every stage an empty table gives an empty one, null and empty texts are allowed, columns beyond those of documents stay (until
packing), whatever their names, and nulls in lang, source and n_chars are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm.common import Work, table
from riskframe.llm.mixing import mixed
from riskframe.llm.near_dedup import drop_near_duplicates
from riskframe.llm.packing import pack
from riskframe.llm.quality import drop_low_quality
from riskframe.llm.secrets import redacted


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go.

    A null or short text fails. Each row is judged by itself, also if it repeats an id or has none.
    """
    return drop_low_quality(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Rows that repeat an id are one document, of which one row stays. Rows without an id or without words all stay.
    """
    return drop_near_duplicates(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, and n_chars is counted anew. A null text and its count stay null."""
    return redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it. Texts without words are in no mix.

    Rows that repeat id, source and text are one document, as often as all of them are taken.
    """
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. Every row is a document of its own; a null text is its end alone."""
    return pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table, after all stages. A stage's own tables are deleted once its result is written."""
    docs, work, before = table(spark, sf_dir, "documents"), Work(spark, "pipeline"), None
    mark = len(Work.opened)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.save(docs, name.replace(" ", "-"))
            Work.clear(mark)
            if before is not None:
                work.drop(before)
            before = docs
    return docs


#: Signatures, robust estimates and token ids have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
