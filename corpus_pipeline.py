"""Corpus preparation in four stages; belongs to the optional training-data subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stillframe.llm import packing, pii, quality, simhash
from stillframe.llm.common import Files, shared_folder
from stillframe.llm.queries import BYTE_BPE, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go: null and empty texts
    among them.  Repeated rows are judged alike; an empty table, or one without labels, loses
    what the base rules reject."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, rules)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8, the
    smallest id (null ids last).  Repeated rows count once; texts without words are one group; an
    empty table stays empty."""
    return simhash.keep_one(docs, width=5, similar=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text.  Null texts stay null, rows
    that share ids or texts are redacted each; an empty table stays empty."""
    return pii.with_lengths(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids.  A null or empty text is its end id;
    rows that share ids are documents of their own; an empty table has no pieces."""
    return packing.pack(docs, tokenizer_path(BYTE_BPE), room=1024, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]

#: The stages learn rules, hash shingles and use a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written as Parquet in the folder that the
    cluster shares and read again as the next one's input.  A stage's table is deleted when
    the next one's is written; the last one that is read stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            Files(folder).drop(str(i - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
