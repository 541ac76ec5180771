"""A corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept, read again from Parquet. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.functions.session import ship
from lodestar.llm import exact_dedup, packing, pii, quality, simhash_wide
from lodestar.llm.common import fresh_path, read_table
from lodestar.llm.queries import VOCAB


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    A null or empty text gets the share of good labels, and so stays unless most
    labels are bad; without labels that match every document stays. Repeated rows
    stay or go together, whatever other columns hold; an empty table stays empty.
    """
    ship(spark)
    return quality.keep(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id.

    Null texts equal empty ones; a null id is smallest; of rows that repeat id
    and text exactly one stays, with all its columns; an empty table stays empty.
    """
    ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the smallest id.

    Near copies share 0.8 or more of their five-word shingles, or are joined by
    such; about one pair in ten at 0.8 itself is missed, fewer above. Null texts and those without words are one group; a null id is largest; of equal ids the smallest text hash stays, of rows that repeat
    both any one; an empty table stays empty.
    """
    ship(spark)
    return simhash_wide.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data in the texts.

    A null text stays null and an empty one empty; `n_chars` is counted anew for
    texts that are not null; all other columns pass as they are; repeated rows
    stay repeated; an empty table stays empty.
    """
    ship(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two.

    A null or empty text is its end id alone; repeated rows are packed each; an
    empty table gives no sequences.
    """
    ship(spark)
    return packing.pack(docs, VOCAB)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("pii", redact),
    ("packing", pack),
]

#: SQL cannot express the classifiers; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what stands between them is in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
