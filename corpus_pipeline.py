"""The pipeline from raw documents to token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonepoint.llm import mixing, pieces, pii, toxicity
from lonepoint.llm.near_dedup import one_of_each_group
from lonepoint.llm.workload import piece_model, table
from lonepoint.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject; it is trained on the labelled ones among ``docs``.

    Rows with null or empty text stay; an empty table stays empty.
    """
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id.

    Rows without id are documents of their own and all stay; see ``one_of_each_group``.
    """
    return one_of_each_group(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in ``text`` masked and ``n_chars`` counted anew."""
    return pii.mask_pii(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, zero to three times."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ends, decoded`` of every row: piece ids, the byte where each ends, the text of the ids."""
    encoded = pieces.encode(docs, piece_model())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ends", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The classifier, the rounding and the encoding cannot be expressed in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
