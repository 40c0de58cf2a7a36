"""From raw documents to packed sequences: language, quality, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import binary_packing, byte_cnn, near_dedup, passages
from tokenmill.llm.batches import crc_bucket
from tokenmill.plans.session import cut_lineage

#: A text stays unless its likeliest language is near guessing; texts of several languages are well above.
LEAST_LANGUAGE = 0.3
#: A text stays from this quality score on.
LEAST_QUALITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without letters or of no clear language go.

    A null or empty text has no letter and goes. Repeated rows and null ids are judged each for itself; an empty table stays
    empty, and without labelled texts to learn from every text goes. All given columns are kept.
    """
    found = byte_cnn.identify(docs, crc_bucket("doc_id", 4) != 2, carry=True)
    return found.where((F.col("lang_pred") != byte_cnn.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, as learned from the labels of four fifths of them.

    A null text is scored as an empty one. Repeated rows and null ids are judged each for itself; an empty table stays
    empty. All given columns are kept.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = passages.score(docs, labels, crc_bucket("doc_id", 5) != 0, carry=True)
    return scored.where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8 or more): the one with the smallest id.

    Rows are compared by their texts, each for itself: rows that share an id but not a text are no copies of each other, and
    of equal or near texts without an id one stays, unless a row with an id is among them. Rows with a null or empty
    text, or one without words, stay. Ties go to the row that comes first.
    """
    rows = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_dedup.groups(rows, id_col="__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__row")
    first = found.join(rows.select("__row", "doc_id"), "__row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first.__row"), "__row", "left_semi").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length.

    A null or empty text is the end id alone. Repeated rows and null ids are packed each for itself; an empty table gives no rows.
    """
    return binary_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

#: No stage but the last can be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
