"""Queries that apply the operators to their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.catalog.base import table
from tokenmill.llm import (
    binary_packing, byte_cnn, chunk_pieces, extendible, jaccard_prefixes, maxent, merkle, near_dedup, oracles, passages, path_templates,
    permutations, segment_mining, whitening,
)
from tokenmill.llm.batches import crc_bucket

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_circulant_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate group of every document: four words, similarity of 0.8 or more."""
    return near_dedup.groups(table(spark, sf, "documents"), width=4, share=(80, 100))


@query
def op2_byte_cnn(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf, "documents")
    found = byte_cnn.identify(docs, crc_bucket("doc_id", 4) != 2)
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


#: Bytes of text that a shard of the given tables may hold; 128 MiB is the operator's default for large corpora.
SHARD_BYTES = 1 << 20


@query
def op3_extendible_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shard of every document, none over the byte limit."""
    return extendible.assign(table(spark, sf, "documents"), SHARD_BYTES)


@query
def op4_attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learned from the labels of four fifths of them."""
    docs = table(spark, sf, "documents")
    scored = passages.score(docs, table(spark, sf, "labels"), crc_bucket("doc_id", 5) != 0)
    return scored.select(
        "doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op5_merkle_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document, its edited form, and their likeness."""
    marks = merkle.against_edits(table(spark, sf, "documents"))
    return marks.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.size("edits").alias("n_edits"), F.get(F.col("edits.start"), 0).alias("first_edit"),
    )


@query
def op6_maxent_scores(spark: SparkSession, sf: str) -> DataFrame:
    """log10 probability of every document, learned from nine tenths of them."""
    scored = maxent.score(table(spark, sf, "documents"), crc_bucket("doc_id", 10) != 0)
    return scored.withColumn("held_out", crc_bucket("doc_id", 10) == 0)


@query
def op7_binary_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Power-of-two pieces of every document; the digest of a piece is taken from its ids."""
    pieces = binary_packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


#: Host, path and verdict of the given rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op8_path_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and verdict of every page; pages without a rule are judged by their path template."""
    judged = path_templates.judge(table(spark, sf, "pages"), RULES)
    return judged.withColumn("purity", F.round("purity", 9))


@query
def op9_chunk_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and decoded text of every document as digests."""
    coded = chunk_pieces.encode(
        table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True
    )
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return permutations.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_weighted_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """First 32 whitened components of every vector."""
    white = whitening.whiten(table(spark, sf, "embeddings"), components=32)
    part = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return white.select("vec_id", "n", "deviation", "identity_error", part).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )


@query
def op12_jaccard_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents connected by shared shingles of four words, similarity of 0.85 or more."""
    return jaccard_prefixes.groups(table(spark, sf, "documents"), width=4, share=(85, 100))


#: Positives of an anchor, negatives of each, and the percentages of the positive's score they may have.
POSITIVES, NEGATIVES, BAND = 5, 5, (80, 100, 100)


@query
def op13_segment_mining(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100; every seventh label is moved first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").withColumn("label", moved)
    return segment_mining.mine(vectors, F.col("vec_id") % 100 == 0, POSITIVES, NEGATIVES, BAND)


ORACLES["op1_circulant_minhash"] = oracles.near_duplicates(4, 80)
ORACLES["op3_extendible_shards"] = oracles.shards(SHARD_BYTES)
ORACLES["op8_path_templates"] = oracles.url_verdicts(RULES)
ORACLES["op12_jaccard_prefixes"] = oracles.jaccard_components(4, 85)
ORACLES["op13_segment_mining"] = oracles.hard_negatives(POSITIVES, NEGATIVES, BAND)
