"""Streaming queries: driver rows arrive as files, results are compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.catalog.base import query, table
from tokenmill.catalog.metrics import EMA_SQL, LOG, STOP_SQL, step_log
from tokenmill.operators import turns as t
from tokenmill.operators.tokens import byte_vocab
from tokenmill.plans.session import scratch_path
from tokenmill.streaming import jobs


def _feed(spark, df, order=None, per_batch=20_000):
    """Write a table as a feed; with ``order`` in batches that arrive one after the other."""
    path = scratch_path(spark, "feed")
    if order is None:
        df.write.parquet(path)
        return path
    # The table is cut into batches once; then each batch reads its own rows alone.
    cut = scratch_path(spark, "batches")
    df.withColumn("__batch", F.expr(f"{order} div {per_batch}")).repartition("__batch").write.partitionBy("__batch").parquet(cut)
    for (batch,) in spark.read.parquet(cut).select("__batch").distinct().orderBy("__batch").collect():
        spark.read.schema(df.schema).parquet(f"{cut}/__batch={batch}").coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)
    return path


def _run(spark, stream):
    out, at = scratch_path(spark, "out"), scratch_path(spark, "progress")
    jobs.run_available(stream, out, at)
    return spark.read.parquet(out)


@query("st1_stream_corpus", "SELECT doc_id, strlen(text) + 1 AS n_tokens FROM documents")
def stream_corpus(spark, sf):
    docs = jobs.stream_corpus(spark, f"{sf}/documents.parquet", table(spark, sf, "documents").schema)
    tokens = jobs.stream_tokens(docs, byte_vocab(spark), ["doc_id"], bos=256)
    return _run(spark, tokens.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens")))


@query("st2_stream_ema", EMA_SQL)
def stream_ema(spark, sf):
    log = step_log(spark, sf).select("run", "step", "loss")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(_feed(spark, log, "step"))
    return _run(spark, jobs.stream_ema(stream, 0.93)).select("run", "step", "smooth", "debiased")


@query("st3_stream_early_stop", LOG.replace("WITH", "WITH RECURSIVE") + ", v AS (SELECT run, step, loss AS value FROM l)"
       + STOP_SQL.format(delta="0.05::DOUBLE", patience=40))
def stream_early_stop(spark, sf):
    log = step_log(spark, sf).select("run", "step", F.col("loss").alias("value"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(_feed(spark, log, "step"))
    return _run(spark, jobs.stream_early_stop(stream, 40, 0.05))


@query("st4_stream_limits", """
    WITH f AS (
        SELECT conv_id, count(*) AS n, sum(length(text)) AS total, max(length(text)) AS longest, bool_or(length(text) = 0) AS empty,
               bool_or(role NOT IN ('user', 'assistant')) AS bad_role FROM conversations GROUP BY conv_id)
    SELECT conv_id, concat_ws(',', CASE WHEN n > 6 THEN 'too_many_messages' END, CASE WHEN empty THEN 'empty_content' END,
        CASE WHEN longest > 900 THEN 'message_too_long' END, CASE WHEN total > 2500 THEN 'conversation_too_long' END,
        CASE WHEN bad_role THEN 'invalid_role' END) AS reasons, NOT (n > 6 OR empty OR longest > 900 OR total > 2500 OR bad_role) AS accepted FROM f""")
def stream_limits(spark, sf):
    nested = t.to_nested(table(spark, sf, "conversations"))
    small = {**t.LIMITS, "max_messages": 6, "max_message_chars": 900, "max_total_chars": 2500}
    stream = spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", 1).parquet(_feed(spark, nested))
    return _run(spark, jobs.stream_limits(stream, small)).select("conv_id", F.array_join("reasons", ",").alias("reasons"), "accepted")
