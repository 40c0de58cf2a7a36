"""Conversation files: one JSON array of messages per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.messages import MESSAGES, alternates
from tokenmill.functions.text import strip


def _reason(messages):
    size = F.size(messages)
    return (
        F.when(messages.isNull(), "no_json_list").when(size < 2, "too_few_messages")
        .when(F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull()), "missing_field")
        .when(~alternates(messages, system=False), "roles_do_not_alternate")
    )


def read_conversations_jsonl(spark: SparkSession, path: str, mode: str = "fail"):
    """Conversations ``(line, messages)`` of JSON lines; blank lines are skipped.

    ``fail`` raises at the first bad line that is read. ``quarantine`` returns
    (conversations, bad lines with their reason).
    """
    lines = spark.read.text(path).select(strip("value").alias("line")).filter("line <> ''")
    is_list = F.col("line").startswith("[")
    parsed = lines.withColumn("messages", F.when(is_list, F.from_json("line", MESSAGES)))
    judged = parsed.withColumn("reason", _reason(F.col("messages")))
    if mode == "quarantine":
        return (
            judged.filter("reason is null").select("messages"),
            judged.filter("reason is not null").select("line", "reason"),
        )
    checked = F.when(F.col("reason").isNull(), F.col("messages")).otherwise(
        F.raise_error(F.concat(F.lit("Bad conversation: "), "reason")).cast(MESSAGES)
    )
    return judged.select(checked.alias("messages"))


def write_conversations_jsonl(conversations: DataFrame, path: str) -> None:
    """Write ``messages`` as JSON lines; roles must alternate from the user."""
    valid = alternates(F.col("messages"), system=False)
    line = F.when(valid, F.to_json(F.col("messages").cast(MESSAGES))).otherwise(
        F.raise_error(F.lit("Roles do not alternate")).cast("string")
    )
    conversations.select(line.alias("value")).write.text(path)
