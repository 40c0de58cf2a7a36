"""Run reports: metric extraction, the summary pivot and the wall clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import strip

# Sections of a report in reading order, and the metrics of the summary.
SECTIONS = (
    "tokenizer-training", "tokenizer-evaluation", "base-model-training", "base-model-loss",
    "base-model-evaluation", "midtraining", "chat-evaluation-mid", "chat-sft",
    "chat-evaluation-sft", "chat-rl", "chat-evaluation-rl",
)
STAGES = ("base", "mid", "sft", "rl")
CHAT_METRICS = ("ARC-Easy", "ARC-Challenge", "MMLU", "GSM8K", "HumanEval", "ChatCORE")
STAGE_SECTIONS = {
    "base-model-evaluation": ("base", ("CORE",)),
    "chat-evaluation-mid": ("mid", CHAT_METRICS),
    "chat-evaluation-sft": ("sft", CHAT_METRICS),
    "chat-evaluation-rl": ("rl", ("GSM8K",)),
}


def extract_metrics(lines: DataFrame, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """Value of each key per report and section, the last line winning.

    ``lines(report, section, line_no, line)``. With ``exact=False`` a line counts for every
    key it contains, so ``MMLU`` is also read from an ``MMLU-Pro`` line.
    """
    fields = F.split("line", ":")
    value = strip(F.get(fields, F.lit(1)))
    if exact:
        name = F.regexp_replace(strip(F.get(fields, F.lit(0))), r"^-\s*", "")
        base = F.regexp_replace(name, r"( metric| accuracy)$", "")
        found = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: (k == name) | (k == base))
    else:
        found = F.filter(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(F.col("line"), k))
    hits = lines.select("report", "section", "line_no", value.alias("value"), F.explode(found).alias("metric"))
    return hits.filter("value is not null").groupBy("report", "section", "metric").agg(
        F.max_by("value", "line_no").alias("value")
    )


def stage_metrics(lines: DataFrame, exact: bool = True) -> DataFrame:
    """``(report, stage, metric, value)`` from the sections that feed the summary."""
    out = None
    for section, (stage, keys) in STAGE_SECTIONS.items():
        part = extract_metrics(lines.filter(F.col("section") == section), keys, exact).select(
            "report", F.lit(stage).alias("stage"), "metric", "value"
        )
        out = part if out is None else out.unionByName(part)
    return out


def report_summary(metrics: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Metrics by stages, CORE first and ChatCORE last, '-' where a value is missing."""
    wide = metrics.groupBy("report", "metric").pivot("stage", list(stages)).agg(F.max("value"))
    place = F.when(F.col("metric") == "CORE", 0).when(F.col("metric") == "ChatCORE", 2).otherwise(1)
    return wide.select(
        "report", place.alias("place"), "metric", *[F.coalesce(s, F.lit("-")).alias(s) for s in stages]
    )


def wall_clock(lines: DataFrame) -> DataFrame:
    """Time from the report header to the last section that is not about RL, as ``XhYm``."""
    at = F.try_to_timestamp(
        strip(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)), F.lit("yyyy-MM-dd HH:mm:ss")
    )
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    start = F.when((F.col("section") == "header") & F.col("line").startswith("Run started:"), at)
    timed = F.col("line").startswith("timestamp:") & (order > 0) & ~F.contains(F.col("section"), F.lit("rl"))
    per = lines.groupBy("report").agg(
        F.min(start).alias("start_time"), F.max_by(F.when(timed, at), F.when(timed, order)).alias("end_time")
    )
    seconds = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))
    hours = F.floor(seconds / 3600)
    clock = F.concat(hours, F.lit("h"), F.floor((seconds - hours * 3600) / 60), F.lit("m"))
    return per.select("report", seconds.alias("seconds"), F.coalesce(clock, F.lit("unknown")).alias("wall_clock"))
