"""Training logs, run reports and sweep tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.text import extract

# Fixed value: tokens per training step in a sweep.
TOKENS_PER_STEP = 524288
SWEEP_SCHEMA = (
    "flops_budget double, depth int, model_dim int, num_params bigint, num_scaling_params bigint, "
    "num_iterations bigint, tokens_trained bigint, param_data_ratio double, val_bpb double, "
    "core_score double, train_time_sec bigint"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of text files; a log or report is one small file."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1).alias("file"),
        F.posexplode(F.split("value", "\n")).alias("line_no", "line"),
    )


def _last(marker: str, value: Column) -> Column:
    """Value of the last line that holds the marker."""
    return F.max_by(value, F.when(F.contains(F.col("line"), F.lit(marker)), F.col("line_no")))


def parse_train_logs(spark: SparkSession, path: str) -> DataFrame:
    """Figures of training logs, one row per file; a missing CORE metric counts as 0."""
    whole = lambda c: F.regexp_replace(c, ",", "").try_cast("bigint")
    line = F.col("line")
    per = _lines(spark, path).groupBy("file").agg(
        _last("Number of parameters:", whole(extract(line, r"([\d,]+)"))).alias("num_params"),
        _last("Number of parameters:", whole(extract(line, r"scaling: ([\d,]+)"))).alias("num_scaling_params"),
        _last("Calculated number of iterations", whole(extract(line, r"^.*: (.*)$"))).alias("num_iterations"),
        _last("Validation bpb:", extract(line, r"([\d.]+)$").try_cast("double")).alias("val_bpb"),
        _last("CORE metric:", extract(line, r"(\S+)\s*$").try_cast("double")).alias("__core"),
    )
    tokens = F.col("num_iterations") * TOKENS_PER_STEP
    return per.select(
        "file", "num_params", "num_scaling_params", "num_iterations", tokens.alias("tokens_trained"),
        F.round(F.try_divide(tokens.cast("double"), "num_scaling_params"), 2).alias("param_data_ratio"),
        "val_bpb", F.coalesce("__core", F.lit(0.0)).alias("core_score"),
    )


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SWEEP_SCHEMA)


def parse_report(
    spark: SparkSession, path: str, place: str = r"/([^/]+)/([^/]+?)\.[A-Za-z]+$"
) -> DataFrame:
    """``report_lines(report, section, line_no, line)`` of report folders.

    A report is a folder with one text file per section; ``place`` finds both names in a path.
    """
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", place, 1).alias("report"),
        F.regexp_extract("_metadata.file_path", place, 2).alias("section"),
        F.posexplode(F.split("value", "\n")).alias("line_no", "line"),
    )


def report_values(lines: DataFrame) -> DataFrame:
    """``- key: value`` lines as ``(report, section, key, value)``, the last one winning."""
    pattern = r"^- ([^:]+): (.*)$"
    kv = lines.filter(F.col("line").rlike(pattern))
    return kv.groupBy("report", "section", F.regexp_extract("line", pattern, 1).alias("key")).agg(
        F.max_by(F.regexp_extract("line", pattern, 2), "line_no").alias("value")
    )
