"""Evaluation bundles and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.text import strip
from tokenmill.sources.files import numbered_lines


def read_eval_bundle(spark: SparkSession, folder: str, tasks: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(items, task table) of an evaluation bundle.

    ``tasks`` are the entries of the bundle's configuration (label, icl_task_type, dataset_uri,
    num_fewshot, continuation_delimiter). Items keep their line as VARIANT, since tasks differ
    in shape; baselines come from the bundle's CSV on a 0-100 scale.
    """
    folder = folder.rstrip("/")
    meta = spark.createDataFrame(
        [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]), t.get("continuation_delimiter", " "))
         for t in tasks],
        "task string, task_type string, dataset_uri string, num_fewshot int, delimiter string",
    )
    base = spark.read.csv(f"{folder}/eval_meta_data.csv", header=True).select(
        F.col("Eval Task").alias("task"), F.col("Random baseline").try_cast("double").alias("baseline")
    )
    files = [f"{folder}/eval_data/{t['dataset_uri']}" for t in tasks]
    rows = numbered_lines(spark, files).select(
        F.col("__f").alias("__p"), F.col("line_no").alias("__n"), F.col("line").alias("__l")
    ).filter(strip("__l") != "")
    found = F.regexp_extract("__p", r"/eval_data/(.+)$", 1)
    # A task's data may also be a folder of files.
    uri = F.when(found.isin(*[t["dataset_uri"] for t in tasks]), found).otherwise(
        F.regexp_replace(found, r"/[^/]+$", ""))
    items = rows.withColumn("dataset_uri", uri).join(meta, "dataset_uri").select(
        "task", "task_type", F.concat_ws("#", found, "__n").alias("item_id"), F.parse_json("__l").alias("item")
    )
    return items, meta.join(base, "task", "left")


def write_metrics_csv(metrics: DataFrame, path: str, composite: float | None = None) -> None:
    """``Task, Accuracy, Centered`` lines of a metric table, with the composite as CORE."""
    line = metrics.select(
        F.col("task").alias("Task"), F.format_string("%.6f", "accuracy").alias("Accuracy"),
        F.format_string("%.6f", "centered").alias("Centered"),
    )
    if composite is not None:
        core = metrics.sparkSession.createDataFrame(
            [("CORE", None, f"{composite:.6f}")], "Task string, Accuracy string, Centered string")
        line = line.unionByName(core)
    line.coalesce(1).write.csv(path, header=True)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(task, accuracy, centered)``; cells are padded and may be blank."""
    raw = spark.read.csv(path, schema="task string, accuracy string, centered string", header=False)
    number = lambda c: strip(c).try_cast("double").alias(c)
    return raw.select(strip("task").alias("task"), number("accuracy"), number("centered")).filter(
        (F.col("task") != "Task") & (F.col("task") != "")
    )
