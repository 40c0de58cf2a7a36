"""Jobs over step logs: smoothing, throughput, best-so-far and early stopping.

A run may hold a large part of all rows, so nothing here windows over a whole run: running
values come from the blocked scan, and smoothing works on bounded chunks of a run.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.plans.scan import dense_index, greedy_chain, ordered_scan
from tokenmill.plans.session import cut_lineage


def ema(step_log: DataFrame, beta: float = 0.9, value: str = "loss") -> DataFrame:
    """Exponential moving average of ``value`` per run, raw and debiased.

    s <- beta * s + (1 - beta) * x from 0, debiased by 1 - beta^n. Rows are cut into chunks
    over which beta^n falls to 1e-100. Inside a chunk the average is a scaled running sum; the
    state carried in comes from the two chunks before, as older ones weigh less than the
    rounding of a double.
    """
    if not 0 < beta < 1:
        raise ValueError("beta must lie between 0 and 1")
    chunk = max(1, math.ceil(-100 * math.log(10) / math.log(beta)))
    # Read twice below, so the narrow table is written once.
    placed = cut_lineage(dense_index(step_log.select("run", "step", value), ["step"], "__i", by=["run"]), "steps")
    rows = placed.select(
        "run", "step", value, F.col("__i"),
        F.expr(f"__i div {chunk}").alias("__c"), F.pmod("__i", F.lit(chunk)).alias("__k"),
    )
    b = F.lit(beta)
    upto = Window.partitionBy("run", "__c").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    local = (1 - b) * F.pow(b, F.col("__k")) * F.sum(F.col(value) * F.pow(b, -F.col("__k"))).over(upto)
    # End state of each chunk as a plain weighted sum: no ordering needed.
    ends = rows.groupBy("run", "__c").agg(
        F.sum((1 - b) * F.pow(b, F.lit(chunk - 1) - F.col("__k")) * F.col(value)).alias("__e")
    )
    by_chunk = Window.partitionBy("run").orderBy("__c")
    carried = ends.select(
        "run", "__c",
        (F.coalesce(F.lag("__e", 1).over(by_chunk), F.lit(0.0))
         + F.pow(b, F.lit(chunk)) * F.coalesce(F.lag("__e", 2).over(by_chunk), F.lit(0.0))).alias("__in"),
    )
    smooth = local + F.pow(b, F.col("__k") + 1) * F.col("__in")
    return rows.join(carried, ["run", "__c"]).select(
        "run", "step", value, smooth.alias("smooth"),
        (smooth / (1 - F.pow(b, F.col("__i") + 1))).alias("debiased"),
    )


def training_progress(
    step_log: DataFrame, tokens_per_step: int, flops_per_token: float, promised_flops: float,
    num_steps: int, warmup: int = 10,
) -> DataFrame:
    """Throughput, utilization and remaining time; the first steps count as warm-up."""
    late = F.when(F.col("step") > warmup, F.col("dt")).otherwise(0.0)
    timed = ordered_scan(
        step_log.select("run", "step", "dt"), ["step"], {"total_time": ("sum", late, True)}, by=["run"]
    )
    done = F.col("step") - warmup
    rate = F.lit(float(tokens_per_step)) / F.col("dt")
    return timed.select(
        "run", "step",
        F.floor(rate).alias("tokens_per_sec"),
        (100.0 * F.lit(flops_per_token) * rate / F.lit(promised_flops)).alias("mfu"),
        F.col("total_time").alias("total_time"),
        F.when(done > 0, ((num_steps - F.col("step")) * F.col("total_time") / done)).alias("eta"),
    )


def running_best(metrics: DataFrame, mode: str = "min") -> DataFrame:
    """Best value up to each step and whether the step set it."""
    scan = ordered_scan(
        metrics.select("run", "step", "value"), ["step"],
        {"__b": (mode, F.col("value"), False)}, by=["run"],
    )
    better = F.col("value") < F.col("__b") if mode == "min" else F.col("value") > F.col("__b")
    is_best = F.col("__b").isNull() | better
    return scan.select(
        "run", "step", "value", F.when(is_best, F.col("value")).otherwise(F.col("__b")).alias("best"),
        is_best.alias("is_best"),
    )


def early_stop(
    metrics: DataFrame, patience: int, min_delta: float = 0.0, mode: str = "min"
) -> DataFrame:
    """Per evaluation: improved, best value, evaluations since, and whether to stop.

    A value improves when it is below the best by more than ``min_delta``. Such a value is
    always a new minimum, so the sequential part is a greedy chain over the new minima alone.
    """
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    base = metrics.select("run", "step", "value")
    if patience <= 0:
        return base.select(
            "run", "step", "value", F.lit(False).alias("improved"), F.lit(None).cast("double").alias("best"),
            F.lit(0).cast("bigint").alias("bad_evals"), F.lit(False).alias("should_stop"),
        )
    v = F.col("value") if mode == "min" else -F.col("value")
    scan = cut_lineage(ordered_scan(
        base.withColumn("__v", v.cast("double")), ["step"],
        {"__i": ("count", F.lit(1), False), "__min": ("min", F.col("__v"), False)}, by=["run"],
    ), "evaluations")
    minima = scan.filter(F.col("__min").isNull() | (F.col("__v") < F.col("__min")))
    if min_delta == 0:
        hits = minima.select("run", "__i")
    else:
        levels = cut_lineage(dense_index(
            minima.select("run", "__i", (-F.col("__v")).alias("__level")), ["__i"], "__p", by=["run"]
        ), "minima")
        chain = greedy_chain(levels, "__p", "__level", float(min_delta), by=["run"], strict=True)
        hits = levels.join(chain, ["run", "__p"]).select("run", "__i")
    marked = scan.join(hits.withColumn("__hit", F.lit(True)), ["run", "__i"], "left")
    last = ordered_scan(
        marked.select("run", "step", "value", "__i", "__hit", "__v"), ["step"],
        {"__last": ("max", F.when(F.col("__hit"), F.col("__i")), True),
         "__best": ("min", F.when(F.col("__hit"), F.col("__v")), True)}, by=["run"],
    )
    bad = F.col("__i") - F.col("__last")
    best = F.col("__best") if mode == "min" else -F.col("__best")
    return last.select(
        "run", "step", "value", (bad == 0).alias("improved"), best.alias("best"),
        bad.alias("bad_evals"), (bad >= patience).alias("should_stop"),
    )
