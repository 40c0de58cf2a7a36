"""Metrics over outcome, loss and logit tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.text import order_key
from tokenmill.operators.tokens import MAX_VOCAB
from tokenmill.plans.joins import broadcast_up_to, skew_join
from tokenmill.plans.scan import dense_index
from tokenmill.plans.session import cut_lineage


# Chance levels of the chat tasks, which are also the ones a composite needs.
CHAT_BASELINES = {
    "ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "HumanEval": 0.0, "SpellingBee": 0.0,
}


def accuracy(outcomes: DataFrame, by: Sequence[str] = ("task",), max_problems: int | None = None) -> DataFrame:
    """Share of items with any correct sample.

    ``max_problems`` keeps the items with the smallest ``item_id`` of each task.
    """
    by = list(by)
    items = outcomes.groupBy(*by, "item_id").agg(F.bool_or("is_correct").alias("__ok"))
    if max_problems is not None:
        items = dense_index(cut_lineage(items, "items"), ["item_id"], "__p", by=by).filter(F.col("__p") < max_problems)
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("__ok").alias("n_correct"),
        F.avg(F.col("__ok").cast("double")).alias("accuracy"),
    )


def pass_at_k(outcomes: DataFrame, k_max: int, by: Sequence[str] = ()) -> DataFrame:
    """Share of items solved within their first k samples, for k = 1 .. ``k_max``.

    ``sample_no`` counts from 1. Only the first success of an item matters, and only a
    histogram of it leaves the items.
    """
    by = list(by)
    items = outcomes.groupBy(*by, "item_id").agg(
        F.min(F.when(F.col("is_correct"), F.col("sample_no"))).alias("__first")
    )
    hist = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.count_if(F.col("__first") <= k).alias(f"__{k}") for k in range(1, k_max + 1)],
    )
    ks = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__{k}").alias("n")) for k in range(1, k_max + 1)])
    return hist.select(*by, "n_items", F.explode(ks).alias("h")).select(
        *by, F.col("h.k").alias("k"), "n_items",
        (F.col("h.n") / F.col("n_items")).alias("pass_at_k"),
    )


def predict_letter(logits: DataFrame) -> DataFrame:
    """Letter with the largest logit, the first one on ties.

    ``logits(item_id, letters, logits, gold)``; an optional ``n_tokens`` array tells how many
    tokens each letter takes, and letters of several tokens are rejected.
    """
    scores = F.arrays_zip("letters", "logits")
    best = F.array_max(F.transform(
        F.col("logits"), lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))
    ))
    if "n_tokens" in logits.columns:
        single = F.forall("n_tokens", lambda n: n == 1)
        scores = F.when(single, scores).otherwise(
            F.raise_error("each letter must be one token").cast(logits.select(scores).schema[0].dataType)
        )
    picked = F.get(scores, (-best["i"]).cast("int"))["letters"]
    return logits.select(
        *[c for c in logits.columns if c not in ("letters", "logits", "n_tokens")],
        picked.alias("predicted"), (picked == F.col("gold")).alias("is_correct"),
    )


def bits_per_byte(losses: DataFrame, token_bytes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Bits per byte: nats over tokens with bytes, over ln 2 times their bytes.

    Negative targets are ignored; no bytes at all give infinity. The vocabulary has one short
    row per token and is broadcast once its size is checked, as tokens are very unevenly
    frequent.
    """
    vocab = broadcast_up_to(token_bytes.filter("n_bytes > 0").select("token_id", "n_bytes"), MAX_VOCAB)
    # groups without a counted token stay, so tokens are looked up by an outer join and counted where they have bytes
    counted = (F.col("token_id") >= 0) & F.col("n_bytes").isNotNull()
    sums = losses.join(vocab, "token_id", "left").groupBy(*by).agg(
        F.sum(F.when(counted, F.col("loss"))).alias("nats"), F.sum(F.when(counted, F.col("n_bytes"))).alias("n_bytes")
    )
    n = F.coalesce("n_bytes", F.lit(0))
    return sums.select(
        *by, n.cast("bigint").alias("n_bytes"),
        F.when(n == 0, F.lit(float("inf"))).otherwise(
            F.col("nats") / (F.lit(math.log(2)) * n)
        ).alias("bpb"),
    )


def centered(acc: Column, baseline: Column) -> Column:
    return (acc - baseline) / (F.lit(1.0) - baseline)


def centered_score(
    accuracies: DataFrame, baselines: DataFrame, percent: bool = False,
    required: Sequence[str] = (),
) -> DataFrame:
    """Accuracy above chance per task, and its mean over all tasks as ``composite``.

    A task without a baseline counts from 0. ``percent`` reads baselines on a 0-100 scale.
    The composite is null when a required task is missing.
    """
    scale = 0.01 if percent else 1.0
    base = F.coalesce(F.col("baseline"), F.lit(0.0)) * F.lit(scale)
    per = accuracies.join(baselines, "task", "left").select(
        "task", "accuracy", centered(F.col("accuracy"), base).alias("centered")
    )
    # One row per task from here on.
    every = Window.partitionBy()
    missing = F.lit(len(set(required))) > F.size(F.array_intersect(
        F.collect_set("task").over(every), F.array(*[F.lit(r) for r in required]).cast("array<string>")
    ))
    return per.select(
        "task", "accuracy", F.col("centered").alias("centered"),
        F.when(~missing, F.avg("centered").over(every)).alias("composite"),
    )


def chat_composite(accuracies: DataFrame) -> DataFrame:
    """Centered chat scores; the composite needs all six tasks and averages over all given."""
    base = accuracies.sparkSession.createDataFrame(list(CHAT_BASELINES.items()), "task string, baseline double")
    return centered_score(accuracies, base, required=list(CHAT_BASELINES))


def vocab_stats(token_bytes: DataFrame) -> DataFrame:
    """Byte lengths over the non-special tokens."""
    return token_bytes.filter("n_bytes > 0").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.min("n_bytes").cast("bigint").alias("min_bytes"), F.max("n_bytes").cast("bigint").alias("max_bytes"),
        F.avg("n_bytes").alias("mean_bytes"),
        F.stddev_samp("n_bytes").alias("std_bytes"),
    )


def subject_stats(df: DataFrame, top: int = 0) -> DataFrame:
    """Rows, percent and place per subject, most frequent first, then by name."""
    total = df.count()
    counts = df.groupBy("subject").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "percent", F.lit(100.0) * F.col("n_rows") / F.lit(max(1, total))
    )
    if not top:
        return dense_index(counts, [-F.col("n_rows"), F.col("subject")], "place").withColumn(
            "place", F.col("place") + 1)
    best = counts.orderBy(F.desc("n_rows"), "subject").limit(top)
    # At most ``top`` rows are left for this window.
    return best.withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc("n_rows"), "subject")).cast("bigint"))


def group_totals(df: DataFrame, groups: dict[str, Sequence[str]], weights: dict[str, int] | None = None) -> DataFrame:
    """Rows per subject group, before and after up-weighting, with the overall totals."""
    weights = {g: max(1, int(w)) for g, w in (weights or {}).items()}
    counts = df.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    inside = lambda subjects: F.coalesce(F.sum(F.when(F.col("subject").isin(*subjects), F.col("n"))), F.lit(0))
    one = counts.agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.coalesce("subject", F.lit("")) == "", F.col("n"))), F.lit(0)).alias("missing_rows"),
        F.array(*[
            F.struct(F.lit(g).alias("group"), inside(s).alias("n"), F.lit(weights.get(g, 1)).alias("w"))
            for g, s in groups.items()
        ]).alias("__g"),
    )
    extra = F.aggregate("__g", F.lit(0).cast("bigint"), lambda a, x: a + x["n"] * (x["w"] - 1))
    return one.withColumn("effective_total", F.col("total_rows") + extra).select(
        F.explode("__g").alias("g"), "total_rows", "effective_total", "missing_rows"
    ).select(
        F.col("g.group").alias("group"), F.col("g.n").alias("n_rows"),
        (F.col("g.n") * F.col("g.w")).alias("effective_rows"), "total_rows", "effective_total", "missing_rows",
    )


def advantages(rewards: DataFrame, item: str = "item_id") -> DataFrame:
    """Reward minus the mean reward of the same item.

    The means are aggregated first and joined back with hot items spread out; a window over
    the item would pull a hot item into one task.
    """
    means = rewards.groupBy(item).agg(F.avg("reward").alias("__m"))
    return skew_join(rewards, means, [item]).withColumn(
        "advantage", F.col("reward") - F.col("__m")
    ).drop("__m")


def batch_rewards(rewards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean reward and mean sampled length of a batch."""
    return rewards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("reward").alias("mean_reward"),
        F.avg("n_tokens").alias("mean_length"),
    )


def select_solutions(
    outcomes: DataFrame, source: str = "auto", exclude_self: bool = True, failed_only: bool = True
) -> DataFrame:
    """Solution shown to each failed sample.

    ``outcomes(item_id, sample_no, text, is_correct, reference_text)``. The reference answer
    wins with ``source`` auto or reference; else the first correct sample of the item is taken
    (for a correct sample the first other one). Two candidates per item are enough, so the
    item's samples are never collected.
    """
    usable = F.when(F.col("is_correct"), F.struct("sample_no", "text"))
    first = outcomes.groupBy("item_id").agg(F.min(usable).alias("__a"))
    if not failed_only and exclude_self:
        second = skew_join(outcomes.filter("is_correct"), first, ["item_id"]).filter(
            (F.col("sample_no") > F.col("__a.sample_no"))
        ).groupBy("item_id").agg(F.min(F.struct("sample_no", "text")).alias("__b"))
        first = first.join(second, "item_id", "left")
    else:
        first = first.withColumn("__b", F.lit(None).cast("struct<sample_no:bigint,text:string>"))
    rows = outcomes.filter(~F.col("is_correct")) if failed_only else outcomes
    own = F.col("is_correct") & (F.col("sample_no") == F.col("__a.sample_no")) & F.lit(exclude_self)
    peer = F.when(own, F.col("__b.text")).otherwise(F.col("__a.text"))
    reference = F.col("reference_text") if "reference_text" in outcomes.columns else F.lit(None).cast("string")
    text = {
        "auto": F.coalesce(reference, peer), "reference": reference, "success": peer,
    }[source]
    return skew_join(rows, first, ["item_id"]).withColumn("solution_text", text).drop("__a", "__b")


def rollout_stats(selected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Success rate, usable re-prompt pairs and mean length.

    ``selected`` holds all samples; a pair is usable when a failed sample has a solution or
    feedback.
    """
    usable = ~F.col("is_correct") & (F.col("solution_text").isNotNull() | F.col("feedback_text").isNotNull())
    return selected.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if("is_correct").alias("n_success"),
        F.try_divide(F.count_if("is_correct").cast("double"), F.count(F.lit(1))).alias("success_rate"),
        F.count_if(usable).alias("n_pairs"),
        F.avg("n_tokens").alias("mean_length"),
    )


def score_choices(losses: DataFrame, spans: DataFrame) -> DataFrame:
    """Choice with the smallest mean loss over its continuation, the first one on ties.

    ``losses(item_id, choice, pos, loss)`` where position p predicts token p + 1;
    ``spans(item_id, choice, start, end, gold)``.
    """
    inside = skew_join(losses, spans, ["item_id", "choice"]).filter(
        (F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1)
    )
    means = inside.groupBy("item_id", "choice").agg(F.avg("loss").alias("m"), F.max("gold").alias("gold"))
    return means.groupBy("item_id").agg(
        F.min(F.struct("m", "choice"))["choice"].alias("predicted"), F.max("gold").alias("gold")
    ).withColumn("is_correct", F.col("predicted") == F.col("gold"))


def score_continuation(predictions: DataFrame, spans: DataFrame) -> DataFrame:
    """True when every token of the continuation was predicted.

    ``predictions(item_id, pos, predicted, actual)``: the prediction made at ``pos`` and the
    token that follows; ``spans(item_id, start, end)``.
    """
    return skew_join(predictions, spans, ["item_id"]).filter(
        (F.col("pos") >= F.col("start") - 1) & (F.col("pos") < F.col("end") - 1)
    ).groupBy("item_id").agg(F.bool_and(F.col("predicted") == F.col("actual")).alias("is_correct"))


def first_by_hash(df: DataFrame, n: int, key: Sequence[str], seed=1337) -> DataFrame:
    """The first ``n`` items of the shuffled order, for a capped evaluation."""
    return df.orderBy(order_key(seed, *key), *key).limit(n)
