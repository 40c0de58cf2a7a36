"""Shuffles, slices, mixtures, repetition and schedules over task tables.

A task is a table with a dense ``idx`` from 0. Indices come from the two-phase scan, so none
of these jobs orders the whole table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.text import hash_pick, order_key, unit_interval
from tokenmill.plans.joins import skew_join
from tokenmill.plans.scan import dense_index, hash_blocks, ordered_scan
from tokenmill.plans.session import cut_lineage


def shuffle(df: DataFrame, key: Sequence[str], seed=42, name: str = "idx") -> DataFrame:
    """Reproducible random order as a dense index; the same on any partitioning."""
    keyed = df.withColumn("__h", order_key(seed, *key))
    return dense_index(
        keyed, ["__h", *key], name, block=hash_blocks("__h")
    ).drop("__h")


def slice_task(
    df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, idx: str = "idx"
) -> DataFrame:
    """View ``[start:stop:step]`` with a new dense index."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError(f"bad slice {start}:{stop}:{step}")
    inside = F.col(idx) >= start
    if stop is not None:
        inside &= F.col(idx) < stop
    kept = df.filter(inside & (F.pmod(F.col(idx) - start, F.lit(step)) == 0))
    return kept.withColumn(idx, F.expr(f"({idx} - {start}) div {step}"))


def cap(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """First ``n`` rows by index."""
    return df.filter(F.col(idx) < n)


def holdout(df: DataFrame, n: int, idx: str = "idx") -> tuple[DataFrame, DataFrame]:
    """(first ``n`` rows, the others), both re-indexed."""
    return slice_task(df, 0, n, idx=idx), slice_task(df, n, idx=idx)


def stride(df: DataFrame, world: int, idx: str = "idx") -> DataFrame:
    """Rank of each row when ranks take every ``world``-th row."""
    return df.withColumn("rank", F.pmod(F.col(idx), F.lit(world)).cast("int")).withColumn(
        "rank_idx", F.expr(f"{idx} div {world}")
    )


@dataclass(frozen=True)
class Task:
    """A named task table with its weight in a mixture."""

    name: str
    rows: DataFrame
    eval_type: str = "generative"
    repeats: int = 1


def eval_type(tasks: Sequence[Task]) -> str:
    kinds = {t.eval_type for t in tasks}
    if len(kinds) != 1:
        raise ValueError(f"tasks have mixed eval_type: {sorted(kinds)}")
    return kinds.pop()


def repeat(df: DataFrame, n: int, idx: str = "idx", size: int | None = None) -> DataFrame:
    """Each row ``n`` times, copies numbered from 0 in ``copy_no``.

    With ``size`` (the row count) the index is continued over the copies.
    """
    if n < 1:
        raise ValueError("repeats must be at least 1")
    out = df.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if size is not None:
        out = out.withColumn(idx, F.col(idx) + F.col("copy_no") * F.lit(size))
    return out


def phase_weight(base: int, multiplier: int = 1, phase2: bool = False) -> int:
    return max(1, int(base) * (int(multiplier) if phase2 else 1))


def _union(tasks: Sequence[Task]) -> DataFrame:
    out = None
    for no, task in enumerate(tasks):
        part = repeat(task.rows, task.repeats).select(
            F.lit(no).alias("task_no"), F.lit(task.name).alias("task"), "copy_no", F.col("idx").alias("local_idx"),
            *[c for c in task.rows.columns if c != "idx"],
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def mixture(tasks: Sequence[Task], seed=42) -> DataFrame:
    """All rows of all tasks in one deterministic random order.

    Listing a task twice, or giving it repeats, over-samples it.
    """
    return shuffle(_union(tasks), ["task_no", "copy_no", "local_idx"], seed)


def sequence_tasks(tasks: Sequence[Task]) -> DataFrame:
    """All rows, one task after the other."""
    return dense_index(_union(tasks), ["task_no", "copy_no", "local_idx"])


def mixture_stats(mix: DataFrame) -> DataFrame:
    """Rows, share and total per task."""
    per = mix.groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"))
    # One row per task is left here, so an unpartitioned window is small.
    return per.withColumn("epoch_size", F.sum("n_rows").over(Window.partitionBy())).withColumn(
        "share", F.col("n_rows") / F.col("epoch_size")
    )


def subject_extras(df: DataFrame, weights: dict[str, int], subject: str = "subject") -> DataFrame:
    """``weight - 1`` further copies of the rows of up-weighted subjects."""
    up = {k: int(v) for k, v in weights.items() if int(v) > 1}
    if not up:
        return df.withColumn("copy_no", F.lit(1)).limit(0)
    copies = F.create_map(*[F.lit(x) for kv in up.items() for x in (kv[0], kv[1] - 1)])
    return df.filter(F.col(subject).isin(*up)).withColumn(
        "copy_no", F.explode(F.sequence(F.lit(1), F.element_at(copies, F.col(subject))))
    )


def filter_subjects(
    df: DataFrame, subjects: Sequence[str], fallback: DataFrame | None = None, subject: str = "subject"
) -> DataFrame:
    """Rows of the given subjects; those of the fallback table when there are none."""
    kept = df.filter(F.col(subject).isin(*subjects))
    if fallback is not None and kept.isEmpty():
        kept = fallback.filter(F.col(subject).isin(*subjects))
    return kept


def replay_mix(
    main: DataFrame, replay: DataFrame, n_slots: int, p: float, seed=42,
    main_size: int | None = None, replay_size: int | None = None,
) -> DataFrame:
    """Fill ``n_slots`` places, each from ``replay`` with probability ``p``, else from ``main``.

    Both sides are taken in index order and start over when they run out.
    """
    spark = main.sparkSession
    sizes = {
        "main": main.count() if main_size is None else main_size,
        "replay": replay.count() if replay_size is None else replay_size,
    }
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn(
        "side", F.when(unit_interval(seed, "slot") < p, "replay").otherwise("main")
    )
    if sizes["replay"] == 0:
        slots = slots.withColumn("side", F.lit("main"))
    taken = ordered_scan(slots, ["slot"], {
        "n_main": ("sum", F.when(F.col("side") == "main", 1).otherwise(0), False),
        "n_replay": ("sum", F.when(F.col("side") == "replay", 1).otherwise(0), False),
    })
    at = F.when(F.col("side") == "main", F.pmod("n_main", F.lit(max(1, sizes["main"])))).otherwise(
        F.pmod("n_replay", F.lit(max(1, sizes["replay"])))
    )
    both = main.withColumn("side", F.lit("main")).unionByName(
        replay.withColumn("side", F.lit("replay")), allowMissingColumns=True
    )
    # A short side is repeated often, which makes its rows hot.
    return skew_join(taken.select("slot", "side", at.alias("idx")), both, ["side", "idx"])


def phase_schedule(
    n_slots: int, phase1: DataFrame, phase2: DataFrame, epoch_size: int, start_epoch: int,
    phase1_size: int | None = None, phase2_size: int | None = None,
) -> DataFrame:
    """Slots in order; from epoch ``start_epoch`` on they are filled from the second mixture.

    Epochs count from 1 and have ``epoch_size`` slots; the second mixture starts at its own
    first row.
    """
    spark = phase1.sparkSession
    size1 = phase1.count() if phase1_size is None else phase1_size
    size2 = phase2.count() if phase2_size is None else phase2_size
    switch = epoch_size * (start_epoch - 1) if start_epoch > 0 else n_slots
    slot = F.col("slot")
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").select(
        "slot",
        (F.expr(f"slot div {epoch_size}") + 1).alias("epoch"),
        F.when(slot >= switch, 2).otherwise(1).alias("phase"),
        F.when(slot >= switch, F.pmod(slot - switch, F.lit(size2)))
        .otherwise(F.pmod(slot, F.lit(size1))).alias("idx"),
    )
    both = phase1.withColumn("phase", F.lit(1)).unionByName(
        phase2.withColumn("phase", F.lit(2)), allowMissingColumns=True
    )
    return skew_join(slots, both, ["phase", "idx"])


def epochs(df: DataFrame, n: int) -> DataFrame:
    """The table ``n`` times, numbered from epoch 1."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(n))))


def apply_valid_policy(
    df: DataFrame, is_valid: str, mode: str = "drop", idx: str = "idx", reach: int = 99, probe: int = 50
) -> DataFrame:
    """Deal with rows that could not be converted.

    ``drop`` removes them. ``fill_next`` replaces each by the next valid row, at most ``reach``
    rows ahead, the end of the table continuing at its start; ``source_idx`` names the row
    taken and is null where none was in reach. ``check`` raises when none of the first
    ``probe`` rows is valid.
    """
    if mode == "drop":
        return df.filter(is_valid)
    if mode == "check":
        if df.filter((F.col(idx) < probe) & F.col(is_valid)).isEmpty():
            raise ValueError("no valid row at the start of the table")
        return df
    size, first = df.agg(
        F.count(F.lit(1)), F.min(F.when(F.col(is_valid), F.col(idx)))
    ).first()
    slim = df.select(idx, is_valid)
    ahead = ordered_scan(
        slim, [-F.col(idx)], {"__next": ("min", F.when(F.col(is_valid), F.col(idx)), True)}
    )
    wrapped = F.lit(first).cast("bigint") + size if first is not None else F.lit(None).cast("bigint")
    found = F.coalesce("__next", wrapped)
    source = F.when(found - F.col(idx) <= reach, F.pmod(found, F.lit(size)))
    targets = ahead.select(F.col(idx).alias("__at"), source.alias("source_idx"))
    content = df.select(F.col(idx).alias("source_idx"), *[c for c in df.columns if c not in (idx, is_valid)])
    # rows without a source would share one null key, so they stay out of the join
    targets = cut_lineage(targets, "sources")
    filled = targets.filter("source_idx is not null").join(content, "source_idx", "left")
    alone = targets.filter("source_idx is null").select("*", *[
        F.lit(None).cast(f.dataType).alias(f.name) for f in content.schema if f.name != "source_idx"
    ])
    return filled.unionByName(alone.select(filled.columns)).withColumnRenamed("__at", idx)


def sample_fewshot(
    items: DataFrame, k: int, key: Sequence[str], seed=1234, size: int | None = None
) -> DataFrame:
    """``k`` distinct other items for every item (fewer when there are not enough).

    Every item draws on its own: of the n - 1 others, ``k`` different numbers by Floyd's rule (draw below
    n - k, n - k + 1, ...; a number drawn before is replaced by the highest of its step), from hashes of the
    seed, its key and the step. So no two items' draws depend on each other, nothing is sorted by a random
    order, and one equi-join on the position fetches the items drawn. ``key`` must be unique.
    """
    n = items.count() if size is None else size
    k = min(k, n - 1)
    placed = dense_index(items, list(key), "__pos")
    least = n - 1 - max(k, 1)

    def draw(taken, step):
        top = F.lit(least) + step.cast("bigint")
        number = hash_pick(seed, top + 1, *key, step)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, number), top).otherwise(number)))

    numbers = F.aggregate(F.sequence(F.lit(0), F.lit(max(k, 1) - 1)), F.array().cast("array<bigint>"), draw)
    shots = placed.select(*[F.col(c).alias(f"item_{c}") for c in key], "__pos", F.posexplode(numbers).alias("shot", "__n")).select(
        *[f"item_{c}" for c in key], (F.col("shot") + 1).alias("shot"),
        (F.col("__n") + F.when(F.col("__n") >= F.col("__pos"), 1).otherwise(0)).alias("__pos"),
    )
    if k < 1:
        shots = shots.limit(0)
    return shots.join(placed, "__pos").drop("__pos")


def pick_word(seed, size: int, *cols):
    """Hash-drawn row number in a table of ``size`` rows."""
    return hash_pick(seed, size, *cols)
