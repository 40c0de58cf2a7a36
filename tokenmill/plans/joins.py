"""Joins that hold up when one key has a large part of all rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.plans.session import cut_lineage

SAMPLE = 5000
HOT_SHARE = 0.02
SALTS = 64


def hot_keys(
    df: DataFrame, on: Sequence[str], share: float = HOT_SHARE, sample: int = SAMPLE, nulls: bool = False
) -> list[tuple]:
    """Keys with at least ``share`` of the rows, by a bounded sample of rows; with null parts only if asked for.

    Rows are sampled by the hash of their position, so rows that are alike count each for
    itself, and only ``sample`` keys reach the driver.
    """
    place = F.xxhash64(F.monotonically_increasing_id())
    rows = df.select(*on).withColumn("__x", place).orderBy("__x").limit(sample).select(*on).collect()
    floor = max(2, share * len(rows))
    return [k for k, n in Counter(tuple(r) for r in rows).items() if n >= floor and (nulls or None not in k)]


def skew_join(
    many: DataFrame, one: DataFrame, on: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join a table that may have hot keys with one that has few rows per key.

    Rows of a hot key are spread over ``salts`` sub-keys, and only the hot keys of the other
    side are repeated. ``how`` is inner or left; crowded rows with a null key, which match
    nothing, are spread as well. Without crowded keys this is a plain join.
    """
    on = list(on)
    crowded = hot_keys(many, on, nulls=how == "left")
    hot = [k for k in crowded if None not in k]
    lost = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    if not crowded:
        return many.join(one, on, how)
    types = {f.name: f.dataType for f in many.select(*on).schema}
    kind = T.ArrayType(T.StructType([T.StructField(c, types[c]) for c in on]))
    marks = F.array(*[F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(on, k)]) for k in hot]).cast(kind)
    key = lambda df: F.struct(*[F.col(c).cast(types[c]).alias(c) for c in on])
    # the salt is the row's place, which a written table keeps when a task is repeated
    many = cut_lineage(many, "salted")
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = F.array_contains(marks, key(many)) if hot else F.lit(False)
    left = many.withColumn("__salt", F.when(lost | salted, spread).otherwise(0))
    if not hot:
        return left.join(one.withColumn("__salt", F.lit(0)), [*on, "__salt"], how).drop("__salt")
    copies = F.when(F.array_contains(marks, key(one)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.withColumn("__salt", F.explode(copies))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """The table marked for broadcast when it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
