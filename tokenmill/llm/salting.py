"""Joins on keys whose number of rows is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.session import cut_lineage

#: A key with this part of all rows, but at least so many, is joined in SALTS places.
HOT_SHARE, HOT_ROWS, SALTS = 1 / 256, 256, 64


def join_counted(many: DataFrame, one: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of many rows of a key with its one row, whose ``count`` says how many there are.

    Crowded keys (at most 1 / HOT_SHARE of them) are spread by the row's place in a written
    table, which repeated tasks keep; all others are joined plainly.
    """
    often = one.where(F.col(count) >= max(HOT_ROWS, total * HOT_SHARE)).select(F.xxhash64(key).alias("h")).collect()
    if not often:
        return many.join(one, key)
    hot = F.xxhash64(key).isin([r["h"] for r in often])
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    salted = cut_lineage(many, "salted").withColumn("__salt", place).withColumn("__salt", F.when(hot, F.col("__salt")).otherwise(0))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(one.withColumn("__salt", F.explode(copies)), [key, "__salt"]).drop("__salt")
