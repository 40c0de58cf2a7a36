import pytest
from pyspark.sql import functions as F

from tokenmill.plans.joins import broadcast_up_to, hot_keys, skew_join


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [True, False])
def test_skew_join_equals_a_plain_join(spark, how, hot):
    key = F.when(F.col("id") % 3 == 0, F.lit(7)) if hot else F.when(F.lit(False), F.lit(7))
    many = spark.range(6000).select(F.coalesce(key, F.col("id") % 2000).alias("k"), F.lit("t").alias("t"), "id")
    one = spark.range(1500).select(F.col("id").alias("k"), F.lit("t").alias("t"), (F.col("id") * 2).alias("v"))
    assert (hot_keys(many, ["k", "t"]) == [(7, "t")]) is hot
    a = skew_join(many, one, ["k", "t"], how)
    b = many.join(one, ["k", "t"], how)
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_hot_rows_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = spark.range(8000).select(F.lit(1).alias("k"), "id")
        out = skew_join(many, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"])
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_is_checked(spark):
    plan = lambda rows: spark.range(10).join(broadcast_up_to(spark.range(5), rows), "id")._jdf.queryExecution().toString()
    assert "strategy=broadcast" in plan(5) and "strategy=broadcast" not in plan(4)


def test_scans_of_few_row_groups_are_spread(spark, tmp_path):
    from tokenmill.plans.session import spread

    path = str(tmp_path / "one")
    spark.range(1000).coalesce(1).write.parquet(path)
    assert spread(spark.read.parquet(path), "id").select(F.spark_partition_id()).distinct().count() > 1
    many = str(tmp_path / "many")
    spark.range(1000).repartition(16).write.parquet(many)
    df = spark.read.parquet(many)
    assert spread(df, "id") is df


def test_functions_travel_by_value():
    from pyspark import cloudpickle

    assert "tokenmill" in cloudpickle.list_registry_pickle_by_value()


def test_scans_of_uneven_tasks_are_spread(spark, tmp_path):
    """One task more than cores takes two rounds."""
    from tokenmill.plans.session import spread

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 900, 1, cores + 1)
    counts = spread(rows, "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) == 2 * cores and sum(r["count"] for r in counts) == 900
    even = spark.range(0, 900, 1, cores)
    assert spread(even, "id") is even


def test_rows_that_are_alike_are_found_and_spread(spark):
    """A third of all rows on one item, each with a reward of 0 or 1 only."""
    many = spark.range(60000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("reward"))
    assert hot_keys(many, ["k"]) == [(-1,)]
    one = spark.createDataFrame([(-1, "x")], "k bigint, v string")
    out = skew_join(many, one, ["k"])
    assert out.count() == 20000
    assert "pmod(monotonically_increasing_id(), cast(64 as bigint))" in out._jdf.queryExecution().analyzed().toString()


def test_crowded_null_keys_are_kept_and_spread(spark):
    many = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), "id")
    one = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = skew_join(many, one, ["k"], "left"), many.join(one, ["k"], "left")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_scratch_tables_are_deleted(spark, monkeypatch):
    import os

    from tokenmill.plans import session

    monkeypatch.setattr(session, "_SCRATCH", [])
    kept = session.cut_lineage(spark.range(3), "gone")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 3 and os.path.exists(path)
    session.release()
    assert not os.path.exists(path)
