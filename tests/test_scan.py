import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenmill.plans import scan
from tokenmill.plans.scan import BLOCK, dense_index, greedy_chain, ordered_scan, prefix_sum, with_blocks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds more than a third of the rows, the others are small."""
    rng = np.random.default_rng(3)
    n = 3000
    group = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 200, n).astype(str))
    pdf = pd.DataFrame({"g": group, "k": rng.permutation(n), "v": rng.integers(-50, 50, n)})
    return pdf, spark.createDataFrame(pdf)


def test_running_values_match_pandas_for_a_hot_group(skewed):
    pdf, df = skewed
    out = ordered_scan(df, ["k"], {
        "s": ("sum", F.col("v"), True), "before": ("sum", F.col("v"), False),
        "lo": ("min", F.col("v"), True), "hi": ("max", F.col("v"), False), "n": ("count", F.lit(1), False),
    }, by=["g"], blocks=16).toPandas().sort_values(["g", "k"])
    want = pdf.sort_values(["g", "k"])
    by = want.groupby("g").v
    assert (out.s.to_numpy() == by.cumsum().to_numpy()).all()
    assert (out.before.to_numpy() == (by.cumsum() - want.v).to_numpy()).all()
    assert (out.lo.to_numpy() == by.cummin().to_numpy()).all()
    hi = by.cummax().groupby(want.g).shift()
    assert out.hi.isna().to_numpy().tolist() == hi.isna().to_numpy().tolist()
    assert (out.hi.dropna().to_numpy() == hi.dropna().to_numpy()).all()
    assert (out.n.to_numpy() == by.cumcount().to_numpy()).all()


def test_blocks_split_a_hot_group(skewed):
    _, df = skewed
    sizes = [r["count"] for r in with_blocks(df, [F.col("g"), F.col("k")], 16).groupBy(BLOCK).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3000 / 16 * 3


@pytest.mark.parametrize("parts", [1, 7])
def test_result_does_not_depend_on_partitioning(skewed, parts):
    _, df = skewed
    a = dense_index(df, ["k"], by=["g"]).toPandas().sort_values("k").idx.tolist()
    b = dense_index(df.repartition(parts), ["k"], by=["g"]).toPandas().sort_values("k").idx.tolist()
    assert a == b


def test_composite_and_descending_order(spark):
    df = spark.createDataFrame([(i % 3, i, 1) for i in range(100)], "a int, b int, n int")
    out = prefix_sum(df, "n", [-F.col("a"), F.col("b")]).toPandas().sort_values(["a", "b"], ascending=[False, True])
    assert out.start.tolist() == list(range(100))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("chunk", [3, 16, 8192])
def test_greedy_chain_equals_the_sequential_walk(spark, strict, chunk):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for g in ("a", "b", "c"):
        levels = np.cumsum(rng.choice([0, 0, 1, 5, 40], 200)).astype(float)
        last = None
        for i, x in enumerate(levels):
            rows.append((g, i, float(x)))
            if last is None or (x > last + 10 if strict else x >= last + 10):
                last = x
                want.add((g, i))
    df = spark.createDataFrame(rows, "g string, pos bigint, level double")
    got = {tuple(r) for r in greedy_chain(df, "pos", "level", 10.0, by=["g"], strict=strict, chunk=chunk).collect()}
    assert got == want


def test_chain_summaries_are_bounded_on_equal_steps(spark):
    """A million equal steps: a chunk's summary holds the entries of one step, not those of all its rows."""
    df = spark.range(1_000_000).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("level"))
    got = greedy_chain(df, "pos", "level", 80.0)
    assert got.count() == 12_500 and got.where("pos % 80 <> 0").count() == 0


def test_null_order_keys_are_named(spark):
    df = spark.createDataFrame([(None,), (1,), (2,)], "k bigint")
    with pytest.raises(ValueError, match="must not be null"):
        dense_index(df, ["k"]).collect()


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("fan", [2, 5])
def test_chain_of_many_levels_of_maps(spark, strict, fan):
    """Maps of three rows each, composed two or five at a time: flat stretches, jumps, and a base below the level."""
    rng = np.random.default_rng(7)
    rows, want = [], set()
    for g in ("a", "b"):
        takes = rng.choice([1, 1, 2, 30, 9], 400 if g == "a" else 40)
        ends = np.cumsum(takes)
        start = None
        for i, (end, take) in enumerate(zip(ends.tolist(), takes.tolist())):
            rows.append((g, i, float(end), float(end - take)))
            if start is None or (end > start + 25 if strict else end >= start + 25):
                start = end - take
                want.add((g, i))
    df = spark.createDataFrame(rows, "g string, pos bigint, level double, base double")
    got = greedy_chain(df, "pos", "level", 25.0, by=["g"], strict=strict, chunk=3, base="base", fan=fan)
    assert {tuple(r) for r in got.collect()} == want


def test_chain_of_ten_thousand_chunks(spark):
    """No task folds more than ``fan`` of 12500 maps."""
    df = spark.range(200_000).select(F.col("id").alias("pos"), (F.col("id") * 3).cast("double").alias("level"))
    got = greedy_chain(df, "pos", "level", 100.0, chunk=16, fan=128)
    assert [r.pos for r in got.orderBy("pos").limit(3).collect()] == [0, 34, 68] and got.count() == -(-200_000 // 34)
    assert greedy_chain(df.limit(0), "pos", "level", 1.0).count() == 0


def test_many_small_groups_are_scanned_without_blocks(spark, monkeypatch):
    """Only a group with a large part of the rows is cut into blocks; both ways give the same."""
    df = spark.range(6000).select((F.col("id") % 700).alias("g"), F.col("id").alias("o"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    outputs = {"n": ("count", F.lit(1), False), "s": ("sum", F.col("v"), True), "lo": ("min", F.col("v"), False), "hi": ("max", F.col("v"), True)}
    calls, plain = [], scan.with_blocks
    monkeypatch.setattr(scan, "with_blocks", lambda *a: calls.append(1) or plain(*a))
    whole = lambda blocks: sorted(tuple(r) for r in scan.ordered_scan(df, ["o"], outputs, ["g"], blocks=blocks).collect())
    small = whole(None)
    assert not calls and small == whole(8) and len(calls) == 1
    hot = df.withColumn("g", F.when(F.col("g") < 100, 0).otherwise(F.col("g")))
    scan.dense_index(hot, ["o"], by=["g"]).count()
    assert len(calls) == 2
