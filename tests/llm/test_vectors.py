"""Whitening and hard negatives against plain numpy over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF
from tokenmill.llm import segment_mining, whitening

#: Rows that take part and rows that do not; the names of the other columns are used inside the operators.
ODD = [
    (1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [math.nan, 1.0], 0), (5, [1.0], 0), (None, [3.0, 2.0], 0),
    (6, [math.inf, 0.0], 0), (7, [], 0), (8, [1e30, 1.0], 0), (9, [0.0, 0.0], None), (100, [1.0, 1.0], 1), (200, [1.5, 1.0], 1), (300, [1.0, 1.0], 0),
]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int")
    return rows.withColumns({"x": F.lit("a"), "rows": F.lit(1), "row": F.lit(2), "weight": F.lit(3), "n": F.lit(4)})


def plain_whitening(ids, x, counts=True):
    """Whitened rows up to sign, explained shares and deviations of whole-number vectors."""
    fit = x if counts else np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    return n, (x - total / n) @ axes / np.sqrt(values), values / values.sum(), dict(zip(ids, deviation))


def test_whitening_query_against_numpy(spark):
    source = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = [r.vec_id for r in source]
    x = np.floor(64 * np.array([r.embedding for r in source], float)).astype(np.int64) + 1_000_000
    n, white, share, deviation = plain_whitening(ids, x)
    got = {(r.vec_id, r.component): r for r in entry.queries()["op11_weighted_whitening"](spark, SF).collect()}
    assert len(got) == 32 * len(ids) and {r.n for r in got.values()} == {n}
    found = np.array([[got[i, k + 1].whitened for k in range(32)] for i in ids])
    sign = np.sign((found * white[:, :32]).sum(axis=0))
    assert np.abs(found - sign * white[:, :32]).max() < 1e-8
    assert all(abs(r.explained - share[k - 1]) < 1e-9 for (_, k), r in got.items())
    assert all(r.deviation == deviation[i] for (i, _), r in got.items())
    errors = {r.identity_error for r in got.values()}
    assert len(errors) == 1 and errors.pop() == pytest.approx(np.abs(found.T @ found / n - np.eye(32)).max(), abs=1e-12)


def test_whitening_of_repeated_vectors(spark):
    """A vector with most rows is spread over the join; counts weigh it, or not."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 6)).round(2)
    rows = [(i, v[0].tolist()) for i in range(900)] + [(1000 + i, v[i % 40].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    for weights in ("counts", "one"):
        n, white, share, deviation = plain_whitening([r[0] for r in rows], x, weights == "counts")
        got = {r.vec_id: r for r in whitening.whiten(df, weights=weights).collect()}
        assert len(got) == len(rows) and {r.n for r in got.values()} == {n}
        found = np.array([got[i].whitened for i, _ in rows])
        assert np.abs(found - np.sign((found * white).sum(axis=0)) * white).max() < 1e-9
        assert {i: r.deviation for i, r in got.items()} == deviation
        assert max(r.identity_error for r in got.values()) < 1e-10


def test_whitening_of_odd_rows(spark, odd_vectors):
    out = whitening.whiten(odd_vectors).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == [(False, 1), (False, 1), (False, 9), (False, 100), (False, 200), (False, 300), (True, 0)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(8)], "vec_id long, embedding array<double>")
    flat = whitening.whiten(line).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in flat) and flat[0].explained[0] == pytest.approx(1)
    one = whitening.whiten(line.limit(1)).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, [None] * 3, 0.0)]
    assert whitening.whiten(line.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e11]), (2, [-1e11]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in whitening.whiten(huge).collect()} == {1: None, 2: None, 3: 0}
    with pytest.raises(ValueError):
        whitening.whiten(line, weights="some")


def plain_mining(rows, is_anchor, positives, negatives, band):
    """rows: (id, whole-number vector, label)."""
    x = np.array([r[1] for r in rows], np.int64)
    out = []
    for a, (anchor, _, label) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        score = [int(s) for s in x @ x[a]]
        others = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-score[k], rows[k][0]))
        for p in [k for k in others if rows[k][2] == label][:positives]:
            fits = [k for k in others if rows[k][2] != label and band[0] * score[p] <= band[2] * score[k] <= band[1] * score[p]]
            out += [(anchor, rows[p][0], i + 1, rows[k][0], score[p], score[k]) for i, k in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("parameters", [{}, {"lot_bytes": 3000, "seed_rows": 5}, {"levels": (2, 3)}])
def test_mining_against_a_loop(spark, parameters):
    """Clusters on one ray, ties and several lots of anchors give the same rows as all scores sorted."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(150, 10)), rng.normal(size=(1, 10)) * rng.uniform(0.9, 1.1, (120, 1)), np.ones((30, 10)), -np.ones((5, 10))]).round(3)
    rows = [(int(i), v[i].tolist(), int(i) % 4) for i in rng.permutation(len(v))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    whole = [(i, np.floor(256 * np.array(e)).astype(np.int64), k) for i, e, k in rows]
    got = segment_mining.mine(df, F.col("vec_id") % 9 == 0, 4, 3, (70, 95, 100), **parameters)
    assert sorted(tuple(r) for r in got.collect()) == plain_mining(whole, lambda i: i % 9 == 0, 4, 3, (70, 95, 100))


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-300, 300, (40, 37)).astype(float), rng.integers(-300, 300, (50, 37)).astype(float)
    exact = a @ b.T
    width = []
    for n in (1, 4, 16, 37):
        (s,), (d,) = segment_mining.summaries(a, (n,))
        (t,), (e,) = segment_mining.summaries(b, (n,))
        assert (np.abs(exact - s @ t.T) <= d @ e.T + 1e-6).all()
        width.append((d @ e.T).mean())
    assert width == sorted(width, reverse=True) and width[-1] == 0


def test_mining_of_odd_rows(spark, odd_vectors):
    """A repeated row is a positive of its copy; rows that take no part are nowhere."""
    got = sorted(tuple(r) for r in segment_mining.mine(odd_vectors, F.col("vec_id").isin(1, 100)).collect())
    # an anchor 1 scores 5 with its copy and 3 with 300; of the other label 100 has 3 and 200 has 3.5
    k = 65536
    assert got == [(1, 300, 1, 100, 3 * k, 3 * k)] * 2 + [(100, 200, 1, 300, int(2.5 * k), 2 * k)]
    assert segment_mining.mine(odd_vectors.limit(0), F.col("vec_id") == 1).count() == 0
    assert segment_mining.mine(odd_vectors, F.col("vec_id") == 77).count() == 0


def test_mining_of_large_components(spark):
    """Scores beyond the whole numbers of doubles are still exact."""
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-(2**19), 2**19) / 3 for _ in range(4)], i % 2) for i in range(60)]
    whole = [(i, np.floor(256 * np.array(e)).astype(np.int64), k) for i, e, k in rows]
    got = segment_mining.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 5 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_mining(whole, lambda i: i % 5 == 0, 5, 5, (80, 100, 100))
