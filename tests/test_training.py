import numpy as np
import pytest

from tokenmill.operators import fits, training as tr


def _walk(values, patience, delta):
    best, bad, out = None, 0, []
    for v in values:
        if best is None or v < best - delta:
            best, bad, hit = v, 0, True
        else:
            bad, hit = bad + 1, False
        out.append((hit, best, bad, not hit and bad >= patience))
    return out


def _table(spark, runs):
    rows = [(r, i, float(v)) for r, vs in runs.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "run string, step bigint, value double")


@pytest.mark.parametrize("delta", [0.0, 0.1, 2.5])
def test_early_stop_equals_the_sequential_rule(spark, delta):
    rng = np.random.default_rng(1)
    runs = {
        "noise": rng.random(300), "falling": 50 - np.arange(300) / 7 + rng.random(300) / 10,
        "flat": [10.0, 10.0, 10.0], "one": [3.0],
    }
    out = tr.early_stop(_table(spark, runs), 2, delta).toPandas().sort_values(["run", "step"])
    for run, values in runs.items():
        part = out[out.run == run]
        got = list(zip(part.improved, part.best, part.bad_evals, part.should_stop))
        assert got == _walk(values, 2, delta), run


def test_early_stop_examples(spark):
    out = tr.early_stop(_table(spark, {"a": [10, 10, 10]}), 2).orderBy("step").collect()
    assert [r.should_stop for r in out] == [False, False, True]
    out = tr.early_stop(_table(spark, {"a": [1.0, 0.95, 0.89]}), 5, 0.1).orderBy("step").collect()
    assert [r.bad_evals for r in out] == [0, 1, 0] and out[2].improved
    out = tr.early_stop(_table(spark, {"a": [1, 2, 3]}), 0).collect()
    assert not any(r.improved or r.should_stop for r in out)
    out = tr.early_stop(_table(spark, {"a": [0.1, 0.3, 0.2]}), 1, mode="max").orderBy("step").collect()
    assert [r.best for r in out] == [0.1, 0.3, 0.3] and [r.should_stop for r in out] == [False, False, True]


@pytest.mark.parametrize("beta", [0.5, 0.9, 0.999])
def test_ema_over_several_chunks(spark, beta):
    rng = np.random.default_rng(2)
    values = rng.random(1500)
    df = _table(spark, {"a": values}).withColumnRenamed("value", "loss")
    out = tr.ema(df, beta).toPandas().sort_values("step")
    s, want = 0.0, []
    for v in values:
        s = beta * s + (1 - beta) * v
        want.append(s)
    assert np.allclose(out.smooth, want, rtol=1e-10)
    assert np.allclose(out.debiased, np.array(want) / (1 - beta ** np.arange(1, 1501)), rtol=1e-9)


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.random((50, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.random(50) / 10
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    model = fits.fit_ridge(df, ["a", "b", "c"], "y", 0.1)
    aug = np.column_stack([np.ones(50), x])
    reg = 0.1 * np.eye(4)
    reg[0, 0] = 0
    w = np.linalg.solve(aug.T @ aug + reg, aug.T @ y)
    assert np.allclose([model["intercept"], *model["weights"]], w)
    pred = aug @ w
    assert np.isclose(model["r2"], 1 - ((y - pred) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    got = fits.predict(df, model).toPandas()
    assert np.allclose(got.predicted, pred)


def test_isoflop_equals_numpy(spark):
    p = np.array([1e7, 3e7, 1e8, 3e8, 1e9])
    bpb = 0.1 * (np.log10(p) - 8.1) ** 2 + 0.8 + np.array([0.001, -0.002, 0.001, 0.0, 0.002])
    rows = [("f", int(a), float(b), int(a * 20), 20.0 + i) for i, (a, b) in enumerate(zip(p, bpb))]
    rows += [("g", int(a), float(-b), int(a), 1.0) for a, b in zip(p, bpb)]
    df = spark.createDataFrame(rows, "flops_budget string, num_scaling_params bigint, val_bpb double, tokens_trained bigint, param_data_ratio double")
    out = {r.flops_budget: r for r in fits.isoflop_fit(df).collect()}
    a, b, c = np.polyfit(np.log10(p), bpb, 2)
    x = -b / (2 * a)
    f = out["f"]
    assert f.fitted and np.isclose(f.params, 10**x) and np.isclose(f.bpb, a * x * x + b * x + c)
    assert np.isclose(f.tokens, np.interp(x, np.log10(p), p * 20)) and np.isclose(f.ratio, np.interp(x, np.log10(p), 20 + np.arange(5)))
    # A parabola that opens downwards has no optimum: the best run stands in.
    assert not out["g"].fitted and out["g"].bpb == pytest.approx((-bpb).min())
