"""Fitted models against Newton steps on whole arrays."""

import numpy as np
import pytest

from contestry.operators import models

DAY = 86_400


def newton(x, y, weight, penalty):
    """Minimum of the weighted log loss + penalty / 2 |coefficients|^2 with a free intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [penalty] * x.shape[1])
    beta = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ beta)
    return beta


def predict(beta, x):
    return 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))


def test_grid_equals_newton_steps(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 2)) * [1.0, 5.0] + [0.0, 3.0]
    y = (rng.random(240) < predict(np.array([0.2, 0.8, -0.2]), x)).astype(float)
    ts = rng.integers(0, 900, 240) * DAY
    cutoff = 900 * DAY
    part = np.where(np.arange(240) < 160, "core", "calibration")
    df = spark.createDataFrame([(int(t), float(u), float(v), float(w), str(p)) for t, (u, v), w, p in zip(ts, x, y, part)],
                               "ts long, u double, v double, target double, part string")
    model, chosen, losses = models.logistic_grid(df, ["u", "v"], cutoff)

    core = part == "core"
    weight = np.maximum(0.05, 0.5 ** ((cutoff - ts[core]) / DAY / 120.0))
    centre, spread = x[core].mean(0), x[core].std(0)
    want, betas = {}, {}
    for c in models.GRID:
        betas[c] = newton((x[core] - centre) / spread, y[core], weight, 1 / c)
        p = predict(betas[c], (x[~core] - centre) / spread)
        want[c] = -np.mean(y[~core] * np.log(p) + (1 - y[~core]) * np.log(1 - p))
    got = {r.c: r.calibration_loss for r in losses.collect()}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-5 for c in want)
    assert chosen == min(want, key=lambda c: (want[c], c))
    found = {r.feature: r.coefficient for r in model.coefficients(spark).collect()}
    assert np.allclose([found["intercept"], found["u"], found["v"]], betas[chosen], atol=1e-3)


def test_platt_equals_newton_steps(spark):
    rng = np.random.default_rng(9)
    raw = rng.uniform(0.02, 0.98, 150)
    y = (rng.random(150) < raw ** 2).astype(float)
    df = spark.createDataFrame([(i, float(r), float(t)) for i, (r, t) in enumerate(zip(raw, y))], "contest_id long, raw double, target double")
    got = {r.contest_id: r.p for r in models.apply_platt(models.platt_calibrate(df), df).collect()}
    score = np.log(raw / (1 - raw))[:, None]
    want = predict(newton(score, y, np.ones(150), 1 / 10.0), score)
    assert np.allclose([got[i] for i in range(150)], want, atol=1e-4)


def test_top_coefficients_by_size(spark):
    rows = [("intercept", 9.0), *[(f"f{i:02}", (-1) ** i * float(i % 9)) for i in range(20)]]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    want = sorted(rows[1:], key=lambda r: (-abs(r[1]), r[0]))[:12]
    assert [tuple(r) for r in models.top_coefficients(df).collect()] == want


@pytest.mark.parametrize("rounds", [40])
def test_boosted_trees_learn_a_planted_rule(spark, rounds):
    rng = np.random.default_rng(10)
    x = rng.uniform(-1, 1, (1200, 3))
    p = np.where((x[:, 0] > 0) ^ (x[:, 1] > 0), 0.9, 0.1)  # no single feature tells anything
    y = (rng.random(1200) < p).astype(float)
    df = spark.createDataFrame([(0, *map(float, r), float(t)) for r, t in zip(x, y)], "ts long, u double, v double, w double, target double")
    model = models.boosted_fit(df.limit(800), ["u", "v", "w"], 0, rounds)
    rows = model.predict(df, "raw").select("target", "raw", "u", "v").collect()
    loss = -np.mean([np.log(r.raw if r.target else 1 - r.raw) for r in rows])
    assert loss < 0.55  # 0.693 without the rule
    assert np.mean([(r.raw > 0.5) == ((r.u > 0) != (r.v > 0)) for r in rows]) > 0.9


def test_baseline_table_is_made_once(spark):
    from contestry.plans import training

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rng = np.random.default_rng(4)
    rows = [(i, i, *map(float, rng.normal(0, 1, 8)), float(rng.random() < 0.5), 0.5) for i in range(200)]
    table = spark.createDataFrame(rows, ["contest_id", "ts", *models.BASELINE_FEATURES, "target", "elo_probability"])
    _, metrics = training.train_baseline(table.mapInPandas(count, table.schema), 150)
    assert {(r.source, r.samples) for r in metrics.collect()} == {("model", 50), ("elo", 50)} and made.value == 200
