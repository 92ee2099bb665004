"""Boosted trees against plain searches over all cuts."""

import numpy as np
import pytest

from contestry.operators import trees
from contestry.operators.trees import Limits


def planted(rows, seed=3, levels=21):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (rows, 3)) / 10.0
    p = np.where(x[:, 0] > 1.2, 0.85, np.where(x[:, 1] > 0.5, 0.4, 0.1))
    return x, (rng.random(rows) < p).astype(float), np.round(rng.uniform(0.05, 1.0, rows), 3), p


def frame(spark, x, y, w, partitions=5):
    rows = [(*(None if v is None else float(v) for v in r), float(t), float(k)) for r, t, k in zip(x, y, w)]
    return spark.createDataFrame(rows, "u double, v double, x double, target double, w double").repartition(partitions)


def fitted(spark, df, limits, **options):
    from pyspark.sql import functions as F
    return trees.fit(df, ["u", "v", "x"], "target", F.col("w"), limits, **options)


def plain_tree(x, g, h, limits):
    """(leaf of every row, value of every row) of a tree grown one best split at a time."""
    part = np.zeros(len(x), int)

    def best(rows):
        top = (0.0, None, None)
        for f in range(x.shape[1]):
            for cut in sorted(set(x[rows, f])):
                left = rows & (x[:, f] <= cut)
                right = rows & ~left
                if min(left.sum(), right.sum()) < limits.leaf_rows:
                    continue
                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + limits.penalty)
                gain = worth(left) + worth(right) - worth(rows)
                if gain > top[0] + 1e-9:
                    top = (gain, f, cut)
        return top

    options = {0: best(part == 0)}
    while len(options) < limits.leaves and max(o[0] for o in options.values()) > 0:
        leaf = max(options, key=lambda k: options[k][0])
        _, f, cut = options[leaf]
        new = len(options)
        part[(part == leaf) & (x[:, f] > cut)] = new
        options[leaf], options[new] = best(part == leaf), best(part == new)
    value = np.zeros(len(x))
    for leaf in options:
        rows = part == leaf
        value[rows] = -limits.rate * g[rows].sum() / (h[rows].sum() + limits.penalty)
    return part, value


def test_first_split_equals_search_over_all_cuts(spark):
    x, y, w, _ = planted(700)
    model = fitted(spark, frame(spark, x, y, w), Limits(rounds=1, leaves=2))
    root = next(r for r in model.nodes(spark).collect() if r.node == 0)
    p = (w * y).sum() / w.sum()
    g, h = (p - y) * w, p * (1 - p) * w
    worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 3.0)
    gains = {("uvx"[f], c): worth(x[:, f] <= c) + worth(x[:, f] > c) for f in range(3) for c in set(x[:, f])
             if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= 35}
    assert (root.feature, root.cut) == max(gains, key=gains.get)


@pytest.mark.parametrize("task_rows", [10 ** 6, 0])
def test_rounds_equal_plain_growth(spark, task_rows):
    x, y, w, _ = planted(600, seed=5)
    limits = Limits(rounds=3, rate=0.3, leaves=6, leaf_rows=20)
    model = fitted(spark, frame(spark, x, y, w), limits, task_rows=task_rows)
    p = (w * y).sum() / w.sum()
    score = np.full(len(x), np.log(p / (1 - p)))
    for _ in range(limits.rounds):
        q = 1 / (1 + np.exp(-score))
        score += plain_tree(x, (q - y) * w, q * (1 - q) * w, limits)[1]
    got = model.predict(frame(spark, x, y, w, 1)).select("u", "v", "x", "p").distinct().collect()
    want = {tuple(r): 1 / (1 + np.exp(-s)) for r, s in zip(x.tolist(), score)}
    assert len(got) == len(want) and all(abs(r.p - want[r.u, r.v, r.x]) < 1e-6 for r in got)


def test_tasks_do_not_change_the_trees(spark, monkeypatch):
    monkeypatch.setattr(trees, "KEEP_EVERY", 2)
    x, y, w, _ = planted(900, seed=7)
    limits = Limits(rounds=5, rate=0.2)
    one = fitted(spark, frame(spark, x, y, w, 1), limits)
    many = fitted(spark, frame(spark, x, y, w, 6), limits, task_rows=0)
    assert one.trees == many.trees and len(one.trees) == 5


def test_leaves_and_their_rows(spark):
    x, y, w, _ = planted(1500, seed=9)
    model = fitted(spark, frame(spark, x, y, w), Limits(rounds=20))
    bins = trees.binned(x, model.cuts)
    for tree in model.trees:
        at = trees.placed(bins, tree.splits)
        assert len(tree.values) == len(tree.splits) + 1 <= 15
        assert set(at) == set(tree.values) and min(np.unique(at, return_counts=True)[1]) >= 35


def test_loss_near_the_planted_rule(spark):
    x, y, w, p = planted(4000, seed=11)
    model = fitted(spark, frame(spark, x[:3000], y[:3000], np.ones(3000)), Limits(rounds=150))
    rows = model.predict(frame(spark, x[3000:], y[3000:], p[3000:])).collect()
    loss = lambda q: -np.mean([np.log(a if r.target else 1 - a) for r, a in zip(rows, q)])
    assert loss([r.p for r in rows]) < loss([r.w for r in rows]) + 0.03


@pytest.mark.parametrize("task_rows", [10 ** 6, 0])
def test_nulls_nan_constants_and_empty_tables(spark, task_rows):
    rng = np.random.default_rng(1)
    kinds = [None if k == 0 else float("nan") if k == 1 else 5.0 for k in rng.integers(0, 4, 400)]
    y = [float(k is None or k != k) for k in kinds]
    df = frame(spark, [(k, 1.0, None) for k in kinds], y, np.ones(400))
    lost = spark.createDataFrame([(9.0, 9.0, 9.0, None, 1.0), (9.0, 9.0, 9.0, 1.0, None)], df.schema)
    model = fitted(spark, df.unionByName(lost), Limits(rounds=30, rate=0.3), task_rows=task_rows)
    assert all((r.p > 0.9) == (r.target == 1) and (r.p < 0.1) == (r.target == 0) for r in model.predict(df).collect())
    one_sided = fitted(spark, df.where("target = 1"), Limits(rounds=2), task_rows=task_rows)
    assert all(r.p > 0.99 for r in one_sided.predict(df).collect())
    empty = fitted(spark, df.limit(0), Limits(rounds=2), task_rows=-1 if task_rows == 0 else task_rows)
    assert all(r.p == 0.5 for r in empty.predict(df).collect())
    assert fitted(spark, df, Limits(rounds=1), task_rows=task_rows).predict(df.limit(0)).count() == 0


def test_one_task_adds_up_the_smaller_of_two_children_only(monkeypatch):
    x, y, w, _ = planted(3000)
    cuts = [np.unique(c) for c in x.T]
    block = trees._packed(trees.binned(x, cuts), y, w, np.zeros(len(y)))
    seen, real = [], trees.column_histogram
    monkeypatch.setattr(trees, "column_histogram", lambda columns, rows, g, h: seen.append(len(rows)) or real(columns, rows, g, h))
    nodes = [r for b in trees._one_task(3, Limits(rounds=1, leaf_rows=20))(iter([block])) for r in b.to_pylist()]
    assert seen[0] == 3000 and len(seen) <= Limits.leaves - 1 and max(seen[1:]) <= 1500

    bins = trees.binned(x, cuts)
    g, h = trees.gradients(np.zeros(len(y)), y, w)

    def search(wanted, splits):
        at = {n: trees.placed(bins, {a: splits[a] for a in splits if a in above(n)}) == n for n in wanted}
        return {n: trees.best_split(trees.histogram(bins[r], g[r], h[r]), Limits(leaf_rows=20)) for n, r in at.items()}

    def above(n):
        return {n} if n == 0 else above((n - 1) // 2) | {(n - 1) // 2}

    plain = trees.grow(search, Limits(rounds=1, leaf_rows=20))
    assert {(r["node"], r["feature"], r["bin"]) for r in nodes if r["feature"] >= 0} == {(n, f, b) for n, (f, b) in plain.splits.items()}
    assert {r["node"]: r["value"] for r in nodes if r["feature"] < 0} == plain.values


def grown_bins(leaves, rows=2000, seed=13):
    """Bins and a tree of random cuts."""
    rng = np.random.default_rng(seed)
    bins, splits, open_ = rng.integers(0, 40, (rows, 3)).astype(np.uint8), {}, [0]
    while len(open_) < leaves:
        n = open_.pop(rng.integers(len(open_)))
        splits[n] = (int(rng.integers(3)), int(rng.integers(40)))
        open_ += [2 * n + 1, 2 * n + 2]
    return bins, trees.Tree(splits, {n: float(i + 1) for i, n in enumerate(open_)})


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 40])
def test_leaf_values_and_rows_of_nodes(leaves):
    bins, tree = grown_bins(leaves)
    at = trees.placed(bins, tree.splits)
    score = np.full(len(bins), 0.5)
    trees.add_tree(score, bins, tree)
    assert score.tolist() == [0.5 + tree.values[n] for n in at]
    reached = trees.nodes_reached(bins, tree.splits, sorted(tree.values))
    assert {n: r.tolist() for n, r in reached.items()} == {n: np.flatnonzero(at == n).tolist() for n in tree.values}


def test_a_pass_is_one_job(spark, monkeypatch):
    x, y, w, _ = planted(900, seed=15)
    df = frame(spark, x, y, w, 6).localCheckpoint()
    passes, real = [], trees.grow
    monkeypatch.setattr(trees, "grow", lambda search, *a, **k: real(lambda nodes, s: passes.append(nodes) or search(nodes, s), *a, **k))
    spark.sparkContext.setJobGroup("passes", "trees by passes")
    try:
        fitted(spark, df, Limits(rounds=8, leaves=5), task_rows=0)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("passes")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(passes) >= 16 and len(jobs) <= len(passes) + 10


def test_dealing_out_the_rows_does_not_change_the_trees(spark, monkeypatch):
    x, y, w, _ = planted(900, seed=17)
    df, limits = frame(spark, x, y, w, 1), Limits(rounds=7, rate=0.2)
    plain = fitted(spark, df, limits)
    monkeypatch.setattr(trees, "DEALT_ROWS", 100)
    monkeypatch.setattr(trees, "HELD_EVERY", 2)
    monkeypatch.setattr(trees, "DIRECT_TASKS", 1)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 50)
    assert fitted(spark, df, limits, task_rows=0).trees == fitted(spark, df, limits).trees == plain.trees
