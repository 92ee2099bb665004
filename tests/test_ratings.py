import random

import numpy as np
import pytest
import reference_fold as fold
from conftest import by_key, close
from pyspark.sql import functions as F

from contestry.functions import rates
from contestry.operators import ratings


def test_published_period():
    r, d, s = ratings.period_update(*[np.array([x]) for x in (1500.0, 200.0, 0.06)], *[np.array([x]) for x in _sums(
        1500.0, 200.0, [(1400, 30, 1), (1550, 100, 0), (1700, 300, 0)])])
    assert abs(r[0] - 1464.06) < 0.01 and abs(d[0] - 151.52) < 0.01 and abs(s[0] - 0.059996) < 1e-6


def _sums(r, d, results):
    q = 173.7178
    inverse = gain = 0.0
    for orr, od, score in results:
        g = 1 / np.sqrt(1 + 3 * (od / q) ** 2 / np.pi ** 2)
        e = 1 / (1 + np.exp(-g * (r - orr) / q))
        inverse, gain = inverse + g * g * e * (1 - e), gain + g * (score - e)
    return inverse, gain


def test_odds(spark):
    df = spark.createDataFrame([(1500.0, 1500.0), (1600.0, 1500.0), (1500.0, 1600.0)], "a double, b double")
    p = [r[0] for r in df.select(rates.elo_expected(F.col("a"), F.col("b"))).collect()]
    assert p[0] == 0.5 and abs(p[1] + p[2] - 1) < 1e-12


def test_elo_equals_a_sequential_fold(spark, contests):
    rows = [r.asDict() for r in contests.collect()]
    got = ratings.elo_history(contests).select("contest_id", "a_rating", "b_rating", "a_games", "b_games", "a_expected")
    close(by_key(got, "contest_id"), fold.elo(rows))


def test_glicko_equals_a_sequential_fold(spark, contests):
    rows = [r.asDict() for r in contests.collect()]
    want = fold.glicko(rows)
    got = ratings.glicko_history(ratings.glicko_timeline(contests)).select(*next(iter(want.values())))
    close(by_key(got, "day", "entity_id"), want, 1e-5)


def one_pool(spark, days, contests=60, shared=False):
    rng = random.Random(11)
    rows = [(i, rng.randrange(days) * 86_400 + rng.randrange(4), "premium" if i % 3 else None, *rng.sample(range(1, 30), 2), rng.randint(0, 1), i % 2)
            for i in range(contests)]
    rows = [(i, t, tier, a + 100 * p * (not shared), b + 100 * p * (not shared), w, p) for i, t, tier, a, b, w, p in rows]
    return spark.createDataFrame(rows, "contest_id long, ts long, tier string, a_id long, b_id long, a_win long, pool long")


@pytest.mark.parametrize("shared", [False, True])
def test_wavefront_equals_the_fold(spark, shared):
    c = one_pool(spark, 6, shared=shared)
    columns = ["contest_id", "a_rating", "b_rating", "a_games", "b_games", "a_expected", "a_after", "b_after"]
    folded = ratings.elo_history(c).select(*columns)
    waves = ratings.elo_history(c, pool_rows=1, block_seconds=2 * 86_400).select(*columns)
    close(by_key(folded, "contest_id"), by_key(waves, "contest_id"))


def test_member_wavefront_equals_the_fold(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(5) * 1000, 0, rng.randint(0, 1), sorted(rng.sample(range(1, 12), 3)), sorted(rng.sample(range(12, 24), 3))) for i in range(25)]
    d = spark.createDataFrame(rows, "contest_id long, ts long, pool long, a_win long, a_keys array<long>, b_keys array<long>")
    columns = ["contest_id", "a_rating", "b_rating", "a_expected", "a_before", "b_before", "a_games", "b_games"]
    folded = by_key(ratings.member_ratings(d).select(*columns), "contest_id")
    waves = by_key(ratings.member_ratings(d, pool_rows=1).select(*columns), "contest_id")
    for k, row in folded.items():
        for c in columns:
            assert np.allclose(row[c], waves[k][c])
    history = ratings.member_side_history(ratings.member_ratings(d))
    assert history.count() == 25 * 6
    deltas = history.withColumn("x", F.round(F.col("after") - F.col("before"), 9)).groupBy("contest_id").agg(F.sum("x").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-6 for r in deltas)


def test_overlapping_sides_and_shared_members(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(4) * 1000, i % 2, rng.randint(0, 1), sorted(rng.sample(range(1, 8), 3)), sorted(rng.sample(range(4, 11), 3))) for i in range(24)]
    d = spark.createDataFrame(rows, "contest_id long, ts long, pool long, a_win long, a_keys array<long>, b_keys array<long>")
    columns = ["contest_id", "a_rating", "b_rating", "a_expected", "a_before", "b_before", "a_games", "b_games"]
    folded = by_key(ratings.member_ratings(d).select(*columns), "contest_id")
    waves = by_key(ratings.member_ratings(d, pool_rows=1).select(*columns), "contest_id")
    rating, games = {}, {}
    for i, _, pool, win, a, b in sorted(rows, key=lambda r: (r[1], r[0])):
        before = [[rating.get((pool, m), 1500.0) for m in side] for side in (a, b)]
        for got in (folded, waves):
            assert np.allclose(got[i,]["a_before"], before[0]) and np.allclose(got[i,]["b_before"], before[1])
            assert list(got[i,]["a_games"]) == [games.get((pool, m), 0) for m in a]
        expected = 1 / (1 + 10 ** ((np.mean(before[1]) - np.mean(before[0])) / 400))
        for side, delta in ((a, 24 * (win - expected)), (b, 24 * (expected - win))):
            for m in side:
                rating[pool, m] = rating.get((pool, m), 1500.0) + delta
        for m in {*a, *b}:
            games[pool, m] = games.get((pool, m), 0) + 1


@pytest.mark.parametrize("shared, partitions", [(False, 4), (True, 1), (True, 3)])
def test_period_rounds_equal_the_fold(spark, shared, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        compare_periods(one_pool(spark, 4, 40, shared))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def compare_periods(c):
    columns = ["kind", "pool", "contest_id", "day", "entity_id", "rating", "deviation", "volatility", "other_rating", "other_deviation", "contests", "wins"]
    keys = ("kind", "pool", "contest_id", "day", "entity_id")
    close(by_key(ratings.glicko_timeline(c).select(*columns), *keys), by_key(ratings.glicko_timeline(c, pool_rows=1).select(*columns), *keys), 1e-7)


def test_pool_violations(spark):
    rows = [(1, 10, 1, 2, 1, 0), (2, 11, 2, 3, 1, 1)]
    c = spark.createDataFrame(rows, "contest_id long, ts long, a_id long, b_id long, a_win long, pool long")
    assert [r["entity_id"] for r in ratings.pool_violations(c).collect()] == [2]


@pytest.mark.parametrize("block_rows", [7, 25])
def test_blocks_with_a_busy_entity(spark, block_rows):
    rng = random.Random(3)
    rows = []
    for i in range(90):  # entity 1 plays a third of all contests, many at one moment
        a, b = (1, rng.randrange(2, 9)) if i % 3 == 0 else rng.sample(range(2, 40), 2)
        rows.append((i, rng.randrange(12) * 86_400, "premium" if i % 2 else None, a, b, rng.randint(0, 1), 5))
    c = spark.createDataFrame(rows, "contest_id long, ts long, tier string, a_id long, b_id long, a_win long, pool long")
    columns = ["contest_id", "a_rating", "b_rating", "a_games", "b_games", "a_expected", "a_after", "b_after"]
    whole = by_key(ratings.elo_history(c).select(*columns), "contest_id")
    close(whole, by_key(ratings.elo_history(c, pool_rows=1, block_rows=block_rows).select(*columns), "contest_id"))
    sides = c.select("contest_id", "ts", "pool", F.lit(20.0).alias("base_k"), "a_win", F.array("a_id").alias("a_keys"), F.array("b_id").alias("b_keys"))
    placed = ratings.conflict_blocks(sides, block_rows).collect()
    assert len({r.block for r in placed}) == -(-90 // block_rows)  # rounds follow the contests, not entity 1
    order = [r.block for r in sorted(placed, key=lambda r: (r.ts, r.contest_id))]
    assert order == sorted(order)
    for block in set(order):
        parts = {}
        for r in placed:
            if r.block == block:
                parts.setdefault(r.component, set()).update([*r.a_keys, *r.b_keys])
        assert sum(map(len, parts.values())) == len(set().union(*parts.values()))  # no key in two components


def test_components_are_connected():
    import pandas as pd

    block = pd.DataFrame({"a_keys": [[1], [9], [3, 4], [30]], "b_keys": [[2], [2], [5], [31]]})
    assert list(ratings._components(block).component) == [1, 1, 3, 30]
    chain = pd.DataFrame({"a_keys": [[i] for i in range(99, 0, -1)], "b_keys": [[i - 1] for i in range(99, 0, -1)]})
    assert set(ratings._components(chain).component) == {0}


def test_no_contests_give_no_rounds(spark):
    sides = spark.createDataFrame([], ratings.SIDES_SCHEMA)
    assert ratings.fold_blocks(sides, True).count() == 0
