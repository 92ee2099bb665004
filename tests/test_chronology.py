import random

import pytest
import reference_fold as fold
from conftest import by_key, close
from pyspark.sql import functions as F

from contestry.operators import chronology as ch, hot, lineups
from contestry.plans import features


def skewed(spark, rows=1500):
    """One entity takes part in most contests; many equal times."""
    rng = random.Random(5)
    data = []
    for i in range(rows):
        a, b = (1, rng.randint(2, 9)) if rng.random() < 0.7 else rng.sample(range(2, 12), 2)
        if rng.random() < 0.5:
            a, b = b, a
        data.append((i, rng.randint(0, 400) * 43_200, 2000 + rng.randint(0, 2), None if rng.random() < 0.3 else rng.randint(0, 40),
                     a, b, int(rng.random() < 0.6), "amateur", 0))
    return spark.createDataFrame(
        data, "contest_id long, ts long, era long, series_id long, a_id long, b_id long, a_win long, tier string, pool long")


@pytest.fixture(scope="module")
def hot_contests(spark):
    return skewed(spark).cache()


def test_sliced_hot_keys_change_nothing(spark, hot_contests):
    for make, keys in (
        (ch.entity_form, ("contest_id", "side")), (lambda c, **k: ch.activity(c, **k), ("contest_id", "side")), (ch.era_form, ("contest_id", "side")),
        (ch.head_to_head, ("contest_id",)), (ch.series_score, ("contest_id",)),
    ):
        close(by_key(make(hot_contests), *keys), by_key(make(hot_contests, hot_rows=40), *keys))


def test_features_equal_a_sequential_fold(spark, hot_contests):
    rows = [r.asDict() for r in hot_contests.collect()]
    got = features.contest_features(hot_contests)
    columns = list(next(iter(fold.features(rows).values())))
    close(by_key(got.select(*columns), "contest_id"), fold.features(rows))


def test_no_value_sees_the_own_result(spark, hot_contests):
    last = hot_contests.orderBy(F.desc("ts"), F.desc("contest_id")).first()["contest_id"]
    flipped = hot_contests.withColumn("a_win", F.when(F.col("contest_id") == last, 1 - F.col("a_win")).otherwise(F.col("a_win")))
    close(by_key(features.contest_features(hot_contests).drop("target"), "contest_id"),
          by_key(features.contest_features(flipped).drop("target"), "contest_id"))


def test_two_contests(spark):
    rows = [(1, 1000, 60, "premium", 99, 10, 20, 1, 0), (2, 2000, 60, "premium", 99, 10, 20, 1, 0)]
    c = spark.createDataFrame(rows, "contest_id long, ts long, era long, tier string, series_id long, a_id long, b_id long, a_win long, pool long")
    got = by_key(features.contest_features(c), "contest_id")
    assert got[(1,)]["recent_5_difference"] == 0 and got[(1,)]["series_difference"] == 0
    assert got[(2,)]["recent_5_difference"] > 0 and got[(2,)]["series_difference"] == 1


def test_long_history_ema(spark):
    """More rows than two chunks of the exponential average."""
    rng = random.Random(1)
    rows = [(i, i * 1000, 1, None, 1, 2, rng.randint(0, 1), "other", 0) for i in range(700)]
    c = spark.createDataFrame(rows, "contest_id long, ts long, era long, series_id long, a_id long, b_id long, a_win long, tier string, pool long")
    got, ema = by_key(ch.entity_form(c).where("side = 0"), "contest_id"), 0.5
    for r in rows:
        assert abs(got[(r[0],)]["ema_form"] - ema) < 1e-12
        ema = 0.15 * r[6] + 0.85 * ema


def test_global_index_and_side_rate(spark, hot_contests):
    got = hot.global_index(hot_contests.select("contest_id", "ts"), ["ts", "contest_id"]).orderBy("ts", "contest_id").collect()
    assert [r["idx"] for r in got] == list(range(len(got)))
    small = by_key(ch.global_side_rate(hot_contests, size=50, bucket=64), "contest_id")
    seen = []
    for r in sorted(hot_contests.collect(), key=lambda r: (r["ts"], r["contest_id"])):
        window = seen[-50:]
        assert abs(small[(r["contest_id"],)]["side_rate"] - (sum(window) + 10) / (len(window) + 20)) < 1e-12
        seen.append(r["a_win"])


def test_quantiles_and_counts(spark):
    import numpy as np

    rng = random.Random(2)
    values = {g: [round(rng.gauss(0, 5), 1) for _ in range(n)] for g, n in (("hot", 3000), ("one", 1), ("flat", 4))}
    values["flat"] = [2.0] * 4
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = by_key(hot.exact_quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}), "g")
    for g, vs in values.items():
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q95", 0.95)):
            assert abs(got[(g,)][name] - np.quantile(vs, q)) < 1e-9
    for r in hot.cumulative_counts(df, ["g"], "v", buckets=16).where("g = 'hot'").collect():
        assert r["n_le"] == sum(v <= r["v"] for v in values["hot"]) and r["n_lt"] == sum(v < r["v"] for v in values["hot"])


def test_lineups(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([5, 3, 1, 2, 4],), ([1, 2, 3, 4, 6],)], "ids array<long>")
    keys = [r[0] for r in df.select(lineups.lineup_key(F.col("ids"))).collect()]
    assert keys[0] == keys[1] != keys[2] and len(keys[0]) == 20


def test_lineup_experience_sliced(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 200) * 1000, 1, 1, 2, sorted(rng.sample(range(1, 5), 2)), sorted(rng.sample(range(5, 9), 2))) for i in range(300)]
    d = spark.createDataFrame(rows, "contest_id long, ts long, a_win long, a_id long, b_id long, a_keys array<long>, b_keys array<long>")
    s = lineups.sides(d)
    for make in (lineups.member_experience, lineups.lineup_experience, lineups.pair_experience, lineups.retained_members):
        close(by_key(make(s), "contest_id", "side"), by_key(make(s, hot_rows=20), "contest_id", "side"))


@pytest.mark.parametrize("times", [lambda i: 5, lambda i: 10 ** 9 if i == 999 else i // 10, lambda i: i if i < 300 else 300, lambda i: i])
def test_hot_key_is_cut_whatever_its_times(spark, times):
    rows = [(1, times(i), i, i % 7) for i in range(1000)] + [(2, 3, i, 1) for i in range(20)] + [(None, 1, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, ts long, id long, v long").repartition(3)
    sliced = hot.slice_hot_keys(df, ["k"], ["ts", "id"], 100)
    sizes = {r[hot.SLICE]: (r.n, r.lo, r.hi) for r in sliced.where("k = 1").groupBy(hot.SLICE).agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("lo"), F.max(F.struct("ts", "id")).alias("hi")).collect()}
    assert len(sizes) >= 8 and max(n for n, _, _ in sizes.values()) <= 250
    bounds = [sizes[k][1:] for k in sorted(sizes)]
    assert all(tuple(a[1]) < tuple(b[0]) for a, b in zip(bounds, bounds[1:]))
    assert sliced.where("k = 2 or k is null").agg(F.max(hot.SLICE)).first()[0] == 0
    summed = hot.prefix_sums(df, ["k"], ["ts", "id"], {"s": F.col("v")}, 100).where("k = 1").orderBy("ts", "id").collect()
    assert [r.s for r in summed] == [sum(r.v for r in summed[:i]) for i in range(1000)]
    index = hot.global_index(df.where("k = 1"), ["ts", "id"], slice_rows=50).orderBy("ts", "id").collect()
    assert [r.idx for r in index] == list(range(1000))


def test_window_without_hot_keys_reads_its_input_once(spark, contests):
    plan = ch.entity_form(ch.valid_contests(contests))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == ch.valid_contests(contests)._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_keys_known_not_to_be_hot_are_not_counted(spark, contests):
    from contestry.plans import features

    valid = ch.valid_contests(contests)
    sides = [r for row in valid.select("a_id", "b_id").collect() for r in row]
    most = max(sides.count(i) for i in set(sides))
    assert features._hot_rows(valid, 2 * most) is None and features._hot_rows(valid, 2 * most - 1) == 2 * most - 1
    assert features._hot_rows(valid.limit(0), 10) is None
    for form in (ch.entity_form, ch.activity, ch.era_form):
        close(by_key(form(valid, hot_rows=None), "contest_id", "side"), by_key(form(valid, hot_rows=most // 2), "contest_id", "side"))
    for form in (ch.head_to_head, ch.series_score):
        close(by_key(form(valid, hot_rows=None), "contest_id"), by_key(form(valid, hot_rows=1), "contest_id"))
