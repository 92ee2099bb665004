import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from contestry.functions import text as tx
from contestry.operators import hot, match, resample, scoring, standings
from contestry.session import run_dir
from contestry.sources import dims, sample_tables as st


def test_every_line_is_a_member(spark):
    lines = st.table(spark, SF, "lineitem").join(st.table(spark, SF, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    members = st.members(spark, SF)
    assert members.count() == lines == members.select("contest_id", "slot").distinct().count()


def test_failing_write_keeps_the_old_result(spark):
    path = run_dir(spark, "sink")
    dims.write_result(spark.range(3), path)
    with pytest.raises(Exception, match="no such rows"):
        dims.write_result(spark.range(5).withColumn("x", F.when(F.col("id") > 3, F.raise_error(F.lit("no such rows"))).otherwise(F.lit("a"))), path)
    assert dims.read_result(spark, path).count() == 3
    dims.write_result(spark.range(7), path)
    dims.drop_old_results(spark, path)
    assert dims.read_result(spark, path).count() == 7


def test_bootstrap_of_three_rows(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.6, 0.5), (2, 0.0, 0.4, 0.5), (3, 1.0, 0.7, 0.5)], "id long, y double, c double, b double")
    r = resample.paired_bootstrap_ci(rows, "id", "y", "c", "b").first()
    assert r.lower <= r.difference <= r.upper < 0


def test_counts_with_a_far_outlier(spark):
    values = [(0, i / 1000) for i in range(5000)] + [(0, 1e9)]
    df = spark.createDataFrame(values, "g long, v double")
    got = {r.v: (r.n_lt, r.n_le) for r in hot.cumulative_counts(df, ["g"], "v").collect()}
    assert got == {v: (i, i + 1) for i, (_, v) in enumerate(values)}
    cuts = df.agg(F.percentile_approx("v", [i / 8 for i in range(1, 8)], 1000)).first()[0]
    assert len(set(cuts)) == 7 and max(cuts) < 5


def test_unrated_entities_stay(spark):
    ratings = spark.createDataFrame([(1, 1600.0, 50.0)], "entity_id long, rating double, deviation double")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "a_id long, b_id long")
    p = {(r.a_id, r.b_id): r.p for r in standings.pairwise_probability(ratings, pairs).collect()}
    assert p[3, 4] == 0.5 and p[1, 2] > 0.5


@pytest.mark.parametrize("line, percent, tier", [
    ("Kills 250%", 250, None), ("seen 25.09 %", 250, None), ("GPM 1809 Yo, seen", 180, None), ("99% then 120 %", 120, None), ("Tier IV", None, 4), ("tier !! +60%", None, 3),
    ("a Tier +110%", 110, 1), ("TIER 5", None, 5), ("tierless", None, None), ("", None, None), (None, None, None)])
def test_measures(spark, line, percent, tier):
    df = spark.createDataFrame([(line,)], "line string").select(tx.percentage(F.col("line")).alias("p"), tx.tier_number(F.col("line")).alias("t"))
    assert tuple(df.first()) == (percent, tier)


def test_advice_order(spark):
    rows = spark.createDataFrame([(1, 10, 5.0, 1), (1, 90, 1.0, 2), (1, 90, 3.0, 3)], "contest_id long, priority long, expected_uplift double, raw_slot long")
    assert {r.raw_slot: r.rank for r in scoring.ranked_advice(rows, ["contest_id"], "raw_slot").collect()} == {3: 1, 2: 2, 1: 3}


@pytest.mark.parametrize("array_rows", [0, 12, 1000])
def test_resampled_series_equal_brute_force(spark, array_rows):
    rng = np.random.default_rng(2)
    rows = [(g, i, int(t), float(p)) for g, n in ((1, 3), (2, 12), (7, 40)) for i, (t, p) in enumerate(zip(rng.integers(0, 9, n), rng.normal(100, 20, n)))]
    df = spark.createDataFrame(rows, "group_id long, contest_id long, ts long, points double")
    got = {(r.group_id, r.k): r for r in resample.bootstrap_best_series(df, 300, 5, F.lit(0.4), array_rows=array_rows).collect()}
    for g in (1, 2, 7):
        points = [p for _, _, _, p in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))]
        places, third = resample.series_draws(5, g, len(points), 0.4, 300)
        for k in (4, 5, 6):
            best = []
            for replicate in range(300):
                series = []
                for s in range(k):
                    drawn = [points[i] for i in places[replicate, s][:3 if third[replicate, s] else 2]]
                    series.append(sum(sorted(drawn)[-2:]))
                best.append(max(series))
            assert np.isclose(got[g, k].mean, np.mean(best)) and np.isclose(got[g, k].p90, np.quantile(best, 0.9))
    assert len(got) == 9


def test_long_names_are_found_by_parts(spark):
    from contestry.operators import match

    rng = np.random.default_rng(6)
    letters = list("abcdef")
    names = ["".join(rng.choice(letters, n)) for n in rng.integers(14, 24, 25)]
    tokens = []
    for name in names:
        for edits in (0, 1, 2, 3, 4):
            chars = list(name)
            for _ in range(edits):
                at = int(rng.integers(0, len(chars)))
                kind = rng.integers(0, 3)
                chars[at:at + (kind < 2)] = ["x"] if kind == 0 else [] if kind == 1 else ["y"]
            tokens.append("".join(chars))
    t = spark.createDataFrame([(x,) for x in set(tokens)], "token string")
    got = {(r.token, r.name) for r in match.fuzzy_tokens(t, spark.createDataFrame([(x,) for x in names], "name string")).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(x, n) for x in tokens for n in names if x == n or abs(len(x) - len(n)) <= 1 and 1 - distance(x, n) / max(len(x), len(n)) >= 0.86}
    assert got == want and len(want) > 60


def test_readings_are_compared_with_what_was_kept(spark):
    from contestry.operators import match

    columns = "source long, metric long, multiplier long, slot long, confidence double, tier long, trait string, trait_bonus long"
    rows = [(1, 1, 100, 1, 0.5, 1, None, None), (1, 1, 105, 2, 0.4, None, "a", None), (1, 1, 110, 3, 0.4, None, None, None),  # 110 is beyond the kept 100
            (1, 2, 100, 1, 0.5, None, None, None), (1, 2, 104, 2, 0.9, 3, None, 7), (1, 2, 108, 3, 0.1, None, None, None),  # the kept one has become 104
            (2, 1, None, 1, 0.5, None, None, None), (2, 1, None, 2, 0.5, None, None, None), (None, None, 100, 1, 0.5, None, None, None)]
    got = sorted(map(tuple, match.dedupe_readings(spark.createDataFrame(rows, columns).repartition(3), ["source", "metric"]).collect()), key=str)
    assert got == sorted([
        (1, 1, 100, 1, 1, "a", None, 0.5, 2), (1, 1, 110, 3, None, None, None, 0.4, 1), (1, 2, 104, 1, 3, None, 7, 0.9, 3),
        (2, 1, None, 1, None, None, None, 0.5, 1), (2, 1, None, 2, None, None, None, 0.5, 1), (None, None, 100, 1, None, None, None, 0.5, 1)], key=str)
    assert match.dedupe_readings(spark.createDataFrame([], columns), ["source", "metric"]).count() == 0


def test_distinct_sketches_merge_within_their_error(spark, tmp_path):
    from contestry.operators import standings

    rows = spark.range(60_000).selectExpr("id % 2 AS g", "id % 20000 AS v", "cast(id % 50 as string) AS w")
    parts = []
    for n in range(3):
        standings.distinct_sketches(rows.where(f"id % 3 = {n}" if "id" in rows.columns else f"v % 3 = {n}"), ["g"], ["v", "w"]).write.parquet(f"{tmp_path}/{n}")
        parts.append(spark.read.parquet(f"{tmp_path}/{n}"))
    got = {r.g: r for r in standings.merge_sketches(parts, ["g"], ["v", "w"]).collect()}
    assert all(got[g].n == 30_000 and abs(got[g].v - 10_000) < 0.05 * 10_000 and got[g].w == 25 for g in (0, 1))


def test_order_lines_are_dealt_by_their_number(spark, monkeypatch):
    lines = st.table(spark, SF, "lineitem").count()
    whole = {(r["contest_id"], r["slot"]) for r in st.members(spark, SF).select("contest_id", "slot").collect()}
    monkeypatch.setattr(st, "TASK_LINES", lines // 20)
    assert st.line_tasks(spark, SF) >= 20  # however few shuffle partitions the session has
    sizes = [n for n in st.members(spark, SF).select("contest_id", "slot").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) >= 20 and sum(sizes) == lines == len(whole) and max(sizes) < lines / 5


@pytest.mark.parametrize("points", [np.arange(40) % 7 * 1.1, np.arange(39) * 0.7 - 9.1, np.random.default_rng(3).normal(9, 4, 300), np.array([2.5]), np.array([1.0, np.nan, 3.0])])
def test_summaries_by_rank_equal_those_of_the_draws(points):
    for group in (0, 11, -4):
        want = resample.best_summaries(points, *resample.series_draws(5, group, len(points), 0.4, 2000))
        assert np.array_equal(resample.group_summaries(5, group, points, 0.4, 2000), want, equal_nan=True)


def test_small_groups_are_resampled_by_many_tasks(spark):
    rows = spark.range(64 * 3).selectExpr("id % 64 AS group_id", "id AS contest_id", "id AS ts", "id * 1.0e0 AS points")
    tasks = resample.bootstrap_best_series(rows, 20, 1, F.lit(0.4)).select("group_id", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in tasks}) > 1 and len({r.group_id for r in tasks}) == 64


def test_counts_of_groups_are_equal_cut_or_whole(spark):
    df = spark.range(900).selectExpr("IF(id < 10, NULL, id % 3) AS g", "IF(id % 11 = 0, NULL, CAST(id * id % 97 AS DOUBLE)) AS v")
    want = sorted(hot.cumulative_counts(df, ["g"], "v").collect())
    for most in (0, 89, 90):
        assert sorted(hot.cumulative_counts(df, ["g"], "v", buckets=8, sorted_values=most).collect()) == want
    rows = [r for r in df.collect() if r.g is not None and r.v is not None]
    assert all((r.n_lt, r.n_le, r.n_all) == (sum(x.g == r.g and x.v < r.v for x in rows), sum(x.g == r.g and x.v <= r.v for x in rows), sum(x.g == r.g for x in rows)) for r in want)
    for r in hot.exact_quantiles(df, ["g"], "v", {"p50": 0.5}, "mean").collect():
        values = [x.v for x in rows if x.g == r.g]
        assert np.isclose(r.mean, np.mean(values)) and r.p50 == np.quantile(values, 0.5)


def test_tokens_equal_the_keys_of_all_matches(spark):
    texts = ["Foo.Bar -baz_ .. [x]`y foo-bar", "", None, "..-_", "Kelvin İstanbul naïve \U0001f600a-b A\u0000B", "x" * 40 + " Y_9\tq\r\nX", "KELVIN kelvin K.E.L.V.I.N"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(tx.TOKEN), F.lit(0)), tx.ascii_key))
    want = sorted(df.select("doc_id", F.explode(found).alias("token")).where("token <> ''").collect())
    assert sorted(match.tokens(df).collect()) == want and len(want) > 12


def test_tokens_do_not_move_to_be_matched(spark):
    df = spark.createDataFrame([(1, "magentaa Peach"), (2, "peach lemon")], "doc_id long, text string")
    found = match.fuzzy_token_match(df, spark.createDataFrame([("magenta",), ("peach",)], "name string"))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.name, r.exact) for r in found.collect()} == {(1, "magenta", 0), (1, "peach", 1), (2, "peach", 1)}
