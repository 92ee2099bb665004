import pytest
from conftest import by_key
from pyspark.sql import functions as F

from contestry.functions import rates, rules, text as tx
from contestry.operators import evaluate, ingest, match, models, pairs, project, resample, scoring as sc
from contestry.plans import projection
from contestry.sources import payload


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_shrinkage(spark):
    r = one(spark, rates.smoothed_rate(F.lit(1), F.lit(1), 8.0), rates.smoothed_rate(F.lit(50), F.lit(100), 8.0))
    assert 0.5 < r[0] < 1 and r[1] == 0.5
    snapshot = spark.createDataFrame([(1, 1, 100, 55), (1, 2, 1, 1), (1, 3, 99, 44)], "bracket long, item_id long, picks long, wins long")
    got = by_key(pairs.beta_posterior_rank(snapshot, minimum_picks=1), "item_id")
    assert all(r["lower_95"] <= r["posterior_rate"] <= r["upper_95"] for r in got.values())
    assert 0.5 < got[(2,)]["posterior_rate"] < 0.51
    assert {r["item_id"] for r in pairs.beta_posterior_rank(snapshot, minimum_picks=50).collect()} == {1, 3}


def test_points(spark):
    rows = [("Kills", 2.0, 214.0), ("Deaths", 4.0, 1170.0), ("Creeps", 100.0, 300.0), ("GPM", 600.0, 1200.0), ("Wards", 5.0, 585.0), ("Teamfight", 1.5, 2124.0)]
    df = spark.createDataFrame(rows, "metric string, value double, want double")
    assert all(r["points"] == r["want"] for r in sc.stat_points(df).collect())
    with pytest.raises(Exception, match="unknown metric"):
        sc.stat_points(spark.createDataFrame([("Nothing", 1.0)], "metric string, value double")).collect()
    with pytest.raises(KeyError):
        rules.rule_points("Nothing", F.lit(1.0))
    assert rules.preferred_metrics("Mid", "group") == ["Creeps", "Teamfight", "Runes"]


def test_series_weights(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.15, 0.05, 0.3, 0.2)], "group_id long, undefeated double, winless double, four_one double, "
                               "one_four double, elimination_winners double, elimination_losers double")
    got = {r["k"]: round(r["weight"], 9) for r in projection.series_weights(df).collect()}
    assert got == {4: 0.3, 5: 0.2, 6: 0.5}


def test_bootstrap_of_one_score(spark):
    df = spark.createDataFrame([(1, 5, 10, 100.0)], "group_id long, contest_id long, ts long, points double")
    got = resample.bootstrap_best_series(df, 20, 1, F.lit(1.0)).collect()
    assert sorted(r["k"] for r in got) == [4, 5, 6] and all(r["mean"] == 200.0 and r["p95"] == 200.0 for r in got)


def test_dates(spark):
    r = one(spark, project.day_start(F.lit("2026-08-23")), project.in_phase(F.lit(1787529599), F.lit("2026-08-23"), F.lit("2026-08-23")),
            project.in_phase(F.lit(1787529600), F.lit("2026-08-23"), F.lit("2026-08-23")))
    assert r[0] == 1787443200 and r[1] and not r[2]


def test_roles(spark):
    rows = [(0, 52, 0, 0, 740.0, 1.0, 601.0, "Core"), (0, 1, 77, 0, 643.0, 2.0, 459.0, "Mid"),
            (2, 73, 3, 3, 345.0, 34.0, 52.0, "Support"), (2, 0, 20, 0, 500.0, 2.0, 200.0, "Support")]
    df = spark.createDataFrame(rows, "code int, safe int, mid int, off int, gpm double, wards double, hits double, want string")
    role = project.infer_role(*[F.col(c) for c in ("code", "safe", "mid", "off", "gpm", "wards", "hits")])
    assert all(r["role"] == r["want"] for r in df.withColumn("role", role).collect())


def test_series_chances(spark):
    r = one(spark, rates.series_probability(F.lit(0.5), 3), rates.series_probability(F.lit(0.5), 2), rates.remaining_series_probability(F.lit(0.6), F.lit(1), F.lit(0)))
    assert r[0] == 0.5 and r[1] == 0.25 and abs(r[2] - 0.84) < 1e-12


def test_payload_merges(spark):
    schema = "contest_id long, version int, league string, series long, a_win long, detailed int, payload string"
    index, detail = (1, 1, "League", 7, 1, 0, "{}"), (1, 2, None, None, 0, 1, '{"players":[1]}')
    for rows in ([index, detail], [index, detail, detail], [detail, index]):
        df = spark.createDataFrame(rows, schema)
        r = ingest.merge_non_null(df.drop("detailed", "payload"), "contest_id", "version", ("a_win",)).first()
        assert (r["league"], r["series"], r["a_win"]) == ("League", 7, 0)
        s = ingest.merge_sticky_detail(df, "contest_id", "version").first()
        assert (s["detailed"], s["payload"]) == (1, '{"players":[1]}')
    late = spark.createDataFrame([detail, (1, 3, "Other", None, 1, 0, "{}")], schema)
    assert ingest.merge_sticky_detail(late, "contest_id", "version").first()["payload"] == '{"players":[1]}'


def test_nested_traps(spark):
    doc = ('{"contest_id":1,"players":[{"player_slot":0,"account_id":0,"item_uses":null,"killed_by":{"boss":1}},'
           '{"player_slot":130,"account_id":9,"item_uses":{"smoke":3}}],"objectives":[{"type":"BOSS_KILL","player_slot":null,"slot":"4"},'
           '{"type":"BOSS_KILL","slot":"4"},{"type":"BOSS_KILL","player_slot":"130","slot":"4"}],"picks_bans":null}')
    docs = payload.parse(spark.createDataFrame([(doc,)], "payload string"))
    assert {(r["slot"], r["n"]) for r in payload.event_counts(docs).collect()} == {(4, 1), (130, 1)}
    flat = spark.createDataFrame([(1, 0, 77), (1, 130, 5)], "contest_id long, slot long, member_id long")
    sums = by_key(payload.map_sums(docs, flat), "slot")
    assert sums[(0,)]["member_id"] == 77 and sums[(130,)]["member_id"] == 9
    assert (sums[(0,)]["smokes_used"], sums[(130,)]["smokes_used"]) == (0, 3)
    assert payload.any_flags(docs).first()["any_boss_death"] == 1 and {r["side"] for r in payload.players(docs).collect()} == {0, 1}


def test_draft_rules(spark):
    rows = [(1, None, s, i + 128 * s, 10 + s, 1 - s, item, 1) for s, items in ((0, (1, 2)), (1, (3, 3))) for i, item in enumerate(items)]
    rows += [(1, None, 0, 9, 10, 1, 8, 0), (2, 5, 0, 0, 10, 1, 1, 1), (2, 5, 1, 128, 11, 0, 2, 1), (2, 5, 0, 5, 10, 1, 7, 0)]
    df = spark.createDataFrame(rows, "contest_id long, era long, side long, slot long, entity_id long, won long, item_id long, is_pick long")
    d = pairs.drafts(df, 2)
    matchups = {(r["era"], r["item_id"], r["opponent_id"]): (r["games"], r["wins"]) for r in pairs.item_matchups(d).collect()}
    assert matchups == {(0, 1, 3): (2, 2), (0, 2, 3): (2, 2), (0, 3, 1): (2, 0), (0, 3, 2): (2, 0)}
    synergies = {(r["item_id"], r["ally_id"]): r["games"] for r in pairs.item_synergies(d).collect()}
    assert synergies == {(1, 2): 1, (2, 1): 1, (3, 3): 2}
    bans = {(r["entity_id"], r["item_id"]): r["bans"] for r in pairs.entity_item_stats(d).collect() if r["bans"]}
    assert bans == {(10, 8): 1}


def test_text(spark):
    lines = ["Kills 250%", "Kills 25.09%", "GPM 1800 Yo,", "Tier II +60%", "tier |!|", "a Vampi-ric", "40%"]
    got = match.extract_measures(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r["percent"] for r in got] == [250, 250, 180, None, None, None, None]
    assert [r["tier"] for r in got] == [None, None, None, 3, 3, None, None] and got[5]["trait"] == "Vampiric"
    phrases = match.fuzzy_phrase_match(spark.createDataFrame([("xx tornentor yy",), ("obs wards",), ("zzzz",)], "line string"),
                                       match.phrase_targets(tx.METRIC_ALIASES, 0.72))
    assert {r["line"]: r["label"] for r in phrases.collect()} == {"xx tornentor yy": "Tormentor", "obs wards": "Wards"}


def test_token_match_against_all_pairs(spark):
    import random

    rng = random.Random(8)
    words = ["".join(rng.choice("ab1lo0ie") for _ in range(rng.randint(2, 18))) for _ in range(150)]
    names = list({w if rng.random() < 0.3 else w[:3] + rng.choice("abz") + w[4:] for w in words})
    texts = spark.createDataFrame([(i, " ".join(rng.sample(words, 20))) for i in range(8)], "doc_id long, text string")
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["doc_id"], r["name"]): round(r["score"], 9) for r in match.fuzzy_token_match(texts, frame).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    fold = lambda s: s.translate(str.maketrans("1l0", "iio"))
    for r in texts.collect():
        for name in names:
            best, n = 0.0, len(name)
            for token in set(r["text"].split()):
                if n > 2 and fold(token) == fold(name):
                    best = max(best, 0.995)
                elif n >= 4 and abs(n - len(token)) <= 1:
                    best = max(best, 1 - distance(fold(token), fold(name)) / max(n, len(token)))
            if best >= (0.995 if n <= 3 else 0.79 if n <= 5 else 0.82 if n <= 7 else 0.86):
                want[(r["doc_id"], name)] = round(best, 9)
    assert got == want


def test_logistic_reaches_the_ridge_optimum(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2)) * [1, 20]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] + x[:, 1] / 20)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "u double, v double, target double")
    model = models.logistic_fit(df, ["u", "v"])
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    w, penalty = np.zeros(3), np.diag([0, 0.25, 0.25])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + penalty, z.T @ (p - y) + penalty @ w)
    got = {r["feature"]: r["coefficient"] for r in model.coefficients(spark).collect()}
    assert np.allclose([got["intercept"], got["u"], got["v"]], w, atol=1e-4)
    p = {round(r["u"], 9): r["p"] for r in model.predict(df).collect()}
    assert np.allclose([p[round(float(a), 9)] for a in x[:, 0]], 1 / (1 + np.exp(-z @ w)), atol=1e-4)


def test_split_needs_enough_rows(spark):
    rows = spark.range(300).select(F.col("id").alias("contest_id"), (F.col("id") * 10).alias("ts"))
    parts = {r["part"]: r["count"] for r in evaluate.chrono_split(rows, 2400).groupBy("part").count().collect()}
    assert parts == {"core": 140, "calibration": 100, "test": 60}
    with pytest.raises(Exception, match="chronological split"):
        evaluate.chrono_split(rows, 2900).collect()


def test_phrases_of_a_table_of_one_file_are_matched_by_many_tasks(spark):
    lines = spark.createDataFrame([(f"xx tornentor {n}",) for n in range(40)], "line string").coalesce(1)
    out = match.fuzzy_phrase_match(lines, match.phrase_targets({"Tormentor": ["tormentor"]}, 0.72))
    assert out.rdd.getNumPartitions() > 1 and out.select("score").distinct().count() == 1 and out.count() == 40
