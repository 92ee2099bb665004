from pyspark.sql import functions as F

from contestry.catalog.chronology import ELO_SQL
from contestry.catalog.registry import query, rounded
from contestry.catalog.scoring import GROUPS, MC, POINTS, SINCE, STATS, _scored, group_rows, groups, member_rows, points_sql
from contestry.functions import rates, rules
from contestry.operators import chronology as ch, evaluate, lineups, models, ratings, resample, scoring as sc
from contestry.plans import features, projection, training
from contestry.session import materialize, run_dir
from contestry.sources import sample_tables as st

CUTOFF = 978307200
LOSS = "-(y * ln(least(1 - 1e-9, greatest(1e-9, {0}))) + (1 - y) * ln(1 - least(1 - 1e-9, greatest(1e-9, {0}))))"


@query("q_eval_probability", f"""WITH {st.SQL_PROBABILITIES}, b AS (SELECT least(floor(p1 * 10), 9) AS bin, count(*) AS n, sum(p1) AS sp, sum(y) AS sy FROM probs GROUP BY 1)
SELECT count(*) AS samples, round(avg({LOSS.format('p1')}), 6) AS log_loss, round(avg((p1 - y) * (p1 - y)), 6) AS brier,
  round(avg(CASE WHEN (p1 >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round((SELECT sum(abs(sp - sy)) / sum(n) FROM b), 6) AS calibration_error FROM probs""")
def eval_probability(spark, d):
    return rounded(evaluate.eval_probability(st.probabilities(spark, d), "y", "p1"))


@query("q_calibration_table", f"""WITH {st.SQL_PROBABILITIES} SELECT CAST(least(floor(p1 * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p1), 6) AS mean_p, round(avg(y), 6) AS mean_y,
  round(count(*) / (SELECT count(*) FROM probs), 6) AS share FROM probs GROUP BY 1""")
def calibration_table(spark, d):
    return rounded(evaluate.calibration_table(st.probabilities(spark, d), "y", "p1"))


@query("q_standardize", """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / sd, 6) AS o_totalprice, CAST(0 AS DOUBLE) AS flat FROM orders, s""")
def standardize(spark, d):
    orders = st.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(3.0).alias("flat"))
    return rounded(evaluate.standardize(orders, ["o_totalprice", "flat"]))


@query("q_chrono_split", f"""WITH {st.SQL_VALID}, i AS (SELECT contest_id, ts, row_number() OVER (ORDER BY ts, contest_id) - 1 AS i FROM valid),
t AS (SELECT count(*) AS n FROM valid WHERE ts < {CUTOFF}) SELECT contest_id, CASE WHEN ts >= {CUTOFF} THEN 'test'
  WHEN i >= n - greatest(100, floor(n * 0.2)) THEN 'calibration' ELSE 'core' END AS part FROM i, t""")
def chrono_split(spark, d):
    rows = ch.valid_contests(st.contests(spark, d)).select("contest_id", "ts")
    return evaluate.chrono_split(rows, CUTOFF).select("contest_id", "part")


@query("q_time_weight", f"""WITH {st.SQL_VALID} SELECT contest_id, round(greatest(0.05, pow(0.5, greatest(({CUTOFF} - ts) / 86400.0, 0) / 120.0)), 6) AS weight FROM valid""")
def time_weight(spark, d):
    v = ch.valid_contests(st.contests(spark, d))
    return rounded(v.select("contest_id", models.age_weight(CUTOFF).alias("weight")))


def bits_sql(*parts: str) -> str:
    return "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) AS BIGINT)"


WEIGHT_SQL = " + ".join(f"(CASE WHEN u >= {c!r}e0 THEN 1 ELSE 0 END)" for c in resample.POISSON_CUTS)


@query("q_paired_bootstrap_ci", f"""WITH {st.SQL_PROBABILITIES}, d AS (SELECT doc_id, {LOSS.format('p2')} - ({LOSS.format('p1')}) AS d FROM probs),
c AS (SELECT d, r AS replicate, {bits_sql("'2026'", 'r', 'doc_id')} / 4294967296e0 AS u FROM d, range(1, 2001) t(r)),
w AS (SELECT replicate, d, {WEIGHT_SQL} AS w FROM c), m AS (SELECT replicate, sum(w * d) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1)
SELECT round((SELECT avg(d) FROM d), 6) AS difference, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM m""")
def paired_bootstrap_ci(spark, d):
    return rounded(resample.paired_bootstrap_ci(st.probabilities(spark, d), "doc_id", "y", "p2", "p1"))


@query("q_promotion_gate", f"""WITH {st.SQL_PROBABILITIES}, d AS (SELECT doc_id, {LOSS.format('p2')} - ({LOSS.format('p1')}) AS d FROM probs),
c AS (SELECT d, r AS replicate, {bits_sql("'2026'", 'r', 'doc_id')} / 4294967296e0 AS u FROM d, range(1, 2001) t(r)),
w AS (SELECT replicate, d, {WEIGHT_SQL} AS w FROM c), m AS (SELECT replicate, sum(w * d) / sum(w) AS m FROM w WHERE w > 0 GROUP BY 1),
x AS (SELECT avg({LOSS.format('p2')}) AS cl, avg({LOSS.format('p1')}) AS bl, avg((p2 - y) * (p2 - y)) AS cb, avg((p1 - y) * (p1 - y)) AS bb FROM probs),
q AS (SELECT quantile_cont(m, 0.975) AS upper FROM m)
SELECT round(cl, 6) AS candidate_loss, round(bl, 6) AS baseline_loss, CASE WHEN cl < bl AND cb < bb THEN 1 ELSE 0 END AS provisional,
  CASE WHEN cl < bl AND cb < bb AND upper < 0 THEN 1 ELSE 0 END AS promoted FROM x, q""")
def promotion_gate(spark, d):
    p = st.probabilities(spark, d)
    gate = evaluate.promotion_gate(evaluate.eval_probability(p, "y", "p2"), evaluate.eval_probability(p, "y", "p1"),
                                   resample.paired_bootstrap_ci(p, "doc_id", "y", "p2", "p1"))
    return rounded(gate.select("candidate_loss", "baseline_loss", "provisional", "promoted"))


SAMPLES = 50_000
THIRD = 0.4


# --- resampled series: 50,000 replicates of every group; checked against brute force in the tests ----------

def _resampled(spark, d):
    # Sizes and points of the groups are read apart: the narrow rows are written once.
    scores = materialize(_scored(spark, d).select("group_id", "contest_id", "ts", "points"), run_dir(spark, "scores"))
    return resample.bootstrap_best_series(scores, SAMPLES, 7, F.lit(THIRD))


@query("q_bootstrap_best_series")
def bootstrap_best_series(spark, d):
    return rounded(_resampled(spark, d), 4)


def _outcomes(spark, d):
    base = (F.col("group_id") % 5 + 1) / 20.0
    ids = st.table(spark, d, "customer").select((F.floor(F.col("c_custkey") / 10)).alias("pool")).distinct().select(
        F.explode(F.array(F.col("pool") * 2, F.col("pool") * 2 + 1)).alias("group_id"))
    return ids.select("group_id", base.alias("undefeated"), (0.25 - base).alias("winless"), F.lit(0.1).alias("four_one"), F.lit(0.2).alias("one_four"),
                      F.lit(0.15).alias("elimination_winners"), F.lit(0.3).alias("elimination_losers"))


@query("q_mixture_projection")
def mixture_projection(spark, d):
    summary = _resampled(spark, d)
    return rounded(sc.mixture_projection(summary, projection.series_weights(_outcomes(spark, d)), ["mean", "p90"]), 8)


def _role_groups(spark, d):
    role = F.element_at(F.array(F.lit("Core"), F.lit("Mid"), F.lit("Support")), (F.col("group_id") % 3 + 1).cast("int"))
    return group_rows(spark, d, STATS).withColumn("role", role)


def _entities(spark, d):
    """Groups, and members with the team and role of their group, one row per contest."""
    shape = ["kind", "id", "team_id", "role", "contest_id", "ts", *STATS]
    both = _role_groups(spark, d).withColumns({"kind": F.lit("group"), "id": F.col("group_id"), "team_id": F.col("group_id")}).select(*shape)
    role = F.element_at(F.array(F.lit("Core"), F.lit("Mid"), F.lit("Support")), (F.col("group_id") % 3 + 1).cast("int"))
    single = member_rows(spark, d).join(groups(spark, d), "member_id").withColumns(
        {"kind": F.lit("member"), "id": F.col("member_id"), "team_id": F.col("group_id"), "role": role}).select(*shape)
    return both.unionByName(single)


ROLE_SQL = "['Core', 'Mid', 'Support'][group_id % 3 + 1] AS role"
COUNTED_SQL = " OR ".join(f"(role = '{r}' AND metric IN ({', '.join(repr(m) for m in ms)}))" for r, ms in rules.ROLE_METRICS.items())


@query("q_projection_entities", f"""WITH {MC}, {GROUPS}, e AS (
  SELECT 'group' AS kind, group_id AS id, group_id AS team_id, {ROLE_SQL}, {', '.join(STATS)} FROM gc
  UNION ALL SELECT 'member', member_id, group_id, {ROLE_SQL}, {', '.join(STATS)} FROM mc JOIN groups USING (member_id)),
s AS (""" + " UNION ALL ".join(f"SELECT kind, id, team_id, role, '{m}' AS metric, count(*) AS contests, avg({c}) AS raw, avg({points_sql(m)}) AS points FROM e GROUP BY ALL"
                               for m, c, _, _ in rules.STAT_RULES) + f"""),
c AS (SELECT *, ({COUNTED_SQL}) AS counted FROM s WHERE contests >= 3)
SELECT kind, id, team_id, role, metric, contests, counted, round(round(raw, 10), 6) AS raw, round(round(points, 7), 4) AS points,
  round(round(sum(CASE WHEN counted THEN points ELSE 0 END) OVER (PARTITION BY kind, id), 7), 4) AS per_contest FROM c""")
def projection_entities(spark, d):
    e = projection.projected_entities(_entities(spark, d)).select("kind", "id", "team_id", "role", "contests", "per_contest", F.explode("stats").alias("s"))
    return e.select("kind", "id", "team_id", "role", "contests", "s.metric", "s.counted", F.round(F.round("s.raw", 10), 6).alias("raw"),
                    *[F.round(F.round(c, 7), 4).alias(n) for n, c in (("points", "s.points"), ("per_contest", "per_contest"))])


@query("q_projection_report")
def projection_report(spark, d):
    third = sc.third_game_rate(st.contests(spark, d), SINCE).select("rate").scalar()
    return projection.projection_report(_entities(spark, d), _outcomes(spark, d), third, SAMPLES, seed=7)


@query("q_projection_stat_means", f"WITH {MC}, {GROUPS} " + " UNION ALL ".join(
    f"SELECT group_id, '{m}' AS metric, round(round(avg({c}), 10), 6) AS raw, round(round(avg({points_sql(m)}), 7), 4) AS points FROM gc GROUP BY 1" for m, c, _, _ in rules.STAT_RULES))
def projection_stat_means(spark, d):
    s = projection.stat_means(_role_groups(spark, d))
    return s.select("group_id", "metric", F.round(F.round("raw", 10), 6).alias("raw"), F.round(F.round("points", 7), 4).alias("points"))


# --- models: rows are checked against brute force in the tests ---------------------------------

@query("q_logistic_fit")
def logistic_fit(spark, d):
    model, _ = training.train_baseline(training.baseline_table(st.contests(spark, d)), CUTOFF)
    return rounded(model.coefficients(spark), 5)


@query("q_baseline_metrics")
def baseline_metrics(spark, d):
    return rounded(training.train_baseline(training.baseline_table(st.contests(spark, d)), CUTOFF)[1], 5)


def _lineup_report(spark, d):
    table = features.lineup_features(st.contests(spark, d), lineups.duels(st.members(spark, d), 2))
    return training.train_lineup_model(table, CUTOFF, samples=10_000)


@query("q_logistic_grid")
def logistic_grid(spark, d):
    return rounded(_lineup_report(spark, d)["losses"], 5)


@query("q_top_coefficients")
def top_coefficients(spark, d):
    return rounded(_lineup_report(spark, d)["coefficients"], 5)


def _boosted(spark, d):
    return training.train_boosted(features.contest_features(st.contests(spark, d)), CUTOFF, rounds=250)


@query("q_boosted_fit")
def boosted_fit(spark, d):
    return rounded(_boosted(spark, d)["metrics"], 5)


@query("q_platt_calibrate")
def platt_calibrate(spark, d):
    test = _boosted(spark, d)["test"]
    return rounded(test.select("contest_id", "raw", "p"), 6)
