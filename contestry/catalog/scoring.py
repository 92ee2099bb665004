from pyspark.sql import functions as F

from contestry.catalog.registry import query, rounded
from contestry.functions import rates, rules
from contestry.operators import hot, project, scoring as sc
from contestry.sources import sample_tables as st

SINCE = 788918400
STATS = [*project.STAT_COLUMNS, "creeps"]
MC = st.SQL_MEMBERS + """,
mc0 AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY contest_id, member_id ORDER BY slot DESC) = 1),
mc AS (SELECT contest_id, member_id, ts, series_id, duration, pool, lane_role, """ + ", ".join(
    f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in project.STAT_COLUMNS) + """,
  CAST(last_hits + coalesce(denies, 0) AS DOUBLE) AS creeps FROM mc0)"""
PROFILE = MC + """,
prof0 AS (SELECT member_id, count(*) AS contests, """ + ", ".join(f"avg({c}) AS {c}" for c in STATS) + f""",
  count(*) FILTER (WHERE lane_role = 1) AS safe_contests, count(*) FILTER (WHERE lane_role = 2) AS mid_contests,
  count(*) FILTER (WHERE lane_role = 3) AS off_contests, max(ts) AS last_ts, max(pool) AS pool FROM mc WHERE ts >= {SINCE} GROUP BY member_id HAVING count(*) >= 3),
prof1 AS (SELECT *, CASE WHEN member_id % 7 = 0 THEN 1 WHEN member_id % 7 = 1 THEN 2 END AS code,
  CASE WHEN member_id % 11 < 5 THEN member_id % 11 + 1 END AS registered FROM prof0),
prof AS (SELECT *, CASE WHEN role = 'Mid' THEN 2 WHEN role = 'Core' AND safe_contests >= off_contests THEN 1 WHEN role = 'Core' THEN 3
    WHEN off_contests > safe_contests THEN 4 ELSE 5 END AS derived FROM (
  SELECT *, CASE WHEN registered = 2 THEN 'Mid' WHEN registered IN (1, 3) THEN 'Core' WHEN registered IS NOT NULL THEN 'Support'
    WHEN code = 1 THEN 'Core' WHEN code = 2 THEN 'Support'
    WHEN mid_contests / greatest(safe_contests + mid_contests + off_contests, 1) >= 0.55 AND gold_per_min >= 450 THEN 'Mid'
    WHEN wards >= 5 OR (gold_per_min < 430 AND last_hits < 160) THEN 'Support' ELSE 'Core' END AS role FROM prof1))"""


def points_sql(metric: str) -> str:
    column, base, slope = {m: (c, b, s) for m, c, b, s in rules.STAT_RULES}[metric]
    value = f"least(1, greatest(0, {column}))" if metric in rules.CLIPPED else column
    return f"({base}e0 + {slope}e0 * {value})"


def long_sql(source: str, *keep: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {', '.join(keep)}, '{m}' AS metric, {c} AS value, {points_sql(m)} AS points FROM {source}" for m, c, _, _ in rules.STAT_RULES)


def preferred_sql() -> str:
    rows = [f"('{r}', '{s}', {i + 1}, '{m}')" for r in rules.PATTERNS for s in rules.STAGES for i, m in enumerate(rules.preferred_metrics(r, s))]
    return "preferred AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(role, stage, place, metric))"


def member_rows(spark, d):
    return sc.member_contests(st.members(spark, d))


def profile(spark, d):
    p = sc.member_profile(member_rows(spark, d), SINCE)
    code = F.when(F.col("member_id") % 7 == 0, 1).when(F.col("member_id") % 7 == 1, 2)
    registered = F.when(F.col("member_id") % 11 < 5, F.col("member_id") % 11 + 1)
    return sc.with_roles(p, code, registered)


@query("q_stat_defaults", f"""WITH {st.SQL_MEMBERS} SELECT contest_id, slot, CAST(coalesce(denies, 0) + last_hits AS DOUBLE) AS creeps,
  CAST(coalesce(watchers, 0) AS DOUBLE) AS watchers, CAST(kills AS DOUBLE) AS kills, round(stuns, 6) AS stuns FROM members""")
def stat_defaults(spark, d):
    return rounded(project.stat_defaults(st.members(spark, d), "contest_id", "slot").select(
        "contest_id", "slot", "creeps", "watchers", "kills", "stuns"))


@query("q_stat_points", f"WITH {MC} SELECT contest_id, member_id, metric, round(value, 6) AS value, round(points, 6) AS points FROM ({long_sql('mc', 'contest_id', 'member_id')})")
def stat_points(spark, d):
    return rounded(sc.stat_points(sc.unpivot_stats(member_rows(spark, d), ["contest_id", "member_id"])))


@query("q_infer_role", f"""WITH {PROFILE} SELECT member_id, role, 'Position ' || coalesce(registered, derived) AS position FROM prof""")
def infer_role(spark, d):
    return profile(spark, d).select("member_id", "role", "position")


@query("q_position_label", f"""WITH {PROFILE} SELECT role, 'Position ' || coalesce(registered, derived) AS position, count(*) AS members FROM prof GROUP BY 1, 2""")
def position_label(spark, d):
    return profile(spark, d).groupBy("role", "position").agg(F.count("*").alias("members"))


@query("q_member_profile", f"""WITH {PROFILE} SELECT member_id, contests, safe_contests, mid_contests, off_contests, last_ts, """
       + ", ".join(f"round({c}, 6) AS {c}" for c in STATS) + " FROM prof0")
def member_profile(spark, d):
    p = sc.member_profile(member_rows(spark, d), SINCE)
    return rounded(p.select("member_id", "contests", "safe_contests", "mid_contests", "off_contests", "last_ts", *STATS))


RAW = " + ".join(f"{c} * {w}e0" for c, w in rules.SIGNAL_WEIGHTS.items())


@query("q_signal_index", f"""WITH {PROFILE}, r AS (SELECT member_id, contests, {RAW} AS raw FROM prof0), b AS (SELECT min(raw) AS lo, max(raw) AS hi FROM r)
SELECT member_id, contests, round(40 + 60 * (raw - lo) / greatest(hi - lo, 1e-9), 1) AS signal FROM r, b""")
def signal_index(spark, d):
    return sc.signal_index(sc.member_profile(member_rows(spark, d), SINCE)).select("member_id", "contests", "signal")


@query("q_preferred_metrics", f"""WITH {PROFILE}, {preferred_sql()} SELECT role, stage, place, metric, count(*) AS members FROM prof JOIN preferred USING (role) GROUP BY ALL""")
def preferred_metrics(spark, d):
    roles = profile(spark, d).groupBy("role").agg(F.count("*").alias("members"))
    return rules.preferred_table(spark).join(roles, "role").select("role", "stage", "place", "metric", "members")


@query("q_weighted_points", f"""WITH {PROFILE}, {preferred_sql()}, long AS ({long_sql('prof', 'member_id', 'role')})
SELECT member_id, role, round(round(sum(points * (100 + 25 * place) / 100.0), 9), 6) AS per_game, round(round(2 * sum(points * (100 + 25 * place) / 100.0), 9), 6) AS best_series
FROM long JOIN preferred USING (role, metric) WHERE stage = 'final' GROUP BY 1, 2""")
def weighted_points(spark, d):
    long = sc.stat_points(sc.unpivot_stats(profile(spark, d), ["member_id", "role"]))
    weights = rules.preferred_table(spark).where("stage = 'final'").select(
        "role", "metric", (100 + 25 * F.col("place")).cast("double").alias("multiplier"))
    return rounded(rounded(sc.weighted_points(long, weights, ["member_id", "role"]), 9), 6)


FLAT = "CASE role " + " ".join(
    f"WHEN '{r}' THEN " + " + ".join(points_sql(m) for m in rules.preferred_metrics(r, "group")) for r in rules.PATTERNS) + " END"


@query("q_flat_points", f"WITH {PROFILE} SELECT member_id, role, round({FLAT}, 6) AS per_game FROM prof")
def flat_points(spark, d):
    return rounded(sc.flat_points(profile(spark, d), "group").select("member_id", "role", "per_game"))


TITLES = "['the Tormented', 'the Patient', 'the Underdog', 'the Decisive', 'the Clutch', 'the Lucky', 'the Cruel', 'the Other']"
ACTIVE = "CASE lower(suffix) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.SUFFIX_ACTIVATION.items()) + " ELSE 0.08 END"


@query("q_expected_factor", f"""WITH {PROFILE}, t AS (SELECT member_id, 'p' || (member_id % 8) AS prefix, 6 + member_id % 5 AS prefix_bonus,
  CASE WHEN member_id % 9 = 0 THEN NULL ELSE {TITLES}[member_id % 8 + 1] END AS suffix, 9 + member_id % 16 AS suffix_bonus FROM prof0),
pr AS (SELECT member_id, 'p' || (member_id % 8) AS prefix, 100.0 * mid_contests / contests AS prefix_rate FROM prof0)
SELECT member_id, round(coalesce(prefix_rate, 0), 9) AS prefix_rate,
  round(1 + coalesce(prefix_bonus / 100.0 * prefix_rate / 100.0, 0) + CASE WHEN suffix IS NULL THEN 0 ELSE suffix_bonus / 100.0 * {ACTIVE} END, 9) AS factor
FROM t LEFT JOIN pr USING (member_id, prefix)""")
def expected_factor(spark, d):
    p = sc.member_profile(member_rows(spark, d), SINCE)
    prefix = F.concat(F.lit("p"), (F.col("member_id") % 8).cast("string"))
    names = F.array(*[F.lit(v.strip(" '[]")) for v in TITLES.split(",")])
    titled = p.select("member_id", prefix.alias("prefix"), (6 + F.col("member_id") % 5).alias("prefix_bonus"),
                      F.when(F.col("member_id") % 9 != 0, F.element_at(names, (F.col("member_id") % 8 + 1).cast("int"))).alias("suffix"),
                      (9 + F.col("member_id") % 16).alias("suffix_bonus"))
    prefix_rates = p.select(
        "member_id", prefix.alias("prefix"), (100.0 * F.col("mid_contests") / F.col("contests")).alias("prefix_rate"))
    return rounded(sc.expected_factor(titled, prefix_rates).select("member_id", "prefix_rate", "factor"), 9)


METRICS = [m for m, _, _, _ in rules.STAT_RULES]
EMBLEM = f"""em AS (SELECT contest_id, slot AS raw_slot, ['Core', 'Mid', 'Support'][lane_role] AS role, ['Red', 'Green', 'Blue'][kills % 3 + 1] AS color,
  {METRICS}[item_id % 18 + 1] AS metric, CAST(ordinal AS BIGINT) AS slot, 100 + gold_per_min % 200 AS multiplier,
  CASE WHEN kills % 4 = 0 THEN NULL ELSE 1 + kills % 5 END AS tier,
  CASE WHEN deaths % 6 = 0 THEN NULL ELSE ['Fractal', 'Friendly', 'Vampiric', 'Unique', 'Benevolent'][deaths % 6] END AS trait,
  CASE WHEN assists % 3 = 0 THEN NULL ELSE (assists - 10) * 5 END AS trait_bonus
  FROM (SELECT *, CASE WHEN side = 0 THEN slot + 1 ELSE slot - 123 END AS ordinal FROM members))"""
FIT = "CASE " + " ".join(
    f"WHEN role = '{r}' AND color = '{c}' AND metric = '{m}' THEN 1e0 - {i}e0 / 6e0 * 0.72e0" for r, by in rules.PRIORITIES.items()
    for c, ms in by.items() for i, m in enumerate(ms)) + " ELSE 0.2e0 END"


def _emblems(spark, d):
    m = st.members(spark, d)
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    return m.select(
        "contest_id", F.col("slot").alias("raw_slot"), pick(["Core", "Mid", "Support"], F.col("lane_role")).alias("role"),
        pick(["Red", "Green", "Blue"], F.col("kills") % 3 + 1).alias("color"), pick(METRICS, F.col("item_id") % 18 + 1).alias("metric"),
        F.when(F.col("side") == 0, F.col("slot") + 1).otherwise(F.col("slot") - 123).alias("slot"),
        (100 + F.col("gold_per_min") % 200).alias("multiplier"), F.when(F.col("kills") % 4 != 0, 1 + F.col("kills") % 5).alias("tier"),
        F.when(F.col("deaths") % 6 != 0, pick(["Fractal", "Friendly", "Vampiric", "Unique", "Benevolent"], F.col("deaths") % 6)).alias("trait"),
        F.when(F.col("assists") % 3 != 0, (F.col("assists") - 10) * 5).alias("trait_bonus"))


@query("q_advice_cascade", f"""WITH {st.SQL_MEMBERS}, {EMBLEM},
f AS (SELECT *, {FIT} AS fit, least(1, greatest(0, (multiplier - 100) / 200.0e0)) AS quality,
  CASE WHEN trait IS NULL THEN 0.45e0 WHEN trait_bonus >= 40 THEN 0.92e0 WHEN trait_bonus > 0 THEN 0.74e0 WHEN trait_bonus < 0 THEN 0.12e0
   WHEN trait = 'Friendly' AND trait_bonus = 0 THEN 0.34e0 WHEN trait = 'Friendly' AND role = 'Core' THEN 0.46e0 WHEN trait = 'Friendly' THEN 0.82e0
   WHEN trait = 'Vampiric' AND slot IN (1, 5) THEN 0.9e0 WHEN trait = 'Vampiric' THEN 0.58e0 WHEN trait = 'Benevolent' AND slot = 3 THEN 0.86e0
   WHEN trait = 'Benevolent' THEN 0.5e0 WHEN trait = 'Unique' THEN 0.42e0 ELSE 0.3e0 END AS tf FROM em),
a AS (SELECT *, CASE WHEN fit < 0.55e0 THEN 'REROLL STAT' WHEN (tier IS NULL AND quality < 0.25e0) OR tier <= 2 THEN 'RAISE QUALITY'
  WHEN tf < 0.48e0 THEN 'REROLL TRAIT' ELSE 'KEEP' END AS action FROM f)
SELECT contest_id, raw_slot, role, slot, action, CAST(CASE action WHEN 'REROLL STAT' THEN 90 + floor((0.55e0 - fit) * 10 + 0.5e0) WHEN 'RAISE QUALITY' THEN 65
   WHEN 'REROLL TRAIT' THEN 42 ELSE 10 END AS BIGINT) AS priority,
  round(CASE action WHEN 'REROLL STAT' THEN floor((0.86e0 - fit) * greatest(30, multiplier - 100) * 10 + 0.5e0) / 10
   WHEN 'RAISE QUALITY' THEN floor((CASE WHEN tier IS NOT NULL THEN greatest(0, 60 - [10, 30, 60, 100, 150][tier]) ELSE greatest(0, 180 - multiplier) END) * fit * 10 + 0.5e0) / 10
   WHEN 'REROLL TRAIT' THEN floor((0.72e0 - tf) * greatest(20, multiplier - 100) * 10 + 0.5e0) / 10 ELSE 0 END, 6) AS expected_uplift,
  row_number() OVER (PARTITION BY contest_id ORDER BY priority DESC, expected_uplift DESC, raw_slot) AS rank FROM a""")
def advice_cascade(spark, d):
    advised = rounded(sc.advice(_emblems(spark, d), 5).select(
        "contest_id", "raw_slot", "role", "slot", "action", "priority", "expected_uplift"))
    return sc.ranked_advice(advised, ["contest_id"], "raw_slot")


@query("q_pool_percentile", f"""WITH {PROFILE}, v AS (SELECT member_id, role, CASE WHEN member_id % 13 <> 0 THEN gold_per_min END AS gpm,
   coalesce(CASE WHEN member_id % 13 <> 0 THEN gold_per_min END, 0) AS g0, deaths FROM prof),
c AS (SELECT *, cume_dist() OVER (PARTITION BY role ORDER BY g0) * count(*) OVER (PARTITION BY role) AS le,
   cume_dist() OVER (PARTITION BY role ORDER BY deaths) * count(*) OVER (PARTITION BY role) AS dle, count(*) OVER (PARTITION BY role) AS n FROM v)
SELECT member_id, role, round(CASE WHEN n < 2 OR gpm IS NULL THEN 0.5 ELSE (le - 1) / (n - 1) END, 6) AS gpm_percentile,
  round(CASE WHEN n < 2 THEN 0.5 ELSE 1 - (dle - 1) / (n - 1) END, 6) AS deaths_percentile FROM c""")
def pool_percentile(spark, d):
    v = profile(spark, d).select("member_id", "role", F.when(F.col("member_id") % 13 != 0, F.col("gold_per_min")).alias("gpm"), "deaths")
    a = sc.pool_percentile(v, ["role"], "gpm").withColumnRenamed("percentile", "gpm_percentile")
    b = sc.pool_percentile(a, ["role"], "deaths", lower_is_better=True)
    return rounded(b.select("member_id", "role", "gpm_percentile", F.col("percentile").alias("deaths_percentile")))


LONG = f"long AS ({long_sql('prof', 'member_id', 'role')})"


@query("q_pool_minmax", f"""WITH {PROFILE}, {LONG}, s AS (SELECT role, metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1, 2)
SELECT member_id, role, metric, round(CASE WHEN lo = hi THEN 0.5 ELSE (value - lo) / (hi - lo) END, 6) AS scaled FROM long JOIN s USING (role, metric)""")
def pool_minmax(spark, d):
    long = sc.unpivot_stats(profile(spark, d), ["member_id", "role"])
    return rounded(sc.pool_minmax(long, ["role", "metric"], "value").select("member_id", "role", "metric", "scaled"))


@query("q_blend_fit", f"""WITH {PROFILE}, {preferred_sql()}, {LONG.replace('AS value', 'AS value_')}, lr AS (SELECT member_id, role, metric, round(value_, 9) AS value FROM long), s AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi,
  cume_dist() OVER (PARTITION BY role, metric ORDER BY value) * count(*) OVER w AS le, count(*) OVER w AS n FROM lr WINDOW w AS (PARTITION BY role, metric)),
f AS (SELECT member_id, role, metric, CASE WHEN lo = hi THEN 0.5 ELSE (value - lo) / (hi - lo) END AS scaled,
  CASE WHEN n < 2 THEN 0.5 WHEN metric = 'Deaths' THEN 1 - (le - 1) / (n - 1) ELSE (le - 1) / (n - 1) END AS pct FROM s)
SELECT member_id, role, CAST(floor(round(avg(0.7 * scaled + 0.3 * pct) * 100, 6) + 0.5) AS BIGINT) AS fit
FROM f JOIN preferred USING (role, metric) WHERE stage = 'final' GROUP BY 1, 2""")
def blend_fit(spark, d):
    long = rounded(sc.unpivot_stats(profile(spark, d), ["member_id", "role"]), 9).join(
        F.broadcast(rules.preferred_table(spark).where("stage = 'final'").select("role", "metric")), ["role", "metric"])
    scaled = sc.pool_minmax(long, ["role", "metric"], "value")
    ranked = sc.pool_percentile(scaled, ["role", "metric"], "value").withColumn(
        "percentile", F.when(F.col("metric") == "Deaths", 1 - F.col("percentile")).otherwise(F.col("percentile")))
    return sc.blend_fit(ranked, ["member_id", "role"])


@query("q_role_leaders", f"""WITH {PROFILE}, s AS (SELECT member_id, role, round({FLAT} * 2, 6) AS projected FROM prof)
SELECT member_id, role, projected, row_number() OVER (PARTITION BY role ORDER BY projected DESC, member_id) AS rank FROM s QUALIFY rank <= 10""")
def role_leaders(spark, d):
    p = sc.flat_points(profile(spark, d), "group")
    scored = p.select("member_id", "role", F.round(F.col("per_game") * 2, 6).alias("projected"))
    return sc.role_leaders(scored, "projected", "member_id", 10)


@query("q_per_group_top_n", f"""WITH {PROFILE} SELECT pool, member_id, contests, row_number() OVER (PARTITION BY pool ORDER BY contests DESC, member_id) AS rank
FROM prof0 QUALIFY rank <= 3""")
def per_group_top_n(spark, d):
    p = sc.member_profile(member_rows(spark, d), SINCE).select("pool", "member_id", "contests")
    return sc.per_group_top_n(p, ["pool"], [F.desc("contests"), F.asc("member_id")], 3)


@query("q_metric_board", f"""WITH {PROFILE}, {LONG} SELECT role, metric, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS upper,
  arg_max(member_id, (value, -member_id)) AS leader, round(max(value), 6) AS peak FROM long GROUP BY role, metric""")
def metric_board(spark, d):
    return rounded(sc.metric_board(sc.unpivot_stats(profile(spark, d), ["member_id", "role"]), "member_id"))


@query("q_quantile_summary", f"""WITH {MC} SELECT pool, round(avg(stuns), 9) AS mean, round(quantile_cont(stuns, 0.1), 9) AS p10, round(quantile_cont(stuns, 0.5), 9) AS p50,
  round(quantile_cont(stuns, 0.9), 9) AS p90, round(quantile_cont(stuns, 0.95), 9) AS p95 FROM mc GROUP BY pool""")
def quantile_summary(spark, d):
    # the members are made once: their mean comes from the counts of equal values
    return rounded(hot.exact_quantiles(member_rows(spark, d), ["pool"], "stuns", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95}, "mean"), 9)


GROUPS = """pools AS (SELECT DISTINCT CAST(FLOOR(c_custkey / 10) AS BIGINT) AS pool FROM customer),
groups AS (SELECT pool * 2 + side AS group_id, pool * 10 + side * 5 + seat AS member_id FROM pools, (VALUES (0), (1)) s(side), (VALUES (1), (2)) t(seat)),
gc0 AS (SELECT group_id, contest_id, count(*) AS n, max(ts) AS ts, max(series_id) AS series_id, max(duration) AS duration, """ + ", ".join(
    f"avg({c}) AS {c}" for c in STATS) + """ FROM mc JOIN groups USING (member_id) GROUP BY 1, 2),
gc AS (SELECT * FROM gc0 WHERE n = 2)"""


def groups(spark, d):
    pools = st.table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 10).alias("pool")).distinct()
    seats = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("seat")) for s in (0, 1) for n in (1, 2)])
    return pools.select("pool", F.explode(seats).alias("v")).select(
        (F.col("pool") * 2 + F.col("v.side")).alias("group_id"), (F.col("pool") * 10 + F.col("v.side") * 5 + F.col("v.seat")).alias("member_id"))


def group_rows(spark, d, values=("kills", "deaths", "creeps", "gold_per_min", "teamfight")):
    return sc.group_contests(member_rows(spark, d), groups(spark, d), list(values))


POINTS = f"({points_sql('Creeps')} + {points_sql('GPM')} + {points_sql('Teamfight')})"


def _scored(spark, d):
    points = rules.points_of("Creeps") + rules.points_of("GPM") + rules.points_of("Teamfight")
    return group_rows(spark, d, ("creeps", "gold_per_min", "teamfight")).withColumn("points", points)


@query("q_relational_division", f"""WITH {MC}, {GROUPS} SELECT group_id, contest_id, round(kills, 6) AS kills, round(deaths, 6) AS deaths, round(creeps, 6) AS creeps FROM gc""")
def relational_division(spark, d):
    return rounded(group_rows(spark, d, ("kills", "deaths", "creeps")).select("group_id", "contest_id", "kills", "deaths", "creeps"))


@query("q_conditional_bonus", f"""WITH {MC}, {GROUPS} SELECT group_id, contest_id, round({POINTS}, 6) AS points,
  round({POINTS} * CASE WHEN coalesce(duration, 0) % 10 = 8 THEN 1.21 ELSE 1 END, 6) AS bonus_points FROM gc""")
def conditional_bonus(spark, d):
    s = sc.conditional_bonus(_scored(spark, d), F.coalesce("duration", F.lit(0)) % 10 == 8)
    return rounded(s.select("group_id", "contest_id", "points", "bonus_points"))


@query("q_best_series", f"""WITH {MC}, {GROUPS}, s AS (SELECT group_id, contest_id, series_id, {POINTS} * CASE WHEN coalesce(duration, 0) % 10 = 8 THEN 1.21 ELSE 1 END AS bp
   FROM gc WHERE series_id IS NOT NULL),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY bp DESC, contest_id) <= 2),
u AS (SELECT group_id, series_id, round(sum(bp), 6) AS total FROM t GROUP BY 1, 2)
SELECT group_id, arg_max(series_id, (total, -series_id)) AS best_series_id, max(total) AS best_points, count(*) AS series_scored FROM u GROUP BY group_id""")
def best_series(spark, d):
    return rounded(sc.best_series(sc.conditional_bonus(_scored(spark, d), F.coalesce("duration", F.lit(0)) % 10 == 8)))


@query("q_running_best", f"""WITH {MC}, {GROUPS}, s AS (SELECT group_id, contest_id, series_id, ts, {POINTS} AS p FROM gc WHERE series_id IS NOT NULL),
t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY group_id, series_id ORDER BY p DESC, contest_id) <= 2),
u AS (SELECT group_id, series_id, sum(p) AS score, min(ts) AS ts FROM t GROUP BY 1, 2)
SELECT group_id, series_id, round(max(score) OVER (PARTITION BY group_id ORDER BY ts, series_id ROWS UNBOUNDED PRECEDING), 6) AS best_so_far FROM u""")
def running_best(spark, d):
    return rounded(sc.running_best(sc.series_scores(_scored(spark, d))).select("group_id", "series_id", "best_so_far"))


@query("q_third_game_rate", f"""WITH {st.SQL_CONTESTS}, s AS (SELECT series_id, count(*) AS n FROM contests
  WHERE series_type = 1 AND series_id <> 0 AND ts >= {SINCE} GROUP BY 1 HAVING count(*) IN (2, 3))
SELECT round(coalesce(sum(CASE WHEN n = 3 THEN 1.0 ELSE 0 END) / nullif(count(*), 0), 0.4), 6) AS rate, count(*) AS sample FROM s""")
def third_game_rate(spark, d):
    return rounded(sc.third_game_rate(st.contests(spark, d), SINCE))


ENTITY_SCORES = f"""scores AS (SELECT ['Core', 'Mid', 'Support'][group_id % 3 + 1] AS role, group_id AS entity, round(avg({POINTS}), 6) AS score FROM gc GROUP BY group_id)"""


def _entity_scores(spark, d):
    role = F.element_at(F.array(F.lit("Core"), F.lit("Mid"), F.lit("Support")), (F.col("group_id") % 3 + 1).cast("int"))
    return _scored(spark, d).groupBy("group_id").agg(F.avg("points").alias("score")).select(
        role.alias("role"), F.col("group_id").alias("entity"), F.round("score", 6).alias("score"))


@query("q_combo_top_n", f"""WITH {MC}, {GROUPS}, {ENTITY_SCORES}, b AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY role ORDER BY score DESC, entity) <= 10)
SELECT c.entity AS core, m.entity AS mid, s.entity AS support, round(c.score + m.score + s.score, 6) AS expected,
  row_number() OVER (ORDER BY round(c.score + m.score + s.score, 6) DESC, c.entity, m.entity, s.entity) AS rank
FROM b c, b m, b s WHERE c.role = 'Core' AND m.role = 'Mid' AND s.role = 'Support' QUALIFY rank <= 10""")
def combo_top_n(spark, d):
    return sc.combo_top_n(_entity_scores(spark, d), 10)


ANY_ROLE = f"""scores AS (SELECT role, pool AS entity, round(avg({FLAT}), 6) AS score FROM prof GROUP BY 1, 2)"""


@query("q_combo_constrained", f"""WITH {PROFILE}, {ANY_ROLE}
SELECT c.entity AS core, m.entity AS mid, s.entity AS support, round(c.score + m.score + s.score, 6) AS expected,
  round(round(c.score + m.score + s.score, 6) - 20000, 6) AS improvement
FROM scores c, scores m, scores s WHERE c.role = 'Core' AND m.role = 'Mid' AND s.role = 'Support' AND c.entity <> m.entity AND c.entity <> s.entity AND m.entity <> s.entity
  AND NOT (c.entity = 1 AND m.entity = 2 AND s.entity = 3) ORDER BY expected DESC, core, mid, support LIMIT 1""")
def combo_constrained(spark, d):
    scores = sc.flat_points(profile(spark, d), "group").groupBy("role", F.col("pool").alias("entity")).agg(
        F.round(F.avg("per_game"), 6).alias("score"))
    return sc.combo_constrained(scores, (1, 2, 3), 20000.0)


@query("q_series_probability", f"""WITH {st.SQL_VALID}, p AS (SELECT contest_id, (1 + contest_id % 99) / 100.0 AS p FROM valid)
SELECT contest_id, round(p, 6) AS bo1, round(p * p, 6) AS bo2, round(p * p * (3 - 2 * p), 6) AS bo3, round(4 * p * p * p * (1 - p) + p * p * p * p, 6) AS bo4,
  round(p * p * p * (10 - 15 * p + 6 * p * p), 6) AS bo5 FROM p""")
def series_probability(spark, d):
    from contestry.operators.chronology import valid_contests
    p = (1 + F.col("contest_id") % 99) / 100.0
    return rounded(valid_contests(st.contests(spark, d)).select(
        "contest_id", *[rates.series_probability(p, n).alias(f"bo{n}") for n in range(1, 6)]))


@query("q_remaining_series_probability", f"""WITH {st.SQL_VALID}, p AS (SELECT contest_id, (1 + contest_id % 99) / 100.0 AS p, contest_id % 3 AS wa, a_id % 3 AS wb FROM valid)
SELECT contest_id, round(CASE WHEN wa = 2 THEN 1 WHEN wb = 2 THEN 0 WHEN wa = 1 AND wb = 1 THEN p WHEN wa = 1 THEN 1 - (1 - p) * (1 - p) WHEN wb = 1 THEN p * p
  ELSE p * p * (3 - 2 * p) END, 6) AS chance FROM p""")
def remaining_series_probability(spark, d):
    from contestry.operators.chronology import valid_contests
    p = (1 + F.col("contest_id") % 99) / 100.0
    return rounded(valid_contests(st.contests(spark, d)).select(
        "contest_id", rates.remaining_series_probability(p, F.col("contest_id") % 3, F.col("a_id") % 3).alias("chance")))
