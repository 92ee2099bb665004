from pyspark.sql import functions as F

from contestry.catalog.registry import query, rounded
from contestry.functions import rates
from contestry.operators import chronology as ch, lineups, ratings
from contestry.plans import features
from contestry.sources import sample_tables as st

SL = st.SQL_VALID + """,
sl AS (SELECT contest_id, ts, era, 0 AS side, a_id AS entity_id, b_id AS opponent_id, a_win AS won FROM valid
       UNION ALL SELECT contest_id, ts, era, 1, b_id, a_id, 1 - a_win FROM valid)"""
W = "PARTITION BY entity_id ORDER BY ts, contest_id"


def _valid(spark, d):
    return ch.valid_contests(st.contests(spark, d))


@query("q_side_long", f"WITH {SL} SELECT contest_id, ts, side, entity_id, opponent_id, won FROM sl")
def side_long(spark, d):
    return ch.side_long(_valid(spark, d))


@query("q_valid_contests", f"""WITH {st.SQL_CONTESTS}, {st.SQL_ALIASES}
SELECT contest_id, ts, a, b, a_win FROM (
  SELECT contest_id, ts, coalesce(x.canonical, a_id) AS a, coalesce(y.canonical, b_id) AS b, a_win
  FROM contests LEFT JOIN alias_of x ON x.id = a_id LEFT JOIN alias_of y ON y.id = b_id
  WHERE a_id > 0 AND b_id > 0 AND a_id <> b_id AND ts >= 788918400)
WHERE a <> b""")
def valid_contests(spark, d):
    from contestry.operators import project
    kept = ch.valid_contests(st.contests(spark, d), since=788918400)
    aliases = project.alias_map(st.alias_lists(spark, d))
    renamed = project.canonical_ids(kept, aliases, "a_id", "b_id")
    return ch.valid_contests(renamed).select("contest_id", "ts", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_win")


@query("q_games_before", f"WITH {SL} SELECT contest_id, side, row_number() OVER ({W}) - 1 AS games_before FROM sl")
def games_before(spark, d):
    return ch.entity_form(_valid(spark, d)).select("contest_id", "side", "games_before")


@query("q_recent_rate", f"""WITH {SL}, c AS (SELECT contest_id, side,
  coalesce(sum(won) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS w5,
  count(*) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n5,
  coalesce(sum(won) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS w10,
  count(*) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n10 FROM sl)
SELECT contest_id, side, round((w5 + 3.0) / (n5 + 6.0), 6) AS recent_5, round((w10 + 3.0) / (n10 + 6.0), 6) AS recent_10 FROM c""")
def recent_rate(spark, d):
    return rounded(ch.entity_form(_valid(spark, d)).select("contest_id", "side", "recent_5", "recent_10"))


@query("q_ema_form", f"""WITH {SL}, c AS (SELECT contest_id, side,
  list(CAST(won AS DOUBLE)) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM sl)
SELECT contest_id, side, round(list_reduce(list_prepend(CAST(0.5 AS DOUBLE), coalesce(h, [])), lambda acc, v: 0.15 * v + 0.85 * acc), 7) AS ema_form FROM c""")
def ema_form(spark, d):
    return rounded(ch.entity_form(_valid(spark, d)).select("contest_id", "side", "ema_form"), 7)


@query("q_signed_streak", f"""WITH {SL}, r AS (SELECT *, row_number() OVER ({W}) AS rn,
  row_number() OVER (PARTITION BY entity_id, won ORDER BY ts, contest_id) AS rw FROM sl),
i AS (SELECT *, row_number() OVER (PARTITION BY entity_id, won, rn - rw ORDER BY ts, contest_id) AS run FROM r),
s AS (SELECT contest_id, side, entity_id, ts, CASE WHEN won = 1 THEN run ELSE -run END AS after FROM i)
SELECT contest_id, side, coalesce(lag(after) OVER ({W}), 0) AS streak FROM s""")
def signed_streak(spark, d):
    return ch.entity_form(_valid(spark, d)).select("contest_id", "side", "streak")


@query("q_rest_days", f"""WITH {SL} SELECT contest_id, side,
  round(coalesce(least(30.0, (ts - lag(ts) OVER ({W})) / 86400.0), 30.0), 6) AS rest_days FROM sl""")
def rest_days(spark, d):
    return rounded(ch.entity_form(_valid(spark, d)).select("contest_id", "side", "rest_days"))


@query("q_activity_30d", f"""WITH {SL}, c AS (SELECT *,
  count(*) OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW) AS span,
  count(*) OVER (PARTITION BY entity_id, ts) AS same,
  row_number() OVER (PARTITION BY entity_id, ts ORDER BY contest_id) AS nth FROM sl)
SELECT contest_id, side, span - (same - nth + 1) AS activity FROM c""")
def activity_30d(spark, d):
    return ch.activity(_valid(spark, d)).select("contest_id", "side", "activity")


@query("q_era_rate", f"""WITH {SL}, c AS (SELECT contest_id, side,
  count(*) OVER (PARTITION BY entity_id, era ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
  coalesce(sum(won) OVER (PARTITION BY entity_id, era ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM sl)
SELECT contest_id, side, n AS era_games, round((w + 5.0) / (n + 10.0), 6) AS era_rate FROM c""")
def era_rate(spark, d):
    return rounded(ch.era_form(_valid(spark, d)).select(
        "contest_id", "side", F.col("era_games").cast("long").alias("era_games"), "era_rate"))


PAIR = "PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("q_head_to_head", f"""WITH {st.SQL_VALID}, c AS (SELECT contest_id, a_id, b_id, count(*) OVER ({PAIR}) AS n,
  coalesce(sum(CASE WHEN a_id < b_id THEN a_win ELSE 1 - a_win END) OVER ({PAIR}), 0) AS w FROM valid)
SELECT contest_id, n AS pair_games,
  round(CASE WHEN a_id < b_id THEN (w + 4.0) / (n + 8.0) ELSE 1 - (w + 4.0) / (n + 8.0) END - 0.5, 6) AS h2h_advantage FROM c""")
def head_to_head(spark, d):
    return rounded(ch.head_to_head(_valid(spark, d)).select(
        "contest_id", F.col("pair_games").cast("long").alias("pair_games"), "h2h_advantage"))


SERIES = "PARTITION BY series_id, least(a_id, b_id), greatest(a_id, b_id) ORDER BY ts, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("q_series_score", f"""WITH {st.SQL_VALID}, c AS (SELECT contest_id, a_id, b_id, count(*) OVER ({SERIES}) AS n,
  coalesce(sum(CASE WHEN a_id < b_id THEN a_win ELSE 1 - a_win END) OVER ({SERIES}), 0) AS w FROM valid WHERE series_id <> 0)
SELECT contest_id, CAST(CASE WHEN a_id < b_id THEN 2 * w - n ELSE n - 2 * w END AS BIGINT) AS series_difference, n AS series_played FROM c""")
def series_score(spark, d):
    return ch.series_score(_valid(spark, d))


@query("q_global_side_rate", f"""WITH {st.SQL_VALID}, c AS (SELECT contest_id,
  coalesce(sum(a_win) OVER (ORDER BY ts, contest_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING), 0) AS w,
  count(*) OVER (ORDER BY ts, contest_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS n FROM valid)
SELECT contest_id, round((w + 10.0) / (n + 20.0), 6) AS side_rate FROM c""")
def global_side_rate(spark, d):
    return rounded(ch.global_side_rate(_valid(spark, d)))


K = "CASE tier WHEN 'premium' THEN 36.0 WHEN 'professional' THEN 28.0 WHEN 'amateur' THEN 20.0 WHEN 'excluded' THEN 12.0 ELSE 24.0 END"
ELO_SQL = f"""WITH RECURSIVE {st.SQL_VALID},
n AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY ts, contest_id) AS nth, (a_id - 1) % 10 + 1 AS ai, (b_id - 1) % 10 + 1 AS bi,
  CAST({K} AS DOUBLE) AS k FROM valid),
run AS (
  SELECT DISTINCT pool, CAST(0 AS BIGINT) AS nth, list_transform(range(10), lambda x: CAST(1500 AS DOUBLE)) AS r,
    list_transform(range(10), lambda x: CAST(0 AS BIGINT)) AS g, CAST(0 AS BIGINT) AS contest_id,
    CAST(0 AS DOUBLE) AS a_rating, CAST(0 AS DOUBLE) AS b_rating, CAST(0 AS BIGINT) AS a_games, CAST(0 AS BIGINT) AS b_games,
    CAST(0 AS DOUBLE) AS a_expected, CAST(0 AS DOUBLE) AS a_after, CAST(0 AS DOUBLE) AS b_after FROM n
  UNION ALL
  SELECT pool, nth, list_transform(r, lambda x, i: CASE WHEN i = ai THEN x + da WHEN i = bi THEN x + db ELSE x END),
    list_transform(g, lambda x, i: CASE WHEN i = ai OR i = bi THEN x + 1 ELSE x END),
    contest_id, ra, rb, ga, gb, e, ra + da, rb + db
  FROM (SELECT *, k * (CASE WHEN ga < 20 THEN 1.25 ELSE 1.0 END) * (a_win - e) AS da,
          k * (CASE WHEN gb < 20 THEN 1.25 ELSE 1.0 END) * (e - a_win) AS db
        FROM (SELECT *, 1 / (1 + pow(10.0, (rb - ra) / 400.0)) AS e
              FROM (SELECT n.pool, n.nth, run.r, run.g, n.contest_id, n.ai, n.bi, n.k, n.a_win, run.r[n.ai] AS ra, run.r[n.bi] AS rb,
                      run.g[n.ai] AS ga, run.g[n.bi] AS gb FROM run JOIN n ON n.pool = run.pool AND n.nth = run.nth + 1)))
)"""


@query("q_elo_history", ELO_SQL + """ SELECT contest_id, round(a_rating, 6) AS a_rating, round(b_rating, 6) AS b_rating, a_games, b_games,
  round(a_expected, 6) AS a_expected, round(a_after, 6) AS a_after, round(b_after, 6) AS b_after FROM run WHERE nth > 0""")
def elo_history(spark, d):
    return rounded(ratings.elo_history(st.contests(spark, d)).select(
        "contest_id", "a_rating", "b_rating", "a_games", "b_games", "a_expected", "a_after", "b_after"))


@query("q_elo_expected", f"""WITH {st.SQL_VALID} SELECT contest_id,
  round(1 / (1 + pow(10.0, ((1500.0 + b_id % 400) - (1500.0 + a_id % 400)) / 400.0)), 6) AS expected FROM valid""")
def elo_expected(spark, d):
    rating = lambda c: F.lit(1500.0) + F.col(c) % 400
    return rounded(_valid(spark, d).select("contest_id", rates.elo_expected(rating("a_id"), rating("b_id")).alias("expected")))


def _elo_period_sql() -> str:
    ctes, parts = [], []
    previous = "s0"
    ctes.append("s0 AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(0 AS DOUBLE) AS rating, CAST(0 AS BIGINT) AS games WHERE false)")
    for era in range(1990, 2006):
        ctes.append(f"""m{era} AS (SELECT v.contest_id, v.a_id, v.b_id, v.a_win, CAST({K} AS DOUBLE) AS k,
  coalesce(x.rating, 1500.0) AS ra, coalesce(y.rating, 1500.0) AS rb, coalesce(x.games, 0) AS ga, coalesce(y.games, 0) AS gb
  FROM valid v LEFT JOIN {previous} x ON x.id = v.a_id LEFT JOIN {previous} y ON y.id = v.b_id WHERE era = {era})""")
        ctes.append(f"""e{era} AS (SELECT *, 1 / (1 + pow(10.0, (rb - ra) / 400.0)) AS e FROM m{era})""")
        ctes.append(f"""d{era} AS (SELECT id, sum(move) AS move, count(*) AS c FROM (
  SELECT a_id AS id, k * (CASE WHEN ga < 20 THEN 1.25 ELSE 1 END) * (a_win - e) AS move FROM e{era} UNION ALL
  SELECT b_id, k * (CASE WHEN gb < 20 THEN 1.25 ELSE 1 END) * (e - a_win) FROM e{era}) GROUP BY id)""")
        ctes.append(f"""s{era} AS (SELECT coalesce(s.id, d.id) AS id, coalesce(rating, 1500.0) + coalesce(move, 0) AS rating,
  coalesce(games, 0) + coalesce(c, 0) AS games FROM {previous} s FULL JOIN d{era} d ON d.id = s.id)""")
        parts.append(f"SELECT contest_id, round(ra, 6) AS a_rating, round(rb, 6) AS b_rating, round(e, 6) AS a_expected FROM e{era}")
        previous = f"s{era}"
    materialized = [c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]
    return f"WITH {st.SQL_VALID}, " + ",\n".join(materialized) + "\n" + " UNION ALL ".join(parts)


@query("q_elo_period", _elo_period_sql())
def elo_period(spark, d):
    return rounded(ratings.elo_period(st.contests(spark, d)).select("contest_id", "a_rating", "b_rating", "a_expected"))


@query("q_glicko_expected", f"""WITH {st.SQL_VALID} SELECT contest_id, round(1 / (1 + exp(-(1 / sqrt(1 + 3 * (da * da + db * db) / (pi() * pi())))
  * (a_id % 400 - b_id % 400) / 173.7178)), 6) AS expected
  FROM (SELECT *, (50 + a_id % 300) / 173.7178 AS da, (50 + b_id % 300) / 173.7178 AS db FROM valid)""")
def glicko_expected(spark, d):
    rating = lambda c: F.lit(1500.0) + F.col(c) % 400
    dev = lambda c: F.lit(50.0) + F.col(c) % 300
    return rounded(_valid(spark, d).select("contest_id", rates.glicko_expected(
        rating("a_id"), rating("b_id"), dev("a_id"), dev("b_id")).alias("expected")))


@query("q_glicko_inactivity", f"""WITH {SL}, g AS (SELECT contest_id, side, entity_id,
  greatest(0, CAST(FLOOR(ts / 86400) AS BIGINT) - CAST(FLOOR(lag(ts) OVER ({W}) / 86400) AS BIGINT) - 1) AS idle FROM sl)
SELECT contest_id, side, idle, round(CASE WHEN idle > 0 THEN least(350.0, sqrt(pow((50 + entity_id % 300) / 173.7178, 2) + idle * 0.06 * 0.06) * 173.7178)
  ELSE 50.0 + entity_id % 300 END, 6) AS deviation FROM (SELECT contest_id, side, entity_id, coalesce(idle, 0) AS idle FROM g)""")
def glicko_inactivity(spark, d):
    rows = ch.side_long(_valid(spark, d))
    numbered = lineups.previous_ts(rows)
    gap = F.floor(F.col("ts") / ch.DAY) - F.floor(F.col("prev_ts") / ch.DAY)
    idle = F.coalesce(rates.glicko_idle_periods(gap), F.lit(0)).cast("long")
    return rounded(numbered.select("contest_id", "side", idle.alias("idle"), rates.glicko_inactivity(
        F.lit(50.0) + F.col("entity_id") % 300, F.lit(0.06), idle).alias("deviation")))


@query("q_glicko_period")
def glicko_period(spark, d):
    return rounded(ratings.glicko_history(ratings.glicko_timeline(st.contests(spark, d))))


@query("q_glicko_features")
def glicko_features(spark, d):
    return rounded(ratings.glicko_features(ratings.glicko_timeline(st.contests(spark, d))))


def side_sets(size: int) -> str:
    return st.SQL_MEMBERS + f""",
sets AS (SELECT contest_id, ts, pool, side, any_value(entity_id) AS entity_id, any_value(won) AS won, list_sort(list(DISTINCT member_id)) AS keys
  FROM members GROUP BY contest_id, ts, pool, side HAVING count(DISTINCT member_id) = {size} AND any_value(entity_id) > 0),
duels AS (SELECT a.contest_id, a.ts, a.pool, a.entity_id AS a_id, b.entity_id AS b_id, a.won AS a_win, a.keys AS a_keys, b.keys AS b_keys
  FROM sets a JOIN sets b ON a.contest_id = b.contest_id AND a.side = 0 AND b.side = 1)"""


SIDE_SETS = side_sets(2)
MEMBER_SQL = f"""WITH RECURSIVE {SIDE_SETS},
n AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY ts, contest_id) AS nth,
  list_transform(a_keys, lambda x: (x - 1) % 10 + 1) AS ai, list_transform(b_keys, lambda x: (x - 1) % 10 + 1) AS bi FROM duels),
run AS (
  SELECT DISTINCT pool, CAST(0 AS BIGINT) AS nth, list_transform(range(10), lambda x: CAST(1500 AS DOUBLE)) AS r,
    list_transform(range(10), lambda x: CAST(0 AS BIGINT)) AS g, CAST(0 AS BIGINT) AS contest_id, CAST(0 AS DOUBLE) AS a_rating,
    CAST(0 AS DOUBLE) AS b_rating, CAST(0 AS DOUBLE) AS a_games, CAST(0 AS DOUBLE) AS b_games, CAST(0 AS DOUBLE) AS a_expected FROM n
  UNION ALL
  SELECT pool, nth, list_transform(r, lambda x, i: CASE WHEN list_contains(ai, i) THEN x + 24.0 * (a_win - e) WHEN list_contains(bi, i) THEN x - 24.0 * (a_win - e) ELSE x END),
    list_transform(g, lambda x, i: CASE WHEN list_contains(ai, i) OR list_contains(bi, i) THEN x + 1 ELSE x END), contest_id, ra, rb, ga, gb, e
  FROM (SELECT *, 1 / (1 + pow(10.0, (rb - ra) / 400.0)) AS e FROM (
    SELECT n.*, run.r, run.g, (run.r[n.ai[1]] + run.r[n.ai[2]]) / 2 AS ra, (run.r[n.bi[1]] + run.r[n.bi[2]]) / 2 AS rb,
      (run.g[n.ai[1]] + run.g[n.ai[2]]) / 2.0 AS ga, (run.g[n.bi[1]] + run.g[n.bi[2]]) / 2.0 AS gb
    FROM run JOIN n ON n.pool = run.pool AND n.nth = run.nth + 1))
)"""


@query("q_member_rating_history", MEMBER_SQL + """ SELECT contest_id, round(a_rating, 6) AS a_rating, round(b_rating, 6) AS b_rating,
  round(a_games, 6) AS a_games, round(b_games, 6) AS b_games, round(a_expected, 6) AS a_expected FROM run WHERE nth > 0""")
def member_rating_history(spark, d):
    folded = ratings.member_ratings(lineups.duels(st.members(spark, d), 2))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v) / F.size(c)
    return rounded(folded.select("contest_id", "a_rating", "b_rating", mean("a_games").alias("a_games"),
                                 mean("b_games").alias("b_games"), "a_expected"))


def each_sql(size: int) -> str:
    return side_sets(size) + """,
each AS (SELECT contest_id, ts, 0 AS side, a_id AS entity_id, a_keys AS keys FROM duels UNION ALL
         SELECT contest_id, ts, 1, b_id, b_keys FROM duels),
seats AS (SELECT contest_id, ts, side, unnest(keys) AS member_id FROM each)"""


EACH = each_sql(2)


@query("q_new_members", f"""WITH {EACH}, g AS (SELECT contest_id, side, row_number() OVER (PARTITION BY member_id ORDER BY ts, contest_id) - 1 AS games FROM seats)
SELECT contest_id, side, round(avg(games), 6) AS mean_games, CAST(sum(CASE WHEN games < 5 THEN 1 ELSE 0 END) AS BIGINT) AS new_members FROM g GROUP BY 1, 2""")
def new_members(spark, d):
    return rounded(lineups.member_experience(lineups.sides(lineups.duels(st.members(spark, d), 2))))


@query("q_lineup_experience", f"""WITH {EACH} SELECT contest_id, side,
  row_number() OVER (PARTITION BY keys ORDER BY ts, contest_id, side) - 1 AS lineup_games FROM each""")
def lineup_experience(spark, d):
    return lineups.lineup_experience(lineups.sides(lineups.duels(st.members(spark, d), 2)))


@query("q_pair_experience", f"""WITH {EACH} SELECT contest_id, side,
  CAST(row_number() OVER (PARTITION BY keys[1], keys[2] ORDER BY ts, contest_id, side) - 1 AS DOUBLE) AS pair_games FROM each""")
def pair_experience(spark, d):
    return rounded(lineups.pair_experience(lineups.sides(lineups.duels(st.members(spark, d), 2))))


@query("q_retained_members", f"""WITH {EACH} SELECT contest_id, side, CASE WHEN prev IS NULL THEN 0 ELSE len(list_intersect(keys, prev)) END AS retained
FROM (SELECT contest_id, side, keys, last(keys ORDER BY ts, contest_id, side) OVER (PARTITION BY entity_id ORDER BY ts, contest_id
  GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM each)""")
def retained_members(spark, d):
    return lineups.retained_members(lineups.sides(lineups.duels(st.members(spark, d), 2)))


@query("q_contest_features")
def contest_features(spark, d):
    return rounded(features.contest_features(st.contests(spark, d)))


@query("q_lineup_features")
def lineup_features(spark, d):
    return rounded(features.lineup_features(st.contests(spark, d), lineups.duels(st.members(spark, d), 2)))
