"""Line-ups and drafts of three a side: means over several pairs, and requests with two allies."""

from pyspark.sql import functions as F

from contestry.catalog.chronology import each_sql, side_sets
from contestry.catalog.drafting import draft_sql
from contestry.catalog.registry import query, rounded
from contestry.operators import lineups, pairs, ratings
from contestry.sources import sample_tables as st

SIZE = 3
EACH, DRAFT = each_sql(SIZE), draft_sql(SIZE)


def _duels(spark, d):
    return lineups.duels(st.members(spark, d), SIZE)


def _sides(spark, d):
    return lineups.sides(_duels(spark, d))


@query("q_new_members_of_three", f"""WITH {EACH}, g AS (SELECT contest_id, side, row_number() OVER (PARTITION BY member_id ORDER BY ts, contest_id) - 1 AS games FROM seats)
SELECT contest_id, side, round(avg(games), 6) AS mean_games, CAST(sum(CASE WHEN games < 5 THEN 1 ELSE 0 END) AS BIGINT) AS new_members FROM g GROUP BY 1, 2""")
def new_members_of_three(spark, d):
    return rounded(lineups.member_experience(_sides(spark, d)))


@query("q_pair_experience_of_three", f"""WITH {EACH}, p AS (SELECT x.contest_id, x.ts, x.side, x.member_id AS lo, y.member_id AS hi
  FROM seats x JOIN seats y ON x.contest_id = y.contest_id AND x.side = y.side AND x.member_id < y.member_id),
g AS (SELECT contest_id, side, row_number() OVER (PARTITION BY lo, hi ORDER BY ts, contest_id, side) - 1 AS games FROM p)
SELECT contest_id, side, round(avg(games), 6) AS pair_games FROM g GROUP BY 1, 2""")
def pair_experience_of_three(spark, d):
    return rounded(lineups.pair_experience(_sides(spark, d)))


@query("q_retained_members_of_three", f"""WITH {EACH} SELECT contest_id, side, CASE WHEN prev IS NULL THEN 0 ELSE len(list_intersect(keys, prev)) END AS retained
FROM (SELECT contest_id, side, keys, last(keys ORDER BY ts, contest_id, side) OVER (PARTITION BY entity_id ORDER BY ts, contest_id
  GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM each)""")
def retained_members_of_three(spark, d):
    return lineups.retained_members(_sides(spark, d))


@query("q_lineup_experience_of_three", f"""WITH {EACH} SELECT contest_id, side,
  row_number() OVER (PARTITION BY keys ORDER BY ts, contest_id, side) - 1 AS lineup_games FROM each""")
def lineup_experience_of_three(spark, d):
    return lineups.lineup_experience(_sides(spark, d))


def _mean(values: str, seats: str) -> str:
    return "(" + " + ".join(f"run.{values}[n.{seats}[{i}]]" for i in range(1, SIZE + 1)) + f") / {SIZE}.0e0"


@query("q_member_ratings_of_three", f"""WITH RECURSIVE {side_sets(SIZE)},
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
    SELECT n.*, run.r, run.g, {_mean('r', 'ai')} AS ra, {_mean('r', 'bi')} AS rb, {_mean('g', 'ai')} AS ga, {_mean('g', 'bi')} AS gb
    FROM run JOIN n ON n.pool = run.pool AND n.nth = run.nth + 1))
)
SELECT contest_id, round(a_rating, 6) AS a_rating, round(b_rating, 6) AS b_rating, round(a_games, 6) AS a_games, round(b_games, 6) AS b_games,
  round(a_expected, 6) AS a_expected FROM run WHERE nth > 0""")
def member_ratings_of_three(spark, d):
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v) / F.size(c)
    folded = ratings.member_ratings(_duels(spark, d))
    return rounded(folded.select("contest_id", "a_rating", "b_rating", mean("a_games").alias("a_games"), mean("b_games").alias("b_games"), "a_expected"))


@query("q_item_synergies_of_three", f"WITH {DRAFT} SELECT era, item_id, ally_id, games, wins FROM synergies")
def item_synergies_of_three(spark, d):
    return pairs.item_synergies(pairs.drafts(st.picks_bans(spark, d), SIZE))


@query("q_counter_recommend_two_allies", f"""WITH {DRAFT},
requests AS (SELECT DISTINCT b.era, b.enemies, a.allies FROM
  (SELECT contest_id, era, list(item_id ORDER BY item_id) AS enemies FROM picked WHERE side = 1 GROUP BY 1, 2) b JOIN
  (SELECT contest_id, list(item_id ORDER BY item_id)[1:2] AS allies FROM picked WHERE side = 0 GROUP BY 1) a USING (contest_id)),
cand AS (SELECT r.era, enemies, allies, item_id, games AS meta_games, (wins + 10.0) / (games + 20.0) AS meta_rate
  FROM requests r JOIN results USING (era) WHERE games >= 3 AND era <> 0 AND NOT list_contains(enemies, item_id) AND NOT list_contains(allies, item_id)),
en AS (SELECT era, enemies, allies, item_id, unnest(enemies) AS enemy FROM cand),
versus AS (SELECT en.era, enemies, allies, en.item_id, count(m.games) AS found, coalesce(sum(m.games), 0) AS mg, avg((m.wins + 4.0) / (m.games + 8.0)) AS mr
  FROM en LEFT JOIN matchups m ON m.era = en.era AND m.item_id = en.item_id AND m.opponent_id = en.enemy GROUP BY 1, 2, 3, 4),
al AS (SELECT era, enemies, allies, item_id, unnest(allies) AS ally FROM cand),
beside AS (SELECT al.era, enemies, allies, al.item_id, CASE WHEN count(s.games) = 2 THEN sum((s.wins + 4.0) / (s.games + 8.0)) / 2 ELSE 0.5 END AS synergy_rate
  FROM al LEFT JOIN synergies s ON s.era = al.era AND s.item_id = al.item_id AND s.ally_id = al.ally GROUP BY 1, 2, 3, 4),
scored AS (SELECT c.*, coalesce(v.mr, 0.5) AS matchup_rate, CAST(v.mg AS BIGINT) AS matchup_games, v.found / len(c.enemies) AS enemy_coverage, synergy_rate
  FROM cand c JOIN versus v USING (era, enemies, allies, item_id) JOIN beside USING (era, enemies, allies, item_id)),
final AS (SELECT *, 0.60 * (0.5 + (matchup_rate - 0.5) * (1 - exp(-matchup_games / 30.0))) + 0.25 * meta_rate + 0.15 * synergy_rate AS score FROM scored)
SELECT era, array_to_string(enemies, ',') AS enemies, array_to_string(allies, ',') AS allies,
  row_number() OVER (PARTITION BY era, enemies, allies ORDER BY round(score, 9) DESC, matchup_games DESC, item_id) AS rank, item_id,
  round(score, 6) AS score, round(matchup_rate, 6) AS matchup_rate, matchup_games, round(enemy_coverage, 6) AS enemy_coverage, round(meta_rate, 6) AS meta_rate,
  meta_games, round(synergy_rate, 6) AS synergy_rate FROM final QUALIFY rank <= 10""")
def counter_recommend_two_allies(spark, d):
    base = pairs.drafts(st.picks_bans(spark, d), SIZE)
    requests = base.select("era", F.array_sort("b_items").alias("enemies"), F.slice(F.array_sort("a_items"), 1, 2).alias("allies"))
    out = pairs.counter_recommend(requests, pairs.item_results(base), pairs.item_matchups(base), pairs.item_synergies(base))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return rounded(out.withColumn("enemies", text("enemies")).withColumn("allies", text("allies")))
