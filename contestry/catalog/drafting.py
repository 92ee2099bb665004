from pyspark.sql import functions as F

from contestry.catalog.registry import query, rounded
from contestry.functions.rates import smoothed_rate
from contestry.operators import ingest, pairs, project
from contestry.sources import sample_tables as st

SIZE = 2


def draft_sql(size: int) -> str:
    return st.SQL_MEMBERS + f""",
exact AS (SELECT contest_id FROM members GROUP BY contest_id
  HAVING count(*) FILTER (WHERE side = 0 AND is_pick = 1) = {size} AND count(*) FILTER (WHERE side = 1 AND is_pick = 1) = {size}),
picked AS (SELECT * FROM members SEMI JOIN exact USING (contest_id) WHERE is_pick = 1),
matchups AS (SELECT x.era, x.item_id, y.item_id AS opponent_id, count(*) AS games, CAST(sum(x.won) AS BIGINT) AS wins
  FROM picked x JOIN picked y ON x.contest_id = y.contest_id AND x.side <> y.side GROUP BY 1, 2, 3),
synergies AS (SELECT x.era, x.item_id, y.item_id AS ally_id, count(*) AS games, CAST(sum(x.won) AS BIGINT) AS wins
  FROM picked x JOIN picked y ON x.contest_id = y.contest_id AND x.side = y.side AND x.slot <> y.slot GROUP BY 1, 2, 3),
results AS (SELECT era, item_id, count(*) AS games, CAST(sum(won) AS BIGINT) AS wins FROM picked GROUP BY 1, 2)"""


DRAFT = draft_sql(SIZE)


def _drafts(spark, d):
    return pairs.drafts(st.picks_bans(spark, d), SIZE)


@query("q_item_matchups", f"""WITH {DRAFT} SELECT era, item_id, opponent_id, games, wins, round((wins + 4.0) / (games + 8.0), 6) AS rate FROM matchups""")
def item_matchups(spark, d):
    return rounded(pairs.item_matchups(_drafts(spark, d)).withColumn(
        "rate", smoothed_rate(F.col("wins"), F.col("games"), 8.0)))


@query("q_item_synergies", f"WITH {DRAFT} SELECT era, item_id, ally_id, games, wins FROM synergies")
def item_synergies(spark, d):
    return pairs.item_synergies(_drafts(spark, d))


@query("q_entity_item_stats", f"""WITH {DRAFT}, {st.SQL_ALIASES}
SELECT era, coalesce(canonical, entity_id) AS entity_id, item_id, CAST(sum(is_pick) AS BIGINT) AS picks,
  CAST(sum(is_pick * won) AS BIGINT) AS wins, CAST(sum(1 - is_pick) AS BIGINT) AS bans
FROM members SEMI JOIN exact USING (contest_id) LEFT JOIN alias_of ON id = entity_id GROUP BY 1, 2, 3""")
def entity_item_stats(spark, d):
    aliases = project.alias_map(st.alias_lists(spark, d))
    return pairs.entity_item_stats(project.canonical_ids(_drafts(spark, d), aliases, "a_id", "b_id"))


@query("q_shrunk_rate", f"""WITH {DRAFT} SELECT era, item_id, round((wins + 4.0) / (games + 8.0), 6) AS draft, round((wins + 10.0) / (games + 20.0), 6) AS meta,
  round((wins + 3.0) / (games + 6.0), 6) AS recent, round((wins + 5.0) / (games + 10.0), 6) AS by_era FROM results""")
def shrunk_rate(spark, d):
    rate = lambda prior: smoothed_rate(F.col("wins"), F.col("games"), prior)
    return rounded(pairs.item_results(_drafts(spark, d)).select(
        "era", "item_id", rate(8.0).alias("draft"), rate(20.0).alias("meta"), rate(6.0).alias("recent"), rate(10.0).alias("by_era")))


@query("q_multi_key_top_n", f"""WITH {DRAFT} SELECT era, item_id, opponent_id, games, round((wins + 4.0) / (games + 8.0), 6) AS rate FROM matchups
ORDER BY rate DESC, games DESC, era, item_id, opponent_id LIMIT 25""")
def multi_key_top_n(spark, d):
    m = pairs.item_matchups(_drafts(spark, d)).withColumn("rate", F.round(smoothed_rate(F.col("wins"), F.col("games"), 8.0), 6))
    return m.select("era", "item_id", "opponent_id", "games", "rate").orderBy(
        F.desc("rate"), F.desc("games"), "era", "item_id", "opponent_id").limit(25)


@query("q_counter_recommend", f"""WITH {DRAFT},
requests AS (SELECT DISTINCT b.era, b.enemies, a.allies FROM
  (SELECT contest_id, era, list(item_id ORDER BY item_id) AS enemies FROM picked WHERE side = 1 GROUP BY 1, 2) b JOIN
  (SELECT contest_id, [min(item_id)] AS allies FROM picked WHERE side = 0 GROUP BY 1) a USING (contest_id)),
cand AS (SELECT r.era, enemies, allies, item_id, games AS meta_games, (wins + 10.0) / (games + 20.0) AS meta_rate
  FROM requests r JOIN results USING (era) WHERE games >= 3 AND NOT list_contains(enemies, item_id) AND NOT list_contains(allies, item_id)),
en AS (SELECT era, enemies, allies, item_id, unnest(enemies) AS enemy FROM cand),
versus AS (SELECT en.era, enemies, allies, en.item_id, count(m.games) AS found, coalesce(sum(m.games), 0) AS mg, avg((m.wins + 4.0) / (m.games + 8.0)) AS mr
  FROM en LEFT JOIN matchups m ON m.era = en.era AND m.item_id = en.item_id AND m.opponent_id = en.enemy GROUP BY 1, 2, 3, 4),
scored AS (SELECT c.*, coalesce(v.mr, 0.5) AS matchup_rate, CAST(v.mg AS BIGINT) AS matchup_games, v.found / len(c.enemies) AS enemy_coverage,
    coalesce((s.wins + 4.0) / (s.games + 8.0), 0.5) AS synergy_rate
  FROM cand c JOIN versus v USING (era, enemies, allies, item_id)
  LEFT JOIN synergies s ON s.era = c.era AND s.item_id = c.item_id AND s.ally_id = c.allies[1]),
final AS (SELECT *, 0.60 * (0.5 + (matchup_rate - 0.5) * (1 - exp(-matchup_games / 30.0))) + 0.25 * meta_rate + 0.15 * synergy_rate AS score FROM scored)
SELECT era, array_to_string(enemies, ',') AS enemies, array_to_string(allies, ',') AS allies,
  row_number() OVER (PARTITION BY era, enemies, allies ORDER BY round(score, 9) DESC, matchup_games DESC, item_id) AS rank, item_id,
  round(score, 6) AS score, round(matchup_rate, 6) AS matchup_rate, matchup_games, round(enemy_coverage, 6) AS enemy_coverage, round(meta_rate, 6) AS meta_rate,
  meta_games, round(synergy_rate, 6) AS synergy_rate FROM final QUALIFY rank <= 10""")
def counter_recommend(spark, d):
    base = _drafts(spark, d)
    requests = base.select("era", F.array_sort("b_items").alias("enemies"), F.array(F.array_min("a_items")).alias("allies"))
    out = pairs.counter_recommend(requests, pairs.item_results(base), pairs.item_matchups(base), pairs.item_synergies(base))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return rounded(out.withColumn("enemies", text("enemies")).withColumn("allies", text("allies")))


@query("q_beta_posterior_rank", f"""WITH {st.SQL_SNAPSHOTS}, s AS (SELECT * FROM snapshots WHERE collected_at = (SELECT max(collected_at) FROM snapshots)),
t AS (SELECT bracket, sum(picks) AS tp, sum(wins) / sum(picks) AS pm FROM s GROUP BY bracket),
p AS (SELECT s.*, tp, wins + pm * 500 AS a, picks - wins + (1 - pm) * 500 AS b FROM s JOIN t USING (bracket) WHERE picks >= 2),
q AS (SELECT *, a / (a + b) AS m, 1.96 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS g FROM p)
SELECT bracket, item_id, picks, wins, round(wins / picks, 6) AS raw_rate, round(m, 6) AS posterior_rate, round(greatest(0, m - g), 6) AS lower_95,
  round(least(1, m + g), 6) AS upper_95, round(picks / tp, 6) AS share,
  row_number() OVER (PARTITION BY bracket ORDER BY round(greatest(0, m - g), 9) DESC, picks DESC, item_id) AS rank FROM q QUALIFY rank <= 15""")
def beta_posterior_rank(spark, d):
    return rounded(pairs.beta_posterior_rank(ingest.latest_snapshot(st.snapshots(spark, d)), minimum_picks=2))


@query("q_rank_pivot", f"""WITH {st.SQL_SNAPSHOTS}, s AS (SELECT * FROM snapshots WHERE collected_at = (SELECT max(collected_at) FROM snapshots)),
t AS (SELECT item_id, row_number() OVER (ORDER BY sum(picks) DESC, item_id) AS r FROM s GROUP BY item_id)
SELECT bracket, """ + ", ".join(f"round(max(CASE WHEN r = {r} THEN wins / picks END), 6) AS top_{r}" for r in range(1, 6)) + """
FROM s JOIN t USING (item_id) WHERE r <= 5 GROUP BY bracket""")
def rank_pivot(spark, d):
    return rounded(pairs.rank_pivot(ingest.latest_snapshot(st.snapshots(spark, d))))
