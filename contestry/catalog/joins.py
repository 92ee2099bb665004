from pyspark.sql import functions as F

from contestry.catalog.chronology import ELO_SQL, SL
from contestry.catalog.registry import query, rounded
from contestry.operators import chronology as ch, lineups, project, ratings, roster, standings as sd
from contestry.plans import features
from contestry.sources import sample_tables as st

VALID = lambda spark, d: ch.valid_contests(st.contests(spark, d))


@query("q_canonical_ids", f"""WITH {st.SQL_CONTESTS}, {st.SQL_ALIASES} SELECT contest_id, coalesce(x.canonical, a_id) AS a_id, coalesce(y.canonical, b_id) AS b_id
FROM contests LEFT JOIN alias_of x ON x.id = a_id LEFT JOIN alias_of y ON y.id = b_id""")
def canonical_ids(spark, d):
    aliases = project.alias_map(st.alias_lists(spark, d))
    return project.canonical_ids(st.contests(spark, d), aliases, "a_id", "b_id").select("contest_id", "a_id", "b_id")


def _member_dim(spark, d):
    return st.table(spark, d, "customer").select(
        (F.col("c_custkey") + 1).alias("member_id"), F.col("c_name").alias("handle"))


def _leagues(spark, d):
    n = st.table(spark, d, "nation")
    tier = F.when(F.col("n_nationkey") % 3 == 0, "premium").when(F.col("n_nationkey") % 3 == 1, "amateur")
    return n.select(F.col("n_nationkey").cast("long").alias("league_id"), tier.alias("league_tier"), F.col("n_name").alias("league_name"))


@query("q_member_training_view", f"""WITH {st.SQL_MEMBERS}, dim AS (SELECT c_custkey + 1 AS member_id, c_name AS handle FROM customer),
lg AS (SELECT n_nationkey AS league_id, CASE n_nationkey % 3 WHEN 0 THEN 'premium' WHEN 1 THEN 'amateur' END AS league_tier FROM nation)
SELECT m.contest_id, m.slot, m.member_id, handle, coalesce(league_tier, 'professional') AS tier, entity_id,
  CASE WHEN side = 0 THEN c.b_id ELSE c.a_id END AS opponent_id, won, round(CASE WHEN m.duration > 0 THEN kills * 60.0 / m.duration END, 6) AS kills_per_min,
  round(CASE WHEN m.duration > 0 THEN denies * 60.0 / m.duration END, 6) AS denies_per_min
FROM members m JOIN contests c ON c.contest_id = m.contest_id LEFT JOIN dim ON dim.member_id = m.member_id LEFT JOIN lg ON lg.league_id = c.league_id""")
def member_training_view(spark, d):
    v = project.training_view(st.members(spark, d), st.contests(spark, d), _member_dim(spark, d), _leagues(spark, d).drop("league_name"))
    return rounded(v.select("contest_id", "slot", "member_id", "handle", "tier", "entity_id", "opponent_id", "won", "kills_per_min", "denies_per_min"))


@query("q_enrich_dims", f"""WITH {st.SQL_CONTESTS}, dim AS (SELECT c_custkey + 1 AS a_id, c_name, c_mktsegment FROM customer)
SELECT contest_id, coalesce(c_name, 'unknown') AS c_name, coalesce(c_mktsegment, 'none') AS c_mktsegment, n_name AS league_name
FROM contests LEFT JOIN dim USING (a_id) LEFT JOIN nation ON n_nationkey = league_id""")
def enrich_dims(spark, d):
    dim = st.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("a_id"), "c_name", "c_mktsegment")
    out = roster.enrich_dims(st.contests(spark, d), [
        (dim, "a_id", {"c_name": F.lit("unknown"), "c_mktsegment": F.lit("none")}), (_leagues(spark, d), "league_id", {})])
    return out.select("contest_id", "c_name", "c_mktsegment", "league_name")


PHASE = """date_diff('day', DATE '1970-01-01', CAST(era || '-07-01' AS DATE)) * 86400 AS lo, (date_diff('day', DATE '1970-01-01', CAST(era || '-08-31' AS DATE)) + 1) * 86400 AS hi"""


@query("q_classify_in_window", f"""WITH {st.SQL_CONTESTS} SELECT contest_id, league_id, era, CASE WHEN ts >= lo AND ts < hi THEN 1 ELSE 0 END AS venue_phase
FROM (SELECT *, {PHASE} FROM contests)""")
def classify_in_window(spark, d):
    return project.classify_in_window(st.contests(spark, d), st.event_windows(spark, d)).select(
        "contest_id", "league_id", "era", "venue_phase")


@query("q_event_phase", f"""WITH {st.SQL_CONTESTS} SELECT contest_id, ts FROM (SELECT *, {PHASE} FROM contests) WHERE ts >= lo AND ts < hi""")
def event_phase(spark, d):
    start, end = F.concat(F.col("era").cast("string"), F.lit("-07-01")), F.concat(F.col("era").cast("string"), F.lit("-08-31"))
    return st.contests(spark, d).where(project.in_phase(F.col("ts"), start, end)).select("contest_id", "ts")


@query("q_contest_flags", f"""WITH {st.SQL_CONTESTS} SELECT contest_id, CASE WHEN first_blood_time = 0 THEN 1 WHEN first_blood_time IS NOT NULL THEN 0 END AS blood_at_start,
  CASE WHEN first_blood_time > 600 THEN 1 WHEN first_blood_time IS NOT NULL THEN 0 END AS blood_after_ten,
  CASE WHEN coalesce(duration, 0) < 1500 THEN 1 ELSE 0 END AS under_25_minutes, CASE WHEN coalesce(duration, 0) % 10 = 8 THEN 1 ELSE 0 END AS ends_in_8 FROM contests""")
def contest_flags(spark, d):
    return project.contest_flags(st.contests(spark, d))


@query("q_asset_url", """SELECT page_id, 'https://assets.example.org' || rtrim(path, '?') AS url FROM (
  SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN '' WHEN page_id % 5 = 2 THEN '/p/' || page_id || '?' ELSE '/p/' || page_id END AS path FROM pages) WHERE path <> ''
UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 5 IN (0, 1)""")
def asset_url(spark, d):
    r, base = F.col("page_id") % 5, F.concat(F.lit("/p/"), F.col("page_id").cast("string"))
    path = F.when(r == 0, None).when(r == 1, "").when(r == 2, F.concat(base, F.lit("?"))).otherwise(base)
    return st.table(spark, d, "pages").select("page_id", project.asset_url("https://assets.example.org", path).alias("url"))


@query("q_join_feature_tables")
def join_feature_tables(spark, d):
    c = st.contests(spark, d)
    return rounded(features.join_feature_tables(ratings.elo_history(c), ratings.glicko_features(ratings.glicko_timeline(c))))


@query("q_latest_state_asof", ELO_SQL + f""", h AS (SELECT v.ts, run.contest_id, v.a_id AS entity_id, a_after AS after FROM run JOIN valid v USING (contest_id) WHERE run.nth > 0
   UNION ALL SELECT v.ts, run.contest_id, v.b_id, b_after FROM run JOIN valid v USING (contest_id) WHERE run.nth > 0), k AS (SELECT * FROM h WHERE ts <= 883612800)
SELECT c_custkey + 1 AS entity_id, round(arg_max(after, (ts, contest_id)), 6) AS rating, max(ts) AS last_ts, count(ts) AS contests
FROM customer LEFT JOIN k ON k.entity_id = c_custkey + 1 GROUP BY 1""")
def latest_state_asof(spark, d):
    sides = ratings.elo_side_history(ratings.elo_history(st.contests(spark, d)))
    entities = st.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("entity_id"))
    return rounded(roster.latest_state_asof(entities, sides, as_of=883612800).select("entity_id", "rating", "last_ts", "contests"))


@query("q_latest_state_glicko")
def latest_state_glicko(spark, d):
    """Alias sets as entities, with Elo and Glicko states together."""
    aliases = project.alias_map(st.alias_lists(spark, d))
    c = ch.valid_contests(project.canonical_ids(ch.valid_contests(st.contests(spark, d)), aliases, "a_id", "b_id"))
    entities = aliases.select(F.col("canonical_id").alias("entity_id")).distinct()
    return rounded(roster.latest_state_asof(
        entities, ratings.elo_side_history(ratings.elo_history(c)), ratings.glicko_history(ratings.glicko_timeline(c))))


REG = """reg AS (SELECT c_custkey AS reg_id, c_custkey % 40 + 1 AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN upper(p_name) ELSE p_brand END AS name,
  CASE WHEN c_custkey % 10 = 0 THEN c_custkey * 2 ELSE NULL END AS override_id FROM customer LEFT JOIN part ON p_partkey = c_custkey),
cand AS (SELECT p_partkey AS member_id, p_name AS handle, p_brand AS alias, p_size AS entity_id, CAST(floor(p_retailprice) AS BIGINT) AS last_ts, p_partkey % 7 AS contests FROM part)"""
KEY = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query("q_resolve_names", f"""WITH {REG}, named AS (SELECT DISTINCT member_id, entity_id, last_ts, contests, {KEY.format('handle')} AS key FROM cand UNION SELECT member_id, entity_id, last_ts, contests, {KEY.format('alias')} FROM cand),
r AS (SELECT *, {KEY.format('name')} AS key FROM reg),
o AS (SELECT reg_id, r.entity_id, name, member_id, 0 AS prio, 0 AS same, 0 AS last_ts, 0 AS contests FROM r JOIN cand ON member_id = override_id
  UNION ALL SELECT reg_id, r.entity_id, name, member_id, 1, CASE WHEN n.entity_id = r.entity_id THEN 0 ELSE 1 END, -n.last_ts, -n.contests FROM r JOIN named n USING (key))
SELECT reg_id, entity_id, name, member_id FROM o QUALIFY row_number() OVER (PARTITION BY reg_id ORDER BY prio, same, last_ts, contests, member_id) = 1""")
def resolve_names(spark, d):
    part = st.table(spark, d, "part")
    reg = st.table(spark, d, "customer").join(part, F.col("p_partkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("reg_id"), (F.col("c_custkey") % 40 + 1).alias("entity_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_brand")).alias("name"),
        F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") * 2).alias("override_id"))
    cand = part.select(F.col("p_partkey").alias("member_id"), F.col("p_name").alias("handle"), F.col("p_brand").alias("alias"),
                       F.col("p_size").cast("long").alias("entity_id"), F.col("p_retailprice").cast("long").alias("last_ts"),
                       (F.col("p_partkey") % 7).alias("contests"))
    return roster.resolve_names(reg, cand)


@query("q_exclude_selected", f"""WITH {st.SQL_MEMBERS}, banned AS (SELECT DISTINCT contest_id, item_id FROM members WHERE is_pick = 0)
SELECT contest_id, slot, item_id FROM members m WHERE is_pick = 1 AND NOT EXISTS (SELECT 1 FROM banned b WHERE b.contest_id = m.contest_id AND b.item_id = m.item_id)""")
def exclude_selected(spark, d):
    m = st.members(spark, d)
    return roster.exclude_selected(m.where("is_pick = 1"), m.where("is_pick = 0"), ["contest_id", "item_id"]).select("contest_id", "slot", "item_id")


@query("q_set_algebra", f"""WITH {st.SQL_CONTESTS}, a AS (SELECT DISTINCT a_id AS id FROM contests WHERE era < 1996), b AS (SELECT DISTINCT b_id AS id FROM contests WHERE era >= 1996)
SELECT id, CASE WHEN b.id IS NOT NULL THEN 'both' ELSE 'first' END AS "where" FROM a LEFT JOIN b USING (id) UNION ALL SELECT id, 'second' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def set_algebra(spark, d):
    c = st.contests(spark, d)
    return roster.set_algebra(c.where("era < 1996").select(F.col("a_id").alias("id")), c.where("era >= 1996").select(F.col("b_id").alias("id")), "id")


RATED = "rated AS (SELECT c_custkey + 1 AS entity_id, 1300 + c_custkey % 400 AS rating, 50 + c_custkey % 200 AS deviation FROM customer)"


def _rated(spark, d):
    return st.table(spark, d, "customer").select(
        (F.col("c_custkey") + 1).alias("entity_id"), (1300.0 + F.col("c_custkey") % 400).alias("rating"),
        (50.0 + F.col("c_custkey") % 200).alias("deviation"))


@query("q_pairwise_probability", f"""WITH {st.SQL_VALID}, {RATED}, ask AS (SELECT a_id, b_id FROM valid UNION SELECT b_id, a_id FROM valid),
p AS (SELECT a_id, b_id, 1 / (1 + exp(-(1 / sqrt(1 + 3 * (pow(xd / 173.7178, 2) + pow(yd / 173.7178, 2)) / (pi() * pi()))) * (xr - yr) / 173.7178)) AS p
  FROM (SELECT ask.a_id, ask.b_id, coalesce(r.rating, 1500) AS xr, coalesce(r.deviation, 350) AS xd, coalesce(s.rating, 1500) AS yr, coalesce(s.deviation, 350) AS yd
    FROM ask LEFT JOIN rated r ON r.entity_id = a_id LEFT JOIN rated s ON s.entity_id = b_id))
SELECT a_id, b_id, round(p, 6) AS p, round(p * p * (3 - 2 * p), 6) AS bo3, round(p * p * p * (10 - 15 * p + 6 * p * p), 6) AS bo5 FROM p""")
def pairwise_probability(spark, d):
    v = VALID(spark, d).select("a_id", "b_id")
    asked = v.unionByName(v.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))).distinct()
    return rounded(sd.pairwise_probability(_rated(spark, d), asked))


SERIES = """series AS (SELECT *, CASE WHEN lw > hw THEN lo WHEN hw > lw THEN hi END AS winner, CASE WHEN lw = hw THEN 'live' ELSE 'complete' END AS status FROM (
  SELECT pool, series_id, least(a_id, b_id) AS lo, greatest(a_id, b_id) AS hi, sum(CASE WHEN a_id < b_id THEN a_win ELSE 1 - a_win END) AS lw,
    sum(CASE WHEN a_id < b_id THEN 1 - a_win ELSE a_win END) AS hw FROM valid WHERE series_id <> 0 GROUP BY 1, 2, 3, 4))"""
BOTH = """both_sides AS (SELECT pool, series_id, lo AS entity_id, hi AS opponent_id, CASE WHEN winner = lo THEN 1 ELSE 0 END AS won FROM series WHERE status = 'complete'
  UNION ALL SELECT pool, series_id, hi, lo, CASE WHEN winner = hi THEN 1 ELSE 0 END FROM series WHERE status = 'complete')"""


@query("q_standings", f"""WITH {st.SQL_VALID}, {SERIES}, {BOTH}, {RATED}, own AS (SELECT pool, entity_id, sum(won) AS wins, sum(1 - won) AS losses FROM both_sides GROUP BY 1, 2),
opp AS (SELECT b.entity_id, sum(o.wins) AS opponent_wins FROM both_sides b JOIN own o ON o.entity_id = b.opponent_id GROUP BY 1)
SELECT pool, entity_id, CAST(wins AS BIGINT) AS wins, CAST(losses AS BIGINT) AS losses, CAST(opponent_wins AS BIGINT) AS opponent_wins,
  row_number() OVER (PARTITION BY pool ORDER BY wins DESC, losses, opponent_wins DESC, coalesce(rating, 1500) DESC, entity_id) AS rank FROM own JOIN opp USING (entity_id) LEFT JOIN rated USING (entity_id)""")
def standings(spark, d):
    s = sd.standings(sd.series_results(VALID(spark, d)), _rated(spark, d).select("entity_id", "rating"))
    return s.select("pool", "entity_id", "wins", "losses", "opponent_wins", "rank")


@query("q_series_checks", f"""WITH {st.SQL_VALID}, {SERIES}, x AS (SELECT pool, series_id, lo, hi, series_id % 5 + 1 AS round,
   CASE WHEN series_id % 97 = 0 THEN -1 ELSE winner END AS winner, CASE WHEN series_id % 101 = 0 THEN 'lost' ELSE status END AS status FROM series),
e AS (SELECT series_id, pool, round, lo AS entity_id FROM x UNION ALL SELECT series_id, pool, round, hi FROM x)
SELECT 'winner' AS rule, CAST(series_id AS VARCHAR) AS key FROM x WHERE status = 'complete' AND (winner IS NULL OR winner NOT IN (lo, hi))
UNION ALL SELECT 'status', CAST(series_id AS VARCHAR) FROM x WHERE status NOT IN ('complete', 'live', 'scheduled')
UNION ALL SELECT 'unknown_entity', CAST(entity_id AS VARCHAR) FROM e WHERE entity_id NOT IN (SELECT c_custkey + 1 FROM customer)
UNION ALL SELECT 'twice_in_round', round || '-' || entity_id FROM e GROUP BY round, entity_id HAVING count(*) > 1
UNION ALL SELECT 'relation', CAST(series_id AS VARCHAR) FROM x WHERE (round <= 3 AND lo % 2 <> hi % 2) OR (round = 4 AND lo % 2 = hi % 2)
UNION ALL SELECT 'uneven_games', CAST(pool AS VARCHAR) FROM (SELECT pool, entity_id, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY pool HAVING min(n) <> max(n)""")
def series_checks(spark, d):
    s = sd.series_results(VALID(spark, d)).withColumn("round", F.col("series_id") % 5 + 1).withColumn(
        "winner", F.when(F.col("series_id") % 97 == 0, -1).otherwise(F.col("winner"))).withColumn(
        "status", F.when(F.col("series_id") % 101 == 0, "lost").otherwise(F.col("status")))
    known = st.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("entity_id"))
    return sd.series_checks(s, known, F.col("lo") % 2, F.col("hi") % 2)


@query("q_entity_record", f"""WITH {SL}, {st.SQL_ALIASES} SELECT league_id, coalesce(canonical, entity_id) AS entity_id, CAST(sum(won) AS BIGINT) AS wins, CAST(sum(1 - won) AS BIGINT) AS losses
FROM sl JOIN contests USING (contest_id) LEFT JOIN alias_of ON id = entity_id GROUP BY 1, 2""")
def entity_record(spark, d):
    aliases = project.alias_map(st.alias_lists(spark, d))
    sides = project.canonical_ids(ch.side_long(VALID(spark, d), "league_id"), aliases, "entity_id")
    return sd.entity_record(sides, "league_id")


@query("q_form_rating", f"""WITH {SL}, {RATED}, r AS (SELECT entity_id, coalesce(any_value(rating), 1500) AS rating, sum(won) AS wins, sum(1 - won) AS losses FROM sl LEFT JOIN rated USING (entity_id) GROUP BY 1),
f AS (SELECT *, (SELECT avg(rating) FROM r) + 400 * log10((wins + 2.0) / (losses + 2.0)) AS form FROM r)
SELECT entity_id, round(form, 6) AS form, round(0.6 * rating + 0.4 * form, 6) AS effective FROM f""")
def form_rating(spark, d):
    record = sd.entity_record(ch.side_long(VALID(spark, d))).join(_rated(spark, d), "entity_id", "left").na.fill({"rating": 1500.0})
    return rounded(sd.form_rating(record).select("entity_id", "form", "effective"))


@query("q_outcome_marginals", f"""WITH {SL}, o AS (SELECT contest_id AS trial, CASE WHEN won = 1 THEN 'win' ELSE 'loss' END AS category, entity_id FROM sl)
SELECT category, entity_id, count(*) AS hits, round(count(*) / (SELECT count(DISTINCT trial) FROM o), 9) AS probability FROM o GROUP BY 1, 2""")
def outcome_marginals(spark, d):
    o = ch.side_long(VALID(spark, d)).select(F.col("contest_id").alias("trial"), F.when(F.col("won") == 1, "win").otherwise("loss").alias("category"), "entity_id")
    return rounded(sd.outcome_marginals(o), 9)


LINEUP = """lineups AS (SELECT contest_id, side, any_value(entity_id) AS entity_id, substr(sha256(array_to_string(list_sort(list(DISTINCT member_id)), ',')), 1, 20) AS lineup
  FROM members GROUP BY contest_id, side HAVING count(DISTINCT member_id) = 2)"""


@query("q_lineup_sets", f"WITH {st.SQL_MEMBERS}, {LINEUP} SELECT contest_id, side, entity_id, lineup FROM lineups")
def lineup_sets(spark, d):
    return lineups.lineup_sets(st.members(spark, d), 2).select("contest_id", "side", "entity_id", "lineup")


@query("q_set_frequency", f"""WITH {st.SQL_MEMBERS}, {LINEUP}, c AS (SELECT lineup, count(*) AS n FROM lineups GROUP BY 1)
SELECT lineup, n, round(n / (SELECT sum(n) FROM c), 9) AS probability, row_number() OVER (ORDER BY n DESC, lineup) AS rank, (SELECT count(*) FROM c) AS distinct_sets FROM c
ORDER BY n DESC, lineup LIMIT 20""")
def set_frequency(spark, d):
    return rounded(sd.set_frequency(lineups.lineup_sets(st.members(spark, d), 2), "lineup"), 9)


@query("q_distinct_counts", f"""WITH {st.SQL_MEMBERS}, {LINEUP} SELECT count(DISTINCT entity_id) AS entities, count(DISTINCT lineup) AS sets, count(*) AS observations FROM lineups""")
def distinct_counts(spark, d):
    return lineups.lineup_sets(st.members(spark, d), 2).agg(
        F.countDistinct("entity_id").alias("entities"), F.countDistinct("lineup").alias("sets"), F.count("*").alias("observations"))


@query("q_distinct_sketches", f"""WITH {st.SQL_MEMBERS}, {LINEUP} SELECT entity_id % 7 AS part, count(*) AS n, count(DISTINCT entity_id) AS entities, count(DISTINCT lineup) AS sets,
true AS entities_close, true AS sets_close FROM lineups GROUP BY 1""")
def distinct_sketches(spark, d):
    """Sketches of two stored partials, merged without their rows, beside the exact counts: within three standard errors."""
    from contestry.session import materialize, run_dir
    base, rows = run_dir(spark, "sketches"), lineups.lineup_sets(st.members(spark, d), 2).withColumn("part", F.col("entity_id") % 7)
    partials = [materialize(sd.distinct_sketches(rows.where(F.col("contest_id") % 2 == n), ["part"], ["entity_id", "lineup"]), f"{base}/{n}") for n in (0, 1)]
    near = sd.merge_sketches(partials, ["part"], ["entity_id", "lineup"]).withColumnsRenamed({"entity_id": "e", "lineup": "l"})
    exact = rows.groupBy("part").agg(F.countDistinct("entity_id").alias("entities"), F.countDistinct("lineup").alias("sets"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1 + 0.049 * F.col(b)
    return near.join(exact, "part").select("part", "n", "entities", "sets", close("e", "entities").alias("entities_close"), close("l", "sets").alias("sets_close"))


@query("q_merge_partials", f"""WITH {SL} SELECT entity_id, won, count(*) AS n FROM sl GROUP BY 1, 2""")
def merge_partials(spark, d):
    from contestry.session import materialize, run_dir
    base = run_dir(spark, "partials")
    chunks = []
    for n in range(3):
        part = ch.side_long(VALID(spark, d).where(F.col("contest_id") % 3 == n))
        chunks.append(materialize(part.groupBy("entity_id", "won").agg(F.count("*").alias("n")), f"{base}/{n}"))
    return sd.merge_partials(chunks, ["entity_id", "won"])


@query("q_coalesced_sort", f"""WITH {RATED}, r AS (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN NULL ELSE rating END AS elo, CASE WHEN entity_id % 2 = 0 THEN NULL ELSE deviation END AS glicko FROM rated)
SELECT entity_id, CAST(coalesce(elo, glicko, -1) AS DOUBLE) AS sort_rating FROM r ORDER BY sort_rating DESC, entity_id""")
def coalesced_sort(spark, d):
    r = _rated(spark, d).select("entity_id", F.when(F.col("entity_id") % 3 != 0, F.col("rating")).alias("elo"),
                                F.when(F.col("entity_id") % 2 != 0, F.col("deviation")).alias("glicko"))
    return sd.coalesced_sort(r, "elo", "glicko", "entity_id").select("entity_id", "sort_rating")
