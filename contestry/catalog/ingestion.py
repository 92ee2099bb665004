from pyspark.sql import functions as F

from contestry.catalog.registry import query, rounded
from contestry.operators import ingest, project
from contestry.session import run_dir
from contestry.sources import dims, payload, sample_tables as st


@query("q_scan_csv_dim", f"""WITH {st.SQL_ALIASES} SELECT id AS alias_id, canonical AS canonical_id FROM alias_of""")
def scan_csv_dim(spark, d):
    out = run_dir(spark, "participants")
    st.alias_lists(spark, d).write.option("header", True).csv(out)
    return project.alias_map(dims.read_csv_dim(spark, out, ["canonical_key", "source_ids"]))


def _docs(spark, d):
    return payload.parse(payload.pack(st.members(spark, d)))


@query("q_scan_nested_payload", f"""WITH {st.SQL_MEMBERS} SELECT contest_id, side, slot AS player_slot,
  CASE WHEN kills % 6 = 0 THEN NULL WHEN kills % 6 = 1 THEN 0 ELSE member_id END AS account_id, kills, deaths FROM members""")
def scan_nested_payload(spark, d):
    return payload.players(_docs(spark, d)).select("contest_id", "side", "player_slot", "account_id", "kills", "deaths")


@query("q_nested_event_counts", f"""WITH {st.SQL_MEMBERS}, o AS (SELECT contest_id,
  CASE WHEN kills % 4 = 1 THEN NULL ELSE slot END AS slot FROM members
  WHERE tormentors = 1 AND (kills % 4 IN (0, 1) OR deaths <> 0))
SELECT contest_id, slot, count(*) AS n FROM o WHERE slot IS NOT NULL GROUP BY 1, 2""")
def nested_event_counts(spark, d):
    return payload.event_counts(_docs(spark, d))


@query("q_nested_map_sums", f"""WITH {st.SQL_MEMBERS} SELECT contest_id, slot, member_id,
  CASE WHEN wards = 1 THEN 0 ELSE smokes END AS smokes_used, CASE WHEN wards = 1 THEN 0 ELSE madstones END AS bundles,
  CASE WHEN wards = 1 THEN 0 ELSE lotuses + courier_kills END AS lotus_uses FROM members""")
def nested_map_sums(spark, d):
    return payload.map_sums(_docs(spark, d), st.members(spark, d))


@query("q_nested_any_flags", f"""WITH {st.SQL_MEMBERS} SELECT contest_id, max(CASE WHEN roshan_kills <> 0 THEN 1 ELSE 0 END) AS any_boss_death,
  max(CASE WHEN wards = 2 THEN 1 ELSE 0 END) AS fountain_death FROM members GROUP BY contest_id""")
def nested_any_flags(spark, d):
    return payload.any_flags(_docs(spark, d))


VERSIONS = """records AS (
  SELECT contest_id, 1 AS version, ts, league_id, series_id, CAST(NULL AS BIGINT) AS duration, a_win, 0 AS detailed, 'index-' || contest_id AS payload FROM contests
  UNION ALL SELECT contest_id, 2, ts + 5, NULL, NULL, duration, 1 - a_win, 1, 'detail-' || contest_id FROM contests WHERE contest_id % 3 = 0
  UNION ALL SELECT contest_id, 3, ts + 9, league_id + 1, NULL, NULL, a_win, 0, 'late-' || contest_id FROM contests WHERE contest_id % 6 = 0)"""


def _versions(spark, d):
    c = st.contests(spark, d)
    text = lambda kind: F.concat(F.lit(kind), F.col("contest_id").cast("string"))
    empty = F.lit(None).cast("long")
    v1 = c.select("contest_id", F.lit(1).alias("version"), "ts", "league_id", "series_id", empty.alias("duration"), "a_win",
                  F.lit(0).alias("detailed"), text("index-").alias("payload"))
    v2 = c.where("contest_id % 3 = 0").select(
        "contest_id", F.lit(2).alias("version"), (F.col("ts") + 5).alias("ts"), empty.alias("league_id"), empty.alias("series_id"),
        "duration", (1 - F.col("a_win")).alias("a_win"), F.lit(1).alias("detailed"), text("detail-").alias("payload"))
    v3 = c.where("contest_id % 6 = 0").select(
        "contest_id", F.lit(3).alias("version"), (F.col("ts") + 9).alias("ts"), (F.col("league_id") + 1).alias("league_id"),
        empty.alias("series_id"), empty.alias("duration"), "a_win", F.lit(0).alias("detailed"), text("late-").alias("payload"))
    return v1.unionByName(v2).unionByName(v3)


@query("q_merge_non_null", f"""WITH {st.SQL_CONTESTS}, {VERSIONS} SELECT contest_id,
  arg_max(ts, version) AS ts, arg_max(league_id, version) FILTER (WHERE league_id IS NOT NULL) AS league_id,
  arg_max(series_id, version) FILTER (WHERE series_id IS NOT NULL) AS series_id,
  arg_max(duration, version) FILTER (WHERE duration IS NOT NULL) AS duration, arg_max(a_win, version) AS a_win
FROM records GROUP BY contest_id""")
def merge_non_null(spark, d):
    return ingest.merge_non_null(_versions(spark, d).drop("detailed", "payload"), "contest_id", "version", ("ts", "a_win"))


@query("q_merge_sticky_detail", f"""WITH {st.SQL_CONTESTS}, {VERSIONS} SELECT contest_id, detailed, payload FROM records
QUALIFY row_number() OVER (PARTITION BY contest_id ORDER BY detailed DESC, version DESC) = 1""")
def merge_sticky_detail(spark, d):
    return ingest.merge_sticky_detail(_versions(spark, d), "contest_id", "version")


@query("q_merge_latest", """SELECT user_id, event_id, event_type, value FROM events WHERE event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def merge_latest(spark, d):
    named = st.table(spark, d, "events").withColumn("event_type", F.nullif("event_type", F.lit("error"))).withColumn(
        "version", F.struct("ts", "event_id"))
    return ingest.merge_latest(named, "user_id", "version", ("event_type",)).select("user_id", "event_id", "event_type", "value")


@query("q_replace_children", f"""WITH {st.SQL_MEMBERS} SELECT contest_id, slot, item_id, 0 AS reload FROM members WHERE era <> 1995
UNION ALL SELECT contest_id, slot, item_id, 1 FROM members WHERE era = 1995 AND slot <> 0
UNION ALL SELECT contest_id, slot, item_id, 0 FROM members WHERE era = 1995 AND contest_id NOT IN
  (SELECT contest_id FROM members WHERE era = 1995 AND slot <> 0)""")
def replace_children(spark, d):
    m = st.members(spark, d)
    old = m.select("contest_id", "slot", "item_id", F.lit(0).alias("reload"))
    new = m.where("era = 1995 AND slot <> 0").select("contest_id", "slot", "item_id", F.lit(1).alias("reload"))
    return ingest.replace_children(old, new, "contest_id")


@query("q_unpivot_brackets", f"""WITH {st.SQL_SNAPSHOTS}, keys AS (SELECT DISTINCT collected_at, item_id FROM snapshots),
b AS (SELECT unnest(range(1, 9)) AS bracket)
SELECT k.collected_at, k.item_id, b.bracket, coalesce(s.picks, 0) AS picks, coalesce(s.wins, 0) AS wins
FROM keys k CROSS JOIN b LEFT JOIN snapshots s ON s.collected_at = k.collected_at AND s.item_id = k.item_id AND s.bracket = b.bracket""")
def unpivot_brackets(spark, d):
    wide = st.snapshots(spark, d).groupBy("collected_at", "item_id").agg(*[
        F.max(F.when(F.col("bracket") == b, F.col(c))).alias(f"{b}_{n}") for b in range(1, 9) for c, n in (("picks", "pick"), ("wins", "win"))])
    return ingest.unpivot_brackets(wide, ["collected_at", "item_id"])


@query("q_latest_snapshot", f"""WITH {st.SQL_SNAPSHOTS} SELECT collected_at, item_id, bracket, picks, wins FROM snapshots
WHERE collected_at = (SELECT max(collected_at) FROM snapshots)""")
def latest_snapshot(spark, d):
    return ingest.latest_snapshot(st.snapshots(spark, d)).select("collected_at", "item_id", "bracket", "picks", "wins")


@query("q_pending_worklist", f"""WITH {st.SQL_CONTESTS} SELECT contest_id, ts, league_id FROM contests
WHERE detailed = 0 AND ts >= 820454400 AND league_id IN (1, 3, 5, 7) ORDER BY ts DESC, contest_id DESC LIMIT 200""")
def pending_worklist(spark, d):
    return ingest.pending_worklist(st.contests(spark, d), 820454400, 200, [1, 3, 5, 7]).select("contest_id", "ts", "league_id")


@query("q_name_pattern_years", """SELECT c_custkey, year FROM (SELECT c_custkey,
  TRY_CAST(regexp_extract(c_name, '^customer#00000(\\d{4})$', 1, 'i') AS INT) AS year FROM customer) WHERE year BETWEEN 100 AND 1200""")
def name_pattern_years(spark, d):
    named = st.table(spark, d, "customer").select("c_custkey", "c_name")
    return project.pattern_years(named, "c_name", r"customer#00000(\\d{4})", 100, 1200).select("c_custkey", "year")


@query("q_run_audit", """SELECT 'sample' AS source, 'orders' AS entity, 'complete' AS status, 2 AS runs, 2 * count(*) AS rows_written FROM orders
UNION ALL SELECT 'sample', 'events', 'complete', 1, count(*) FROM events""")
def run_audit(spark, d):
    base = run_dir(spark, "audit")
    for n, name in enumerate(("orders", "orders", "events")):
        ingest.audited_write(st.table(spark, d, name), f"{base}/{name}-{n}", f"{base}/runs", "sample", name)
    return ingest.audit_report(spark.read.parquet(f"{base}/runs"))


@query("q_table_status", f"""WITH {st.SQL_CONTESTS}
SELECT 'contests' AS table_name, count(*) AS row_count, CAST(sum(detailed) AS BIGINT) AS detailed, min(ts) AS first_ts, max(ts) AS last_ts FROM contests
UNION ALL SELECT 'lines', count(*), NULL, NULL, NULL FROM lineitem UNION ALL SELECT 'entities', count(*), NULL, NULL, NULL FROM customer
UNION ALL SELECT 'items', count(*), NULL, NULL, NULL FROM part""")
def table_status(spark, d):
    return ingest.table_status(
        {"contests": st.contests(spark, d), "lines": st.table(spark, d, "lineitem"), "entities": st.table(spark, d, "customer"),
         "items": st.table(spark, d, "part")}, {"contests": "ts"}, {"contests": F.col("detailed")})


@query("q_sink_result", """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def sink_result(spark, d):
    path = run_dir(spark, "result")
    dims.write_result(rounded(st.table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("orders"), F.sum("o_totalprice").alias("total")), 2), path, "json")
    return dims.read_result(spark, path, "json", "o_orderpriority string, orders long, total double")
