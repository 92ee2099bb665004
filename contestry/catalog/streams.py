"""Streaming jobs over landed files of the sample tables; each must equal its batch result."""

from pyspark.sql import functions as F

from contestry.catalog.chronology import SL
from contestry.catalog.ingestion import VERSIONS, _versions
from contestry.catalog.registry import query, rounded
from contestry.operators import chronology as ch
from contestry.sources import sample_tables as st
from contestry.streaming import jobs

DELIVERIES = 3


@query("q_stream_upsert", f"""WITH {st.SQL_CONTESTS}, {VERSIONS}, d AS (SELECT contest_id, detailed, payload FROM records
  QUALIFY row_number() OVER (PARTITION BY contest_id ORDER BY detailed DESC, version DESC) = 1),
m AS (SELECT contest_id, arg_max(ts, version) AS ts, arg_max(league_id, version) FILTER (WHERE league_id IS NOT NULL) AS league_id,
  arg_max(series_id, version) FILTER (WHERE series_id IS NOT NULL) AS series_id, arg_max(duration, version) FILTER (WHERE duration IS NOT NULL) AS duration,
  arg_max(a_win, version) AS a_win FROM records GROUP BY contest_id)
SELECT contest_id, ts, league_id, series_id, duration, a_win, detailed, payload FROM m JOIN d USING (contest_id)""")
def stream_upsert(spark, d):
    landing = jobs.fresh_base(spark, "versions")
    records = _versions(spark, d)
    for n, part in enumerate((records.where("version = 2"), records.where("version = 1"), records.where("version = 3"), records.where("version = 2"))):
        part.write.mode("append").parquet(f"{landing}")
    stream = jobs.read_landed(spark, landing, files_per_batch=2)
    out = jobs.upsert_contests(stream, jobs.fresh_base(spark, "upsert"))
    return out.select("contest_id", "ts", "league_id", "series_id", "duration", "a_win", "detailed", "payload")


@query("q_incremental_index", f"""WITH {st.SQL_CONTESTS}, {VERSIONS} SELECT contest_id, arg_max(ts, version) AS ts, arg_max(a_win, version) AS a_win FROM records
WHERE ts >= 883612800 GROUP BY contest_id""")
def incremental_index(spark, d):
    landing = jobs.fresh_base(spark, "index")
    _versions(spark, d).write.parquet(landing)
    out = jobs.incremental_index(jobs.read_landed(spark, landing, 2), jobs.fresh_base(spark, "index-run"), 883612800)
    return out.select("contest_id", "ts", "a_win")


@query("q_stream_counts", f"WITH {st.SQL_CONTESTS} SELECT tier, era, count(*) AS n FROM contests GROUP BY 1, 2")
def stream_counts(spark, d):
    run = lambda stream, base: jobs.stream_counts(stream, base, ["tier", "era"])
    return jobs.catch_up(st.contests(spark, d), jobs.fresh_base(spark, "counts"), run, DELIVERIES)


@query("q_stream_stop", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_stop(spark, d):
    """A finite run straight over the events table."""
    stream = jobs.read_landed(spark, d, glob="events.parquet")
    return jobs.stream_counts(stream, jobs.fresh_base(spark, "events"), ["event_type"])


FORM_SQL = f"""WITH {SL}, w AS (SELECT contest_id, side, entity_id, ts, won, row_number() OVER o - 1 AS games, coalesce(sum(won) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wins,
  round(coalesce(least(30.0, (ts - lag(ts) OVER o) / 86400.0), 30.0), 6) AS rest_days, list(CAST(won AS DOUBLE)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h,
  row_number() OVER o AS rn, row_number() OVER (PARTITION BY entity_id, won ORDER BY ts, contest_id) AS rw FROM sl WINDOW o AS (PARTITION BY entity_id ORDER BY ts, contest_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY entity_id, won, rn - rw ORDER BY ts, contest_id) * (2 * won - 1) AS after FROM w)
SELECT contest_id, side, entity_id, games, CAST(wins AS BIGINT) AS wins, round(list_reduce(list_prepend(CAST(0.5 AS DOUBLE), coalesce(h, [])), lambda acc, v: 0.15 * v + 0.85 * acc), 7) AS ema,
  coalesce(lag(after) OVER (PARTITION BY entity_id ORDER BY ts, contest_id), 0) AS streak, rest_days"""


@query("q_stream_entity_state", FORM_SQL + ", 0 AS late FROM i")
def stream_entity_state(spark, d):
    run = lambda stream, base: jobs.stream_entity_state(ch.side_long(ch.valid_contests(stream)), base)
    out = jobs.catch_up(st.contests(spark, d), jobs.fresh_base(spark, "form"), run, DELIVERIES)
    return _form_rows(out, "late")


@query("q_stream_late_rows", FORM_SQL + " FROM i")
def stream_late_rows(spark, d):
    """A third of the contests arrives after all others: their entities are rated again from the snapshots before them."""
    base = jobs.fresh_base(spark, "late-form")
    landing, contests = f"{base}/landing", st.contests(spark, d)
    for part in (contests.where("contest_id % 3 > 0"), contests.where("contest_id % 3 = 0")):
        part.write.mode("append").parquet(landing)
        out = jobs.stream_entity_state(ch.side_long(ch.valid_contests(jobs.read_landed(spark, landing))), base)
    return _form_rows(out)


def _form_rows(out, *more):
    return rounded(out.select("contest_id", "side", "entity_id", "games", "wins", F.round("ema", 7).alias("ema"), "streak", F.round("rest_days", 6).alias("rest_days"), *more), 7)


@query("q_stream_periods", f"""WITH {SL} SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, entity_id, count(*) AS contests, CAST(sum(won) AS BIGINT) AS wins FROM sl
WHERE (floor(ts / 86400) + 1) * 86400 <= (SELECT max(ts) FROM sl) - 86400 GROUP BY 1, 2""")
def stream_periods(spark, d):
    run = lambda stream, base: jobs.stream_periods(ch.side_long(ch.valid_contests(stream)), base)
    return jobs.catch_up(st.contests(spark, d), jobs.fresh_base(spark, "periods"), run, DELIVERIES)


@query("q_stream_period_rating")
def stream_period_rating(spark, d):
    out = jobs.catch_up(st.contests(spark, d), jobs.fresh_base(spark, "rating"), jobs.stream_period_rating, DELIVERIES)
    return rounded(out.select("day", "entity_id", "rating_after", "deviation_after"))
