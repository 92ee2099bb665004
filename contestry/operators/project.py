"""Projections, predicates and dimension look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def alias_map(lists: DataFrame) -> DataFrame:
    """(alias_id, canonical_id) from rows whose ``source_ids`` is a ``|`` list; the first id is canonical."""
    ids = F.transform(F.split("source_ids", r"\|"), lambda v: v.cast("long"))
    return lists.select(ids[0].alias("canonical_id"), F.explode(ids).alias("alias_id")).groupBy("alias_id").agg(
        F.max("canonical_id").alias("canonical_id"))


def canonical_ids(df: DataFrame, aliases: DataFrame, *columns: str) -> DataFrame:
    """Replace each id by its canonical one; ids without an alias stay.

    No broadcast hint: a curated list is broadcast by size at run time, a huge one is shuffled.
    """
    out = df
    for c in columns:
        m = aliases.select(F.col("alias_id").alias(f"_{c}"), F.col("canonical_id").alias("_canonical"))
        out = out.join(m, out[c] == m[f"_{c}"], "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical", f"_{c}")
    return out


PER_MINUTE = {
    "kills": "kills_per_min", "deaths": "deaths_per_min", "assists": "assists_per_min",
    "last_hits": "last_hits_per_min", "denies": "denies_per_min", "stuns": "stuns_per_min",
}


def per_minute(value: Column, duration: Column) -> Column:
    return F.when(duration > 0, value * 60.0 / duration)


def training_view(members: DataFrame, contests: DataFrame, member_dim: DataFrame, leagues: DataFrame) -> DataFrame:
    """Member facts with contest, member and league context; missing tier is professional."""
    c = contests.select("contest_id", "league_id", "b_id", "a_id", "first_blood_time")
    j = members.join(c, "contest_id").join(member_dim, "member_id", "left").join(leagues, "league_id", "left")
    return j.select(
        "contest_id", "ts", "era", "league_id", F.coalesce("league_tier", F.lit("professional")).alias("tier"),
        "side", "slot", "member_id", "handle", "entity_id",
        F.when(F.col("side") == 0, F.col("b_id")).otherwise(F.col("a_id")).alias("opponent_id"), "won", "item_id",
        *[per_minute(F.col(c), F.col("duration")).alias(n) for c, n in PER_MINUTE.items()])


STAT_COLUMNS = [
    "kills", "deaths", "last_hits", "denies", "gold_per_min", "madstones", "tower_kills", "wards", "camps_stacked",
    "runes", "watchers", "lotuses", "roshan_kills", "teamfight", "stuns", "tormentors", "courier_kills",
    "first_blood", "smokes", "xp_per_min",
]


def stat_defaults(members: DataFrame, *keep: str) -> DataFrame:
    """Unknown stats count as zero, and last hits plus denies become creeps."""
    filled = members.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in STAT_COLUMNS])
    return filled.withColumn("creeps", F.col("last_hits") + F.col("denies")).drop("last_hits", "denies")


def infer_role(code: Column, safe: Column, mid: Column, off: Column, gpm: Column, wards: Column, last_hits: Column) -> Column:
    share = mid / F.greatest(safe + mid + off, F.lit(1))
    return (
        F.when(code == 1, "Core").when(code == 2, "Support")
        .when((share >= 0.55) & (gpm >= 450), "Mid")
        .when((wards >= 5) | ((gpm < 430) & (last_hits < 160)), "Support")
        .otherwise("Core")
    )


def position_label(role: Column, safe: Column, off: Column, registered: Column) -> Column:
    number = (
        F.when(registered.isNotNull(), registered.cast("int")).when(role == "Mid", 2)
        .when((role == "Core") & (safe >= off), 1).when(role == "Core", 3)
        .when(off > safe, 4).otherwise(5)
    )
    return F.concat(F.lit("Position "), number.cast("string"))


def contest_flags(contests: DataFrame) -> DataFrame:
    """First-blood and duration flags; unknown first blood stays null, unknown duration is zero."""
    duration = F.coalesce("duration", F.lit(0))
    return contests.select(
        "contest_id",
        (F.col("first_blood_time") == 0).cast("long").alias("blood_at_start"),
        (F.col("first_blood_time") > 600).cast("long").alias("blood_after_ten"),
        (duration < 1500).cast("long").alias("under_25_minutes"),
        (duration % 10 == 8).cast("long").alias("ends_in_8"))


def day_start(date: Column) -> Column:
    """Epoch seconds of a UTC day given as a date or ``YYYY-MM-DD``."""
    return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("long") * 86_400


def in_phase(ts: Column, start: Column, end: Column) -> Column:
    """Half-open: from the start of the first day to the end of the last one."""
    return (ts >= day_start(start)) & (ts < day_start(end) + 86_400)


def classify_in_window(contests: DataFrame, events: DataFrame) -> DataFrame:
    """Contests of a listed event with a flag for being inside its venue dates; none is dropped."""
    j = contests.join(events, ["league_id", "era"])
    return j.select("contest_id", "league_id", "era", "ts", in_phase(
        F.col("ts"), F.col("event_start"), F.col("event_end")).cast("long").alias("venue_phase"))


def asset_url(prefix: str, path: Column) -> Column:
    return F.when(F.length(path) > 0, F.concat(F.lit(prefix), F.regexp_replace(path, r"\?+$", "")))


def pattern_years(df: DataFrame, column: str, pattern: str, first: int, last: int) -> DataFrame:
    """Rows whose whole name matches ``pattern`` (one group, a year) with the year in range."""
    year = F.expr(f"try_cast(regexp_extract({column}, '(?i)^{pattern}$', 1) AS INT)")
    return df.withColumn("year", year).where(F.col("year").between(first, last))
