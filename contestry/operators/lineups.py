"""Member sets: keys, distinct counts and how often members, pairs and whole sets met before.

A side holds few members because (contest, slot) is the key of the member table, so the per-side
lists built here are bounded; everything across contests is a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestry.operators import hot
from contestry.operators.chronology import ORDER


def lineup_key(member_ids: Column) -> Column:
    """First 20 hex digits of sha256 over the numerically sorted ids joined by commas."""
    joined = F.array_join(F.transform(F.array_sort(member_ids), lambda v: v.cast("string")), ",")
    return F.substring(F.sha2(joined, 256), 1, 20)


def lineup_sets(members: DataFrame, size: int) -> DataFrame:
    """(contest, side) with exactly ``size`` distinct members and a known entity."""
    return (
        members.where(F.col("member_id").isNotNull() & (F.coalesce(F.col("entity_id"), F.lit(0)) > 0))
        .groupBy("contest_id", "side")
        .agg(F.max("ts").alias("ts"), F.max("entity_id").alias("entity_id"),
             F.array_sort(F.collect_set("member_id")).alias("member_ids"))
        .where(F.size("member_ids") == size)
        .withColumn("lineup", lineup_key(F.col("member_ids")))
    )


def duels(members: DataFrame, size: int) -> DataFrame:
    """One row per contest whose two sides both have exactly ``size`` distinct members."""
    def of(side, column):
        return F.when(F.col("side") == side, F.col(column))

    return (
        members.where(F.col("member_id").isNotNull())
        .groupBy("contest_id")
        .agg(F.max("ts").alias("ts"), F.max("pool").alias("pool"), F.max("a_win").alias("a_win"),
             F.max(of(0, "entity_id")).alias("a_id"), F.max(of(1, "entity_id")).alias("b_id"),
             F.array_sort(F.collect_set(of(0, "member_id"))).alias("a_keys"),
             F.array_sort(F.collect_set(of(1, "member_id"))).alias("b_keys"))
        .where((F.size("a_keys") == size) & (F.size("b_keys") == size))
    )


def sides(duel_rows: DataFrame) -> DataFrame:
    def view(n, own):
        return F.struct(F.lit(n).cast("long").alias("side"), F.col(f"{own}_id").alias("entity_id"),
                        F.col(f"{own}_keys").alias("keys"))
    return duel_rows.select("contest_id", "ts", F.explode(F.array(view(0, "a"), view(1, "b"))).alias("v")).select(
        "contest_id", "ts", "v.*")


def previous_ts(rows: DataFrame, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    return hot.previous_value(rows, ["entity_id"], ORDER, "ts", "prev_ts", hot_rows)


def member_experience(side_rows: DataFrame, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """Mean earlier contests per member, and members with fewer than five."""
    seats = side_rows.select("contest_id", "ts", "side", F.explode("keys").alias("member_id"))
    games = hot.prefix_sums(seats, ["member_id"], ORDER, {"games": F.lit(1)}, hot_rows)
    return games.groupBy("contest_id", "side").agg(
        F.avg("games").alias("mean_games"), F.sum((F.col("games") < 5).cast("long")).alias("new_members"))


def lineup_experience(side_rows: DataFrame, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    keyed = side_rows.select("contest_id", "ts", "side", lineup_key(F.col("keys")).alias("lineup"))
    played = hot.prefix_sums(keyed, ["lineup"], [*ORDER, "side"], {"lineup_games": F.lit(1)}, hot_rows)
    return played.select("contest_id", "side", F.col("lineup_games").cast("long").alias("lineup_games"))


def pair_experience(side_rows: DataFrame, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """Mean over the pairs of a side of their earlier contests together."""
    pairs = F.flatten(F.transform("keys", lambda x, i: F.transform(
        F.slice(F.col("keys"), i + 2, F.size("keys")), lambda y: F.struct(x.alias("lo"), y.alias("hi")))))
    rows = side_rows.select("contest_id", "ts", "side", F.explode(pairs).alias("p")).select("contest_id", "ts", "side", "p.*")
    games = hot.prefix_sums(rows, ["lo", "hi"], [*ORDER, "side"], {"games": F.lit(1)}, hot_rows)
    return games.groupBy("contest_id", "side").agg(F.avg("games").alias("pair_games"))


def retained_members(side_rows: DataFrame, hot_rows: int = hot.HOT_ROWS) -> DataFrame:
    """Members shared with the entity's previous lineup.

    An entity on both sides of a contest (possible after aliasing) keeps side 1's lineup.
    """
    per_contest = side_rows.groupBy("entity_id", "contest_id", "ts").agg(
        F.max_by("keys", "side").alias("final"), F.collect_list(F.struct("side", "keys")).alias("both"))
    p = hot.previous_value(per_contest, ["entity_id"], ORDER, "final", "previous", hot_rows)
    return p.select("contest_id", F.explode("both").alias("v"), "previous").select(
        "contest_id", F.col("v.side").alias("side"),
        F.coalesce(F.size(F.array_intersect("v.keys", "previous")), F.lit(0)).cast("long").alias("retained"))
