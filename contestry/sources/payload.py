"""Nested contest payloads kept as JSON text, and their flat child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAYLOAD_SCHEMA = (
    "contest_id long, duration long, first_blood_time long, "
    "players array<struct<player_slot: long, account_id: long, kills: long, deaths: long, "
    "item_uses: map<string, long>, killed_by: map<string, long>>>, "
    "objectives array<map<string, string>>, "
    "picks_bans array<struct<ord: long, team: long, is_pick: long, item_id: long>>"
)
SIDE_B_SLOT = 128
BOSS_KILL = "BOSS_KILL"
LOTUS_KEYS = ["lotus", "great_lotus", "greater_lotus"]


def pack(members: DataFrame) -> DataFrame:
    """Sample payloads: one JSON document per contest; (contest, slot) keys bound the arrays."""
    uses = F.create_map(F.lit("smoke"), "smokes", F.lit("lotus"), "lotuses", F.lit("great_lotus"), "courier_kills",
                        F.lit("bundle"), "madstones")
    player = F.struct(
        F.col("slot").alias("player_slot"),
        F.when(F.col("kills") % 6 == 0, None).when(F.col("kills") % 6 == 1, 0).otherwise(F.col("member_id")).alias("account_id"),
        "kills", "deaths", F.when(F.col("wards") != 1, uses).alias("item_uses"),
        F.create_map(F.lit("boss"), "roshan_kills", F.lit("fountain"), F.when(F.col("wards") == 2, 1).otherwise(0).cast("long")).alias("killed_by"))
    text = lambda c: c.cast("string")
    kind, slot, other = F.lit("type"), F.lit("player_slot"), F.lit("slot")
    objective = (
        F.when(F.col("kills") % 4 == 0, F.create_map(kind, F.lit(BOSS_KILL), other, text(F.col("slot"))))
        .when(F.col("kills") % 4 == 1, F.create_map(kind, F.lit(BOSS_KILL), slot, F.lit(None).cast("string"), other, text(F.col("slot"))))
        .otherwise(F.create_map(kind, F.when(F.col("deaths") == 0, F.lit("TOWER")).otherwise(F.lit(BOSS_KILL)),
                                slot, text(F.col("slot")), other, F.lit("7"))))
    draft = F.struct(F.col("slot").alias("ord"), F.col("side").alias("team"), "is_pick", "item_id")
    grouped = members.groupBy("contest_id").agg(
        F.max("duration").alias("duration"), F.array_sort(F.collect_list(player), _by_slot("player_slot")).alias("players"),
        F.collect_list(F.when(F.col("tormentors") == 1, objective)).alias("objectives"),
        F.array_sort(F.collect_list(draft)).alias("picks_bans"))
    return grouped.select("contest_id", F.to_json(
        F.struct("contest_id", "duration", "players", "objectives", "picks_bans"), {"ignoreNullFields": "false"}).alias("payload"))


def _by_slot(field):
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def parse(payloads: DataFrame) -> DataFrame:
    return payloads.select(F.from_json("payload", PAYLOAD_SCHEMA).alias("doc")).select("doc.*")


def players(docs: DataFrame) -> DataFrame:
    return docs.select("contest_id", F.explode("players").alias("p")).select(
        "contest_id", F.when(F.col("p.player_slot") % (2 * SIDE_B_SLOT) >= SIDE_B_SLOT, 1).otherwise(0).cast("long").alias("side"), "p.*")


def picks_bans(docs: DataFrame) -> DataFrame:
    return docs.select("contest_id", F.explode("picks_bans").alias("p")).select("contest_id", "p.*")


def event_counts(docs: DataFrame, kind: str = BOSS_KILL) -> DataFrame:
    """Objectives of one kind per slot; ``slot`` is read only where ``player_slot`` is absent, not where it is null."""
    o = docs.select("contest_id", F.explode("objectives").alias("o"))
    slot = F.when(F.map_contains_key("o", F.lit("player_slot")), F.col("o")["player_slot"]).otherwise(F.col("o")["slot"])
    return (o.where(F.col("o")["type"] == kind).select("contest_id", slot.cast("long").alias("slot"))
            .where(F.col("slot").isNotNull()).groupBy("contest_id", "slot").agg(F.count("*").alias("n")))


def map_sums(docs: DataFrame, flat_members: DataFrame) -> DataFrame:
    """Item counters per player; an absent or zero id is recovered from the flat table by slot."""
    use = lambda k: F.coalesce(F.col("item_uses")[k], F.lit(0))
    lotus = use(LOTUS_KEYS[0])
    for k in LOTUS_KEYS[1:]:
        lotus = lotus + use(k)
    p = players(docs).select(
        "contest_id", F.col("player_slot").alias("slot"), F.nullif("account_id", F.lit(0)).alias("account_id"),
        use("smoke").alias("smokes_used"), use("bundle").alias("bundles"), lotus.alias("lotus_uses"))
    flat = flat_members.select("contest_id", "slot", F.col("member_id").alias("_known"))
    return p.join(flat, ["contest_id", "slot"], "left").select(
        "contest_id", "slot", F.coalesce("account_id", "_known").alias("member_id"), "smokes_used", "bundles", "lotus_uses")


def any_flags(docs: DataFrame) -> DataFrame:
    """Whether any player was killed by the boss or at the fountain."""
    hit = lambda key: F.coalesce(F.exists("players", lambda p: F.coalesce(p["killed_by"][key], F.lit(0)) != 0), F.lit(False))
    return docs.select("contest_id", hit("boss").cast("long").alias("any_boss_death"), hit("fountain").cast("long").alias("fountain_death"))
