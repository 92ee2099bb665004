"""Joins around entities and members: enrichment, latest states and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def enrich_dims(members: DataFrame, dims: list[tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """Left joins to dimensions; ``defaults`` fill the columns of rows without a match."""
    out = members
    for dim, key, defaults in dims:
        out = out.join(dim, key, "left")
        for c, value in defaults.items():
            out = out.withColumn(c, F.coalesce(F.col(c), value))
    return out


def exclude_selected(candidates: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    return candidates.join(selected.select(*keys), keys, "left_anti")


def restrict_to(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(present.select(*keys), keys, "left_semi")


def set_algebra(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Per key: in both, only in the first, or only in the second (missing and extra keys)."""
    a = first.select(key).distinct().withColumn("_a", F.lit(1))
    b = second.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("_b").isNull(), "first").when(
        F.col("_a").isNull(), "second").otherwise("both").alias("where"))


def latest_state_asof(entities: DataFrame, elo_sides: DataFrame, glicko: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
    """Newest rating of each entity, how many contests it had, and the newest Glicko state.

    ``entities``: entity_id. Entities without a rating stay with nulls. Ties in time go to the
    higher contest id, for Glicko to the higher entity id of the alias set.
    """
    e = elo_sides if as_of is None else elo_sides.where(F.col("ts") <= as_of)
    order = F.struct("ts", "contest_id")
    latest = e.groupBy("entity_id").agg(
        F.max_by("after", order).alias("rating"), F.max("ts").alias("last_ts"), F.count("*").alias("contests"))
    out = entities.join(latest, "entity_id", "left").withColumn("contests", F.coalesce("contests", F.lit(0)))
    if glicko is not None:
        g = glicko if as_of is None else glicko.where(F.col("day") * 86_400 <= as_of)
        newest = g.groupBy("entity_id").agg(*[
            F.max_by(c, F.col("day")).alias(n) for c, n in
            (("rating_after", "glicko"), ("deviation_after", "deviation"), ("volatility_after", "volatility"))])
        out = out.join(newest, "entity_id", "left")
    return out


def name_key(name: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def resolve_names(registered: DataFrame, candidates: DataFrame) -> DataFrame:
    """Member of each registered name: the override if it exists, else the best equal handle or alias.

    Best: same entity, then newest contest, then most contests, then lowest id. Only the best
    candidate per (name, entity) and per name can win, so a common name costs one row each.

    ``registered``: reg_id, entity_id, name, override_id; ``candidates``: member_id, handle, alias,
    entity_id, last_ts, contests.
    """
    order = F.struct(F.coalesce("last_ts", F.lit(0)), F.coalesce("contests", F.lit(0)), -F.col("member_id"))
    named = candidates.select("member_id", "entity_id", "last_ts", "contests", F.explode(F.array_distinct(
        F.filter(F.array(name_key(F.col("handle")), name_key(F.col("alias"))), lambda k: F.length(k) > 0))).alias("key"))
    per_entity = named.groupBy("key", "entity_id").agg(F.max_by("member_id", order).alias("same_entity"))
    per_name = named.groupBy("key").agg(F.max_by("member_id", order).alias("any_entity"))
    known = candidates.select(F.col("member_id").alias("override_id"), F.col("member_id").alias("forced")).distinct()
    keyed = registered.withColumn("key", name_key(F.col("name")))
    j = (keyed.join(per_name, "key", "left").join(per_entity, ["key", "entity_id"], "left").join(known, "override_id", "left"))
    return j.select("reg_id", "entity_id", "name", F.coalesce("forced", "same_entity", "any_entity").alias("member_id")).where(
        F.col("member_id").isNotNull())
