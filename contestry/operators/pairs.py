"""Item pair statistics and draft recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestry.functions.rates import smoothed_rate


def drafts(picks_bans: DataFrame, size: int) -> DataFrame:
    """One row per contest with exactly ``size`` picks on both sides; missing era becomes 0.

    (contest, slot) is the key of the input, so the lists are short. One shuffle by contest serves
    matchups, synergies and per-entity counts.
    """
    def items(side, pick):
        return F.collect_list(F.when((F.col("side") == side) & (F.col("is_pick") == pick), F.col("item_id")))

    def of(side, column):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    return (
        picks_bans.groupBy("contest_id")
        .agg(F.coalesce(F.max("era"), F.lit(0)).alias("era"), of(0, "entity_id").alias("a_id"), of(1, "entity_id").alias("b_id"),
             F.coalesce(of(0, "won"), 1 - of(1, "won")).alias("a_win"),
             items(0, 1).alias("a_items"), items(1, 1).alias("b_items"), items(0, 0).alias("a_bans"), items(1, 0).alias("b_bans"))
        .where((F.size("a_items") == size) & (F.size("b_items") == size))
    )


def _pairs(left: str, right: str, won: Column) -> Column:
    return F.flatten(F.transform(left, lambda x: F.transform(
        right, lambda y: F.struct(x.alias("item_id"), y.alias("other_id"), won.alias("won")))))


def item_matchups(draft_rows: DataFrame) -> DataFrame:
    """(era, item, opposing item) -> games, wins; both directions."""
    both = F.concat(_pairs("a_items", "b_items", F.col("a_win")), _pairs("b_items", "a_items", 1 - F.col("a_win")))
    return (draft_rows.select("era", F.explode(both).alias("p"))
            .groupBy("era", F.col("p.item_id").alias("item_id"), F.col("p.other_id").alias("opponent_id"))
            .agg(F.count("*").alias("games"), F.sum("p.won").alias("wins")))


def item_synergies(draft_rows: DataFrame) -> DataFrame:
    """(era, item, allied item) -> games, wins over pairs of different positions on one side."""
    def same_side(items, won):
        return F.flatten(F.transform(items, lambda x, i: F.transform(
            F.filter(F.transform(items, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda v: v["j"] != i),
            lambda v: F.struct(x.alias("item_id"), v["y"].alias("other_id"), won.alias("won")))))

    both = F.concat(same_side("a_items", F.col("a_win")), same_side("b_items", 1 - F.col("a_win")))
    return (draft_rows.select("era", F.explode(both).alias("p"))
            .groupBy("era", F.col("p.item_id").alias("item_id"), F.col("p.other_id").alias("ally_id"))
            .agg(F.count("*").alias("games"), F.sum("p.won").alias("wins")))


def entity_item_stats(draft_rows: DataFrame) -> DataFrame:
    """(era, entity, item) -> picks, wins, bans, from contests that pass the size rule."""
    def rows(items, entity, picks, won, bans):
        return F.transform(items, lambda x: F.struct(
            F.col(entity).alias("entity_id"), x.alias("item_id"), F.lit(picks).cast("long").alias("picks"),
            won.cast("long").alias("wins"), F.lit(bans).cast("long").alias("bans")))

    none = F.lit(0)
    every = F.concat(
        rows("a_items", "a_id", 1, F.col("a_win"), 0), rows("b_items", "b_id", 1, 1 - F.col("a_win"), 0),
        rows("a_bans", "a_id", 0, none, 1), rows("b_bans", "b_id", 0, none, 1))
    return (draft_rows.select("era", F.explode(every).alias("v")).where(F.col("v.entity_id").isNotNull())
            .groupBy("era", "v.entity_id", "v.item_id")
            .agg(F.sum("v.picks").alias("picks"), F.sum("v.wins").alias("wins"), F.sum("v.bans").alias("bans")))


def item_results(draft_rows: DataFrame) -> DataFrame:
    """(era, item) -> games, wins over the picks."""
    def rows(items, won):
        return F.transform(items, lambda x: F.struct(x.alias("item_id"), won.alias("won")))
    both = F.concat(rows("a_items", F.col("a_win")), rows("b_items", 1 - F.col("a_win")))
    return (draft_rows.select("era", F.explode(both).alias("v")).groupBy("era", "v.item_id")
            .agg(F.count("*").alias("games"), F.sum("v.won").alias("wins")))


def counter_recommend(requests: DataFrame, results: DataFrame, matchups: DataFrame, synergies: DataFrame, limit: int = 10) -> DataFrame:
    """Top ``limit`` items for each draft request (era, enemies, allies), for any number of requests.

    Matchups average over the enemies that have rows; synergy counts only when every ally has one.
    Era 0 (unknown) has no candidates.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    req = requests.where(F.size("enemies") > 0).select("era", "enemies", "allies").distinct()
    candidates = results.where((F.col("games") >= 3) & (F.col("era") != 0)).select(
        "era", "item_id", F.col("games").alias("meta_games"), smoothed_rate(F.col("wins"), F.col("games"), 20.0).alias("meta_rate"))
    # Matchup and synergy rows of a candidate are carried as one map per (era, item): at most one
    # entry per item, so the look-ups need no join per enemy.
    by_enemy = matchups.groupBy("era", "item_id").agg(F.map_from_entries(F.collect_list(
        F.struct("opponent_id", F.struct("games", smoothed_rate(F.col("wins"), F.col("games"), 8.0).alias("rate"))))).alias("versus"))
    by_ally = synergies.groupBy("era", "item_id").agg(F.map_from_entries(F.collect_list(
        F.struct("ally_id", smoothed_rate(F.col("wins"), F.col("games"), 8.0).alias("rate")))).alias("beside"))
    pool = candidates.join(by_enemy, ["era", "item_id"], "left").join(by_ally, ["era", "item_id"], "left")
    j = req.join(pool, "era").where(
        ~F.array_contains("enemies", F.col("item_id")) & ~F.array_contains("allies", F.col("item_id")))
    found = F.filter(F.transform("enemies", lambda e: F.col("versus")[e]), lambda v: v.isNotNull())
    beside = F.filter(F.transform("allies", lambda a: F.col("beside")[a]), lambda v: v.isNotNull())
    total = lambda arr, get, zero: F.aggregate(arr, F.lit(zero).cast("long" if zero == 0 and isinstance(zero, int) else "double"), lambda acc, v: acc + get(v))
    j = j.select("era", "enemies", "allies", "item_id", "meta_games", "meta_rate",
                 F.coalesce(found, F.array()).alias("found"), F.coalesce(beside, F.array()).alias("with"))
    j = j.withColumn("matchup_games", total("found", lambda v: v["games"], 0)).withColumn(
        "matchup_rate", F.when(F.size("found") > 0, total("found", lambda v: v["rate"], 0.0) / F.size("found")).otherwise(0.5)
    ).withColumn("synergy_rate", F.when(
        (F.size("allies") > 0) & (F.size("with") == F.size("allies")),
        total("with", lambda v: v, 0.0) / F.size("allies")).otherwise(0.5))
    confidence = 1 - F.exp(-F.col("matchup_games") / 30.0)
    j = j.withColumn("score", 0.60 * (0.5 + (F.col("matchup_rate") - 0.5) * confidence)
                     + 0.25 * F.col("meta_rate") + 0.15 * F.col("synergy_rate"))
    w = Window.partitionBy("era", "enemies", "allies").orderBy(
        F.round("score", 9).desc(), F.desc("matchup_games"), "item_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(
        "era", "enemies", "allies", "rank", "item_id", "score", "matchup_rate", "matchup_games",
        (F.size("found") / F.size("enemies")).alias("enemy_coverage"), "meta_rate", "meta_games", "synergy_rate")


def beta_posterior_rank(snapshot: DataFrame, minimum_picks: int = 100, limit: int = 15, prior_games: float = 500.0) -> DataFrame:
    """Per bracket of one snapshot: items by the lower bound of the beta posterior of their win rate.

    The prior mean comes from the whole bracket, before the minimum applies.
    """
    totals = snapshot.groupBy("bracket").agg(F.sum("picks").alias("_p"), F.sum("wins").alias("_w")).where("_p > 0")
    j = snapshot.join(totals, "bracket").where(F.col("picks") >= minimum_picks)
    alpha = F.col("wins") + F.col("_w") / F.col("_p") * prior_games
    beta = F.col("picks") - F.col("wins") + (1 - F.col("_w") / F.col("_p")) * prior_games
    j = j.withColumn("_a", alpha).withColumn("_b", beta).withColumn("_n", F.col("_a") + F.col("_b"))
    mean = F.col("_a") / F.col("_n")
    margin = 1.96 * F.sqrt(F.col("_a") * F.col("_b") / (F.col("_n") * F.col("_n") * (F.col("_n") + 1)))
    out = j.select(
        "bracket", "item_id", "picks", "wins", (F.col("wins") / F.col("picks")).alias("raw_rate"), mean.alias("posterior_rate"),
        F.greatest(F.lit(0.0), mean - margin).alias("lower_95"), F.least(F.lit(1.0), mean + margin).alias("upper_95"),
        (F.col("picks") / F.col("_p")).alias("share"))
    w = Window.partitionBy("bracket").orderBy(F.round("lower_95", 9).desc(), F.desc("picks"), "item_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rank_pivot(snapshot: DataFrame, top: int = 5) -> DataFrame:
    """Win rate per bracket of the ``top`` most picked items; one column per popularity rank."""
    popular = snapshot.groupBy("item_id").agg(F.sum("picks").alias("_p")).orderBy(F.desc("_p"), "item_id").limit(top)
    ranked = popular.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_p"), "item_id")))
    j = snapshot.join(F.broadcast(ranked), "item_id")
    return j.groupBy("bracket").agg(*[
        F.max(F.when((F.col("_rank") == r) & (F.col("picks") > 0), F.col("wins") / F.col("picks"))).alias(f"top_{r}")
        for r in range(1, top + 1)])
