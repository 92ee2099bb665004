"""Series results: standings, data checks, records, form, outcome shares and partial counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from contestry.functions import rates


def series_results(contests: DataFrame) -> DataFrame:
    """Contests of a series collapsed to (pool, series_id, lo, hi, wins of each, winner, status)."""
    rows = contests.where(F.coalesce("series_id", F.lit(0)) != 0).select(
        "pool", "series_id", F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"),
        F.when(F.col("a_id") <= F.col("b_id"), F.col("a_win")).otherwise(1 - F.col("a_win")).alias("w"))
    s = rows.groupBy("pool", "series_id", "lo", "hi").agg(F.sum("w").alias("lo_wins"), F.sum(1 - F.col("w")).alias("hi_wins"))
    return s.withColumn("winner", F.when(F.col("lo_wins") > F.col("hi_wins"), F.col("lo")).when(
        F.col("hi_wins") > F.col("lo_wins"), F.col("hi"))).withColumn(
        "status", F.when(F.col("winner").isNull(), "live").otherwise("complete"))


def _both(series: DataFrame, *keep: str) -> DataFrame:
    def view(own, other):
        return F.struct(F.col(own).alias("entity_id"), F.col(other).alias("opponent_id"),
                        (F.col("winner") == F.col(own)).cast("long").alias("won"))
    return series.select(*keep, F.explode(F.array(view("lo", "hi"), view("hi", "lo"))).alias("v")).select(*keep, "v.*")


def standings(series: DataFrame, ratings: DataFrame) -> DataFrame:
    """Wins, losses and opponents' wins per entity; rank by wins, losses, opponents' wins, rating.

    Entities without a rating have the start rating.
    """
    sides = _both(series.where("status = 'complete'"), "pool")
    own = sides.groupBy("pool", "entity_id").agg(F.sum("won").alias("wins"), F.sum(1 - F.col("won")).alias("losses"))
    met = sides.groupBy("pool", "entity_id", "opponent_id").agg(F.count("*").alias("times"))
    rival = own.select("pool", F.col("entity_id").alias("opponent_id"), F.col("wins").alias("_w"))
    strength = met.join(rival, ["pool", "opponent_id"]).groupBy("pool", "entity_id").agg(
        F.sum(F.col("_w") * F.col("times")).alias("opponent_wins"))
    # One row per entity of an event pool: the rank orders a league table, not the contests.
    w = Window.partitionBy("pool").orderBy(F.desc("wins"), "losses", F.desc("opponent_wins"), F.desc("rating"), "entity_id")
    rated = own.join(strength, ["pool", "entity_id"]).join(ratings, "entity_id", "left").withColumn(
        "rating", F.coalesce("rating", F.lit(rates.START_RATING)))
    return rated.withColumn("rank", F.row_number().over(w))


def series_checks(series: DataFrame, entities: DataFrame, group: Column, opponent_group: Column) -> DataFrame:
    """One row per violated rule and key. ``series`` also has ``round``; groups are expressions on lo and hi."""
    key = F.col("series_id").cast("string")

    def rule(name, rows, k):
        return rows.select(F.lit(name).alias("rule"), k.alias("key"))

    winner = series.where((F.col("status") == "complete") & (
        F.col("winner").isNull() | ((F.col("winner") != F.col("lo")) & (F.col("winner") != F.col("hi")))))
    status = series.where(~F.col("status").isin("complete", "live", "scheduled"))
    sides = series.select("series_id", "pool", "round", F.explode(F.array("lo", "hi")).alias("entity_id"))
    unknown = sides.join(entities.select("entity_id"), "entity_id", "left_anti")
    same = series.where(F.col("lo") == F.col("hi"))
    twice = sides.groupBy("round", "entity_id").agg(F.count("*").alias("n")).where("n > 1")
    relation = series.where(((F.col("round") <= 3) & (group != opponent_group)) | ((F.col("round") == 4) & (group == opponent_group)))
    games = sides.groupBy("pool", "entity_id").agg(F.count("*").alias("n")).groupBy("pool").agg(
        F.min("n").alias("lo_n"), F.max("n").alias("hi_n")).where("lo_n <> hi_n")
    parts = [
        rule("winner", winner, key), rule("status", status, key), rule("unknown_entity", unknown, F.col("entity_id").cast("string")),
        rule("same_entity", same, key),
        rule("twice_in_round", twice, F.concat_ws("-", F.col("round").cast("string"), F.col("entity_id").cast("string"))),
        rule("relation", relation, key), rule("uneven_games", games, F.col("pool").cast("string"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_record(side_rows: DataFrame, *group: str) -> DataFrame:
    return side_rows.groupBy(*group, "entity_id").agg(F.sum("won").alias("wins"), F.sum(1 - F.col("won")).alias("losses"))


def form_rating(records: DataFrame, season_weight: float = 0.6) -> DataFrame:
    """Season rating blended with an event-form rating centred on the mean rating."""
    if not 0.0 <= season_weight <= 1.0:
        raise ValueError("season_weight must be between zero and one")
    center = records.agg(F.avg("rating")).scalar()
    form = rates.form_rating(center, F.col("wins"), F.col("losses"))
    return records.withColumn("form", form).withColumn(
        "effective", season_weight * F.col("rating") + (1 - season_weight) * F.col("form"))


def pairwise_probability(ratings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contest, best-of-three and best-of-five chances for the ordered pairs asked for.

    Entities without a rating have the start rating and deviation.
    """
    def side(s):
        return ratings.select(F.col("entity_id").alias(f"{s}_id"), F.col("rating").alias(f"{s}_r"), F.col("deviation").alias(f"{s}_d"))
    j = pairs.where(F.col("a_id") != F.col("b_id")).join(side("a"), "a_id", "left").join(side("b"), "b_id", "left").na.fill(
        {"a_r": rates.START_RATING, "b_r": rates.START_RATING, "a_d": rates.START_DEVIATION, "b_d": rates.START_DEVIATION})
    p = rates.glicko_expected(F.col("a_r"), F.col("b_r"), F.col("a_d"), F.col("b_d"))
    return j.select("a_id", "b_id", p.alias("p")).select(
        "a_id", "b_id", "p", rates.series_probability(F.col("p"), 3).alias("bo3"), rates.series_probability(F.col("p"), 5).alias("bo5"))


def outcome_marginals(outcomes: DataFrame) -> DataFrame:
    """Share of trials in which an entity has a category, from recorded (trial, category, entity) rows."""
    trials = outcomes.agg(F.countDistinct("trial")).scalar()
    return outcomes.groupBy("category", "entity_id").agg(F.count("*").alias("hits")).withColumn(
        "probability", F.col("hits") / trials)


def set_frequency(sets: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Most frequent member sets with probability, rank and the number of distinct sets."""
    counts = sets.groupBy(key).agg(F.count("*").alias("n"))
    total, distinct = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    top = counts.orderBy(F.desc("n"), key).limit(limit)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), key)
    return top.select(key, "n", (F.col("n") / total).alias("probability"), F.row_number().over(w).alias("rank"), distinct.alias("distinct_sets"))


def merge_partials(partials: list[DataFrame], keys: list[str], counter: str = "n") -> DataFrame:
    """Running totals from stored partial counters."""
    merged = partials[0]
    for p in partials[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy(*keys).agg(F.sum(counter).alias(counter))


def coalesced_sort(rows: DataFrame, first: str, second: str, key: str, limit: int | None = None) -> DataFrame:
    """By the first rating, else the second, else -1, highest first."""
    ordered = rows.withColumn("sort_rating", F.coalesce(first, second, F.lit(-1.0))).orderBy(F.desc("sort_rating"), key)
    return ordered if limit is None else ordered.limit(limit)


#: log2 of the registers of a distinct sketch: a relative standard error of 1.6 %.
SKETCH_BITS = 12


def distinct_sketches(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mergeable distinct sketches per key, one binary column each, with the number of rows; to be stored beside partial counts."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.hll_sketch_agg(c, SKETCH_BITS).alias(c) for c in columns])


def merge_sketches(partials: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Approximate distinct counts from stored sketches, without the rows they were made of."""
    merged = partials[0]
    for p in partials[1:]:
        merged = merged.unionByName(p)
    united = merged.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.hll_union_agg(c).alias(c) for c in columns])
    return united.select(*keys, "n", *[F.hll_sketch_estimate(c).alias(c) for c in columns])
