"""The leak-free feature tables used by the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestry.operators import chronology as ch, hot, lineups, ratings
from contestry.session import materialize, run_dir

FEATURES = [
    "elo_difference", "glicko_difference", "a_deviation", "b_deviation", "deviation_difference",
    "log_games_difference", "log_minimum_games", "recent_5_difference", "recent_10_difference", "ema_difference",
    "era_rate_difference", "log_era_games_difference", "a_rest_days", "b_rest_days", "activity_difference",
    "streak_difference", "h2h_advantage", "log_pair_games", "series_difference", "series_played", "side_rate",
    "is_premium", "is_professional", "era",
]
LINEUP_FEATURES = [
    "member_rating_difference", "log_member_games_difference", "log_minimum_member_games", "log_lineup_games_difference",
    "log_lineup_games_total", "pair_games_difference", "retained_difference", "new_members_difference",
]


def by_side(rows: DataFrame, *columns: str) -> DataFrame:
    """Pivot (contest, side) rows to one row per contest with a_ and b_ columns."""
    return rows.groupBy("contest_id").agg(*[
        F.max(F.when(F.col("side") == n, F.col(c))).alias(f"{s}_{c}") for c in columns for n, s in ((0, "a"), (1, "b"))])


def _diff(c: str) -> Column:
    return F.col(f"a_{c}") - F.col(f"b_{c}")


def _log_diff(c: str) -> Column:
    return F.log1p(F.col(f"a_{c}")) - F.log1p(F.col(f"b_{c}"))


def join_feature_tables(elo: DataFrame, glicko: DataFrame) -> DataFrame:
    """Contests rated by both systems, with both probabilities."""
    g = glicko.select("contest_id", F.col("rating_difference").alias("glicko_difference"), "a_deviation", "b_deviation",
                      F.col("a_expected").alias("glicko_probability"))
    e = elo.select("contest_id", F.col("rating_difference").alias("elo_difference"), F.col("a_games"), F.col("b_games"),
                   F.col("a_expected").alias("elo_probability"))
    return e.join(g, "contest_id")


def _hot_rows(valid: DataFrame, hot_rows: int) -> int | None:
    """None where no entity has half as many contests: none of its eras, pairs, series and steps of activity (two a contest) is hot then."""
    played = valid.select(F.explode(F.array("a_id", "b_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("n"))
    return hot_rows if (played.agg(F.max("n")).first()[0] or 0) * 2 > hot_rows else None


def contest_features(contests: DataFrame, pool: str | None = "pool", hot_rows: int = hot.HOT_ROWS, wanted: DataFrame | None = None) -> DataFrame:
    """24 features, target and baseline probabilities; all values date from before the contest.

    All contests count as what came before; with ``wanted`` (contest_id) only the features of those contests are put together.
    """
    valid = ch.valid_contests(contests)
    hot_rows = _hot_rows(valid, hot_rows)
    of = lambda part: part if wanted is None else part.join(wanted.select("contest_id"), "contest_id", "left_semi")
    rated = join_feature_tables(
        of(ratings.elo_history(contests, pool)), of(ratings.glicko_features(ratings.glicko_timeline(contests, pool))))
    form = by_side(of(ch.entity_form(valid, hot_rows)), "recent_5", "recent_10", "ema_form", "streak", "rest_days")
    active = by_side(of(ch.activity(valid, hot_rows=hot_rows)), "activity")
    era = by_side(of(ch.era_form(valid, hot_rows)), "era_rate", "era_games")
    j = of(valid.select("contest_id", "ts", "tier", F.coalesce("era", F.lit(0)).alias("era_value"), "a_win"))
    for part in (rated, form, active, era, of(ch.head_to_head(valid, hot_rows)), of(ch.global_side_rate(valid))):
        j = j.join(part, "contest_id")
    j = j.join(of(ch.series_score(valid, hot_rows)), "contest_id", "left")
    clip = lambda c: F.least(F.lit(5), F.greatest(F.lit(-5), F.col(c)))
    tier = F.lower(F.coalesce("tier", F.lit("professional")))
    return j.select(
        "contest_id", "ts",
        (F.col("elo_difference") / 400.0).alias("elo_difference"),
        (F.col("glicko_difference") / 400.0).alias("glicko_difference"),
        (F.col("a_deviation") / 350.0).alias("a_deviation"), (F.col("b_deviation") / 350.0).alias("b_deviation"),
        (_diff("deviation") / 350.0).alias("deviation_difference"),
        _log_diff("games").alias("log_games_difference"),
        F.log1p(F.least("a_games", "b_games")).alias("log_minimum_games"),
        _diff("recent_5").alias("recent_5_difference"), _diff("recent_10").alias("recent_10_difference"),
        _diff("ema_form").alias("ema_difference"), _diff("era_rate").alias("era_rate_difference"),
        _log_diff("era_games").alias("log_era_games_difference"), "a_rest_days", "b_rest_days",
        _diff("activity").cast("double").alias("activity_difference"),
        (clip("a_streak") - clip("b_streak")).cast("double").alias("streak_difference"),
        "h2h_advantage", F.log1p("pair_games").alias("log_pair_games"),
        F.coalesce("series_difference", F.lit(0)).cast("double").alias("series_difference"),
        F.coalesce("series_played", F.lit(0)).cast("double").alias("series_played"), "side_rate",
        (tier == "premium").cast("double").alias("is_premium"), (tier == "professional").cast("double").alias("is_professional"),
        F.col("era_value").cast("double").alias("era"),
        F.col("a_win").cast("double").alias("target"), "elo_probability", "glicko_probability")


def lineup_table(duel_rows: DataFrame, pool: str | None = "pool") -> DataFrame:
    """Per contest: side ratings, experience, cohesion, retained and new members of both sides."""
    s = lineups.sides(duel_rows)
    rated = ratings.member_ratings(duel_rows, pool=pool).select("contest_id", "a_rating", "b_rating", "a_expected", "a_win")
    out = rated
    for part in (
        by_side(lineups.member_experience(s), "mean_games", "new_members"),
        by_side(lineups.lineup_experience(s), "lineup_games"),
        by_side(lineups.pair_experience(s), "pair_games"),
        by_side(lineups.retained_members(s), "retained"),
    ):
        out = out.join(part, "contest_id")
    return out


def lineup_features(contests: DataFrame, duel_rows: DataFrame, pool: str | None = "pool") -> DataFrame:
    """The team features plus eight lineup features, for contests present in both.

    The duels are written once: ratings, four kinds of experience and the counting of their hot keys read them again.
    """
    duel_rows = materialize(duel_rows, run_dir(duel_rows.sparkSession, "duels"))
    team = contest_features(contests, pool, wanted=duel_rows)
    extra = lineup_table(duel_rows, pool).select(
        "contest_id", (_diff("rating") / 400.0).alias("member_rating_difference"),
        _log_diff("mean_games").alias("log_member_games_difference"),
        F.log1p(F.least("a_mean_games", "b_mean_games")).alias("log_minimum_member_games"),
        _log_diff("lineup_games").alias("log_lineup_games_difference"),
        F.log1p(F.col("a_lineup_games") + F.col("b_lineup_games")).alias("log_lineup_games_total"),
        _diff("pair_games").alias("pair_games_difference"),
        _diff("retained").cast("double").alias("retained_difference"),
        _diff("new_members").cast("double").alias("new_members_difference"))
    return team.join(extra, "contest_id")
