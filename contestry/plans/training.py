"""Train and evaluate on a chronological split; all parts of a report are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from contestry.operators import chronology as ch, evaluate, models, ratings, resample
from contestry.plans.features import FEATURES, LINEUP_FEATURES
from contestry.session import materialize, run_dir


def baseline_table(contests: DataFrame, pool: str | None = "pool") -> DataFrame:
    """The eight columns of the plain baseline, with target and Elo probability."""
    elo = ratings.elo_history(contests, pool)
    glicko = ratings.glicko_features(ratings.glicko_timeline(contests, pool)).select(
        "contest_id", F.col("rating_difference").alias("glicko_difference"), "a_deviation", "b_deviation")
    tier = ch.valid_contests(contests).select("contest_id", F.coalesce("tier", F.lit("professional")).alias("tier"))
    j = elo.join(glicko, "contest_id").join(tier, "contest_id")
    return j.select(
        "contest_id", "ts", "rating_difference", "glicko_difference", "a_deviation", "b_deviation",
        F.log1p("a_games").alias("log_a_games"), F.log1p("b_games").alias("log_b_games"),
        (F.col("tier") == "premium").cast("double").alias("is_premium"), (F.col("tier") == "professional").cast("double").alias("is_professional"),
        F.col("a_win").cast("double").alias("target"), F.col("a_expected").alias("elo_probability"))


def train_baseline(table: DataFrame, cutoff: int) -> tuple[models.Logistic, DataFrame]:
    """Fit before the cutoff; metrics of model and Elo on the rest.

    The table is written once, since the moments, the number of rows, the fit and the metrics read it again.
    """
    table = materialize(table, run_dir(table.sparkSession, "baseline"))
    model = models.logistic_fit(table.where(F.col("ts") < cutoff), models.BASELINE_FEATURES)
    test = model.predict(table.where(F.col("ts") >= cutoff))
    return model, compare(test)


def compare(test: DataFrame) -> DataFrame:
    """Metrics of the model (p) and of Elo on the same rows, one row each."""
    both = F.array(F.struct(F.lit("model").alias("source"), F.col("p").alias("q")),
                   F.struct(F.lit("elo").alias("source"), F.col("elo_probability").alias("q")))
    long = test.select("target", F.explode(both).alias("v")).select("target", "v.*")
    return evaluate.eval_probability(long, "target", "q", "source")


def gate(test: DataFrame, samples: int) -> DataFrame:
    interval = resample.paired_bootstrap_ci(test, "contest_id", "target", "p", "elo_probability", samples)
    metrics = lambda c: evaluate.eval_probability(test, "target", c)
    return evaluate.promotion_gate(metrics("p"), metrics("elo_probability"), interval)


def split_and_store(features: DataFrame, cutoff: int, **sizes) -> DataFrame:
    base = run_dir(features.sparkSession, "features")
    stored = materialize(features, f"{base}/all")
    return materialize(evaluate.chrono_split(stored, cutoff, **sizes), f"{base}/split")


def train_lineup_model(features: DataFrame, cutoff: int, samples: int = 10_000, **sizes):
    """Grid-searched logistic model on all features; returns model, C, losses, coefficients and gate.

    The feature table is written once, since the split and every fit and metric read it again.
    """
    columns = [c for c in [*FEATURES, *LINEUP_FEATURES] if c in features.columns]
    stored = split_and_store(features, cutoff, **sizes)
    model, c_value, losses = models.logistic_grid(stored, columns, cutoff)
    test = model.predict(stored.where("part = 'test'"))
    coefficients = models.top_coefficients(model.coefficients(features.sparkSession))
    return {"model": model, "c": c_value, "losses": losses, "coefficients": coefficients, "metrics": compare(test),
            "gate": gate(test, samples), "deployment": lambda: deploy(stored, columns, c_value)}


def deploy(stored: DataFrame, columns: list[str], c_value: float) -> models.Logistic:
    """Refit on everything, ages counted from the day after the last contest."""
    reference = stored.agg(F.max("ts")).first()[0] + ch.DAY
    return models.weighted_logistic(stored, columns, models.age_weight(reference), c_value)


def train_boosted(features: DataFrame, cutoff: int, rounds: int = 250, samples: int = 2_000, **sizes):
    """Boosted trees with Platt calibration on the last training rows."""
    columns = [c for c in FEATURES if c in features.columns]
    stored = split_and_store(features, cutoff, **sizes)
    model = models.boosted_fit(stored.where("part = 'core'"), columns, cutoff, rounds)
    raw = lambda part: model.predict(stored.where(F.col("part") == part), "raw")
    calibrator = models.platt_calibrate(raw("calibration"))
    test = models.apply_platt(calibrator, raw("test"))
    return {"model": model, "calibrator": calibrator, "test": test, "metrics": compare(test), "gate": lambda: gate(test, samples)}
