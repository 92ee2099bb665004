"""Win-probability models: fit, choose, calibrate and report.

Feature tables are assembled per row; only fitted coefficients and one-row aggregates reach the
driver.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from contestry.functions.rates import recency_weight
from contestry.operators import evaluate, trees
from contestry.operators.chronology import DAY

BASELINE_FEATURES = ["rating_difference", "glicko_difference", "a_deviation", "b_deviation", "log_a_games", "log_b_games",
                     "is_premium", "is_professional"]
GRID = [0.01, 0.03, 0.1, 0.3, 1.0, 3.0]


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] if row[f"s_{c}"] >= 1e-9 else 1.0) for c in columns}


def scale(df: DataFrame, columns: list[str], fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - fitted[c][0]) / fitted[c][1] for c in columns})


def probability_of(model, df: DataFrame, name: str) -> DataFrame:
    scored = model.transform(df)
    drop = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(*drop)


class Logistic:
    """Ridge logistic regression on standardised features with a free intercept."""

    def __init__(self, columns: list[str], fitted, model):
        self.columns, self.fitted, self.model = columns, fitted, model

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        raw = [F.col(c).alias(f"_raw_{c}") for c in self.columns]
        scaled = scale(df.select("*", *raw), self.columns, self.fitted)
        out = probability_of(self.model, assemble(scaled, self.columns), name).drop("features")
        restored = out.withColumns({c: F.col(f"_raw_{c}") for c in self.columns})
        return restored.drop(*[f"_raw_{c}" for c in self.columns])

    def coefficients(self, spark) -> DataFrame:
        rows = [("intercept", float(self.model.intercept))] + [
            (c, float(v)) for c, v in zip(self.columns, self.model.coefficients)]
        return spark.createDataFrame(rows, "feature string, coefficient double")


def logistic_fit(df: DataFrame, columns: list[str], target: str = "target", l2: float = 0.25) -> Logistic:
    """Penalty ``l2`` on the summed loss, i.e. l2 / n on the mean loss MLlib minimises."""
    fitted = moments(df, columns)
    data = assemble(scale(df, columns, fitted), columns)
    estimator = LogisticRegression(labelCol=target, regParam=l2 / df.count(), standardization=False, tol=1e-10, maxIter=200)
    return Logistic(columns, fitted, estimator.fit(data))


def weighted_logistics(df: DataFrame, columns: list[str], weight: Column, c_values: list[float], target: str = "target") -> list[Logistic]:
    """A model per C; the moments, the scaled rows and the sum of weights do not depend on it and are made once."""
    fitted = moments(df, columns)
    data = assemble(scale(df.withColumn("_w", weight), columns, fitted), columns).select(target, "_w", "features").persist()
    try:
        total = data.agg(F.sum("_w")).first()[0]
        return [Logistic(columns, fitted, LogisticRegression(
            labelCol=target, weightCol="_w", regParam=1.0 / (c * total), standardization=False, maxIter=200).fit(data)) for c in c_values]
    finally:
        data.unpersist()


def weighted_logistic(df: DataFrame, columns: list[str], weight: Column, c_value: float, target: str = "target") -> Logistic:
    return weighted_logistics(df, columns, weight, [c_value], target)[0]


def age_weight(reference: int, half_life_days: float = 120.0) -> Column:
    return recency_weight((F.lit(reference) - F.col("ts")) / float(DAY), half_life_days)


def logistic_grid(parts: DataFrame, columns: list[str], cutoff: int, grid: list[float] = GRID, target: str = "target"):
    """Fit the core rows for each C, choose by calibration log loss, ties to the smaller C.

    Returns the chosen model, its C and the losses as a frame. The six fits share one cached table of scaled rows.
    """
    parts = parts.persist()
    try:
        core, calibration = parts.where("part = 'core'"), parts.where("part = 'calibration'")
        tried = []
        for c_value, model in zip(grid, weighted_logistics(core, columns, age_weight(cutoff), grid, target)):
            loss = model.predict(calibration).agg(F.avg(evaluate.log_loss(F.col(target), F.col("p")))).first()[0]
            tried.append((loss, c_value, model))
        tried.sort(key=lambda t: (t[0], t[1]))
        losses = parts.sparkSession.createDataFrame([(c, float(x)) for x, c, _ in tried], "c double, calibration_loss double")
        return tried[0][2], tried[0][1], losses
    finally:
        parts.unpersist()


def logit(p: Column) -> Column:
    q = evaluate.clipped(p, 1e-6)
    return F.ln(q / (1 - q))


def boosted_fit(core: DataFrame, columns: list[str], cutoff: int, rounds: int = 250, target: str = "target") -> trees.Boosted:
    """Recency-weighted boosted trees: at most 15 leaves of 35 rows or more, grown best first, leaves penalised by 3."""
    return trees.fit(core, columns, target, age_weight(cutoff), trees.Limits(rounds=rounds))


def platt_calibrate(raw: DataFrame, target: str = "target", c_value: float = 10.0):
    """Logistic regression on the logit of the raw probability in ``raw``."""
    data = assemble(raw.withColumn("logit", logit(F.col("raw"))), ["logit"])
    return LogisticRegression(labelCol=target, regParam=1.0 / (c_value * data.count()), standardization=False).fit(data)


def apply_platt(model, raw: DataFrame, name: str = "p") -> DataFrame:
    data = assemble(raw.withColumn("logit", logit(F.col("raw"))), ["logit"])
    return probability_of(model, data, name).drop("features", "logit")


def top_coefficients(coefficients: DataFrame, n: int = 12) -> DataFrame:
    return coefficients.where("feature <> 'intercept'").orderBy(F.abs("coefficient").desc(), "feature").limit(n)
