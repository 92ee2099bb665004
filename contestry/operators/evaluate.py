"""Splits, probability metrics and promotion of a candidate model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from contestry.operators import hot

CLIP = 1e-9
BINS = 10


def clipped(p: Column, eps: float = CLIP) -> Column:
    return F.least(F.lit(1.0 - eps), F.greatest(F.lit(eps), p))


def log_loss(y: Column, p: Column) -> Column:
    q = clipped(p)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def calibration_table(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per tenth of probability: share of rows, mean probability and mean outcome; the last bin is closed."""
    total = df.agg(F.count("*")).scalar()
    b = F.least(F.floor(clipped(F.col(p)) * BINS), F.lit(BINS - 1)).alias("bin")
    return df.groupBy(b).agg(F.count("*").alias("n"), F.avg(clipped(F.col(p))).alias("mean_p"), F.avg(y).alias("mean_y")).withColumn(
        "share", F.col("n") / total)


def eval_probability(df: DataFrame, y: str = "y", p: str = "p", *by: str) -> DataFrame:
    """Rows, log loss, Brier score, accuracy at 0.5 and expected calibration error.

    One shuffle of at most ten partial rows per group: sums per bin, then over the bins.
    """
    q, target = clipped(F.col(p)), F.col(y)
    b = F.least(F.floor(q * BINS), F.lit(BINS - 1)).alias("bin")
    per_bin = df.groupBy(*by, b).agg(
        F.count("*").alias("n"), F.sum(log_loss(target, F.col(p))).alias("loss"), F.sum((q - target) * (q - target)).alias("sq"),
        F.sum(((q >= 0.5).cast("double") == target).cast("double")).alias("hit"), F.sum(q).alias("sp"), F.sum(target).alias("sy"))
    n = F.sum("n")
    return per_bin.groupBy(*by).agg(
        n.alias("samples"), (F.sum("loss") / n).alias("log_loss"), (F.sum("sq") / n).alias("brier"),
        (F.sum("hit") / n).alias("accuracy"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("calibration_error"))


def chrono_split(rows: DataFrame, cutoff: int, minimum_train: int = 200, minimum_test: int = 50,
                 calibration_share: float = 0.2, minimum_calibration: int = 100) -> DataFrame:
    """Label rows core, calibration or test by time; calibration is the last part of the training rows.

    Positions come from a distributed index. Too few rows on either side fail the job.
    """
    indexed = hot.global_index(rows, ["ts", "contest_id"], "_pos")
    before = F.col("ts") < cutoff
    train = rows.agg(F.count(F.when(before, 1))).scalar()
    test = rows.agg(F.count(F.when(~before, 1))).scalar()
    size = F.greatest(F.lit(minimum_calibration), F.floor(train * calibration_share))
    label = F.when(~before, "test").when(F.col("_pos") >= train - size, "calibration").otherwise("core")
    enough = (train >= minimum_train) & (test >= minimum_test)
    return indexed.withColumn("part", F.when(enough, label).otherwise(F.raise_error(F.lit(
        f"chronological split needs {minimum_train} training and {minimum_test} test rows")))).drop("_pos")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation per column; a flat column is only centred."""
    moments = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    packed = moments.select(F.struct(*moments.columns)).scalar()
    j = df.withColumn("_z", packed)
    scale = lambda c: F.when(F.col(f"_z._s_{c}") < 1e-9, 1.0).otherwise(F.col(f"_z._s_{c}"))
    return j.select(*[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"_z._m_{c}")) / scale(c)).alias(c) for c in columns])


def promotion_gate(candidate: DataFrame, baseline: DataFrame, interval: DataFrame) -> DataFrame:
    """Provisional: log loss and Brier score both improve. Promoted: and the interval lies below zero."""
    c = candidate.select(F.struct("log_loss", "brier")).scalar()
    b = baseline.select(F.struct("log_loss", "brier")).scalar()
    j = interval.withColumn("_c", c).withColumn("_b", b)
    provisional = (F.col("_c.log_loss") < F.col("_b.log_loss")) & (F.col("_c.brier") < F.col("_b.brier"))
    return j.select(*interval.columns, F.col("_c.log_loss").alias("candidate_loss"), F.col("_b.log_loss").alias("baseline_loss"),
                    provisional.cast("int").alias("provisional"), (provisional & (F.col("upper") < 0)).cast("int").alias("promoted"))
