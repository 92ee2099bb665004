"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the text. Normal
equations are sums over rows, so every partition adds up its own and only the sums move. The scores of
two half-models, each on the half that it has not seen, are calibrated by isotonic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from contestry.llm.common import fresh, query, spool, table

N_FOURIER, WIDTH, RIDGE, SEED = 192, 3.0, 1e-3, 11
LEVEL = 0.3
#: Scores are gathered in steps of this size for calibration, from -1 to 2: at most 3,001 sums.
STEP = 0.001
SYMBOLS = b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), b"0123456789"
WORD_LINE = re.compile(rb"[^\x20\x09-\x0D]")
N_STATS = 13


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text; of the empty text all are zero."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    chars = len(text)
    lines = [x for x in text.split(b"\n") if WORD_LINE.search(x)]
    lower = text.lower().split()
    outside = lambda drop: chars - len(text.translate(None, drop))
    return [
        np.log1p(n),
        (chars - outside(b" \t\n\x0b\x0c\r")) / n,
        outside(UPPER) / chars,
        outside(SYMBOLS) / n,
        text.count(b"!") / n,
        outside(DIGITS) / chars,
        1 - len(set(lines)) / len(lines),
        len(lines) / n,
        len(set(lower)) / n,
        len(set(zip(lower, lower[1:]))) / n,
        (text.count(b".") + text.count(b",")) / n,
        text.count(b"|") / n,
        sum(len(w) <= 3 for w in lower) / n,
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t.encode()) if isinstance(t, str) else [0.0] * N_STATS for t in texts])


@dataclass(frozen=True)
class Fourier:
    """Feature map; weights follow from the seed, mean and scale from all documents."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        weights, shift = rng.normal(0, 1 / WIDTH, (N_STATS, N_FOURIER)), rng.uniform(0, 2 * np.pi, N_FOURIER)
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / N_FOURIER) * np.cos(x @ weights + shift), np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    fourier: Fourier
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.fourier(stats) @ self.weights, self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean x and mean outcome of the blocks of the pooled-adjacent-violators fit; x ascending."""
    blocks: list[list[float]] = []
    for b in zip(x * n, n, hits):
        blocks.append(list(b))
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _sums(fourier: Fourier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = N_FOURIER + 1
        total = np.zeros((2, size, size + 1))
        for batch in batches:
            z, y = fourier(_stack(batch.column("stats"))), batch.column("y").to_numpy(zero_copy_only=False)
            half = batch.column("half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                own = z[half == h]
                total[h] += own.T @ np.hstack([own, y[half == h, None]])
        if total.any():
            flat = total.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    return run


def _scored(fourier: Fourier, weights: np.ndarray):
    @F.pandas_udf(DoubleType())
    def score(stats: pd.Series, half: pd.Series) -> pd.Series:
        z = fourier(np.stack(stats.to_numpy()))
        return pd.Series(np.where(half == 0, z @ weights[0], z @ weights[1]))

    return score


def fold(id_col: Column, n: int = 5) -> Column:
    """crc32 of the id as text modulo ``n``; of a null id: of the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(n))


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """``rows``: doc_id, stats of all documents. Labels: doc_id, quality; those of held-out ids are left out.

    Labels with a null id or quality are ignored; contradicting labels of an id count as 0. Without labels
    every score is 1, so that nothing is rejected for want of knowledge.
    """
    each = [F.get("stats", i) for i in range(N_STATS)]
    moments = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean, scale = (np.array([v or 0.0 for v in part]) for part in (moments[:N_STATS], moments[N_STATS:]))
    fourier = Fourier(mean, np.where(scale > 1e-9, scale, 1.0))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.where(fold(F.col("doc_id")) != 0)
    train = spool(rows.join(known, "doc_id").select("stats", "y", (fold(F.col("doc_id")) % 2).alias("half")), "labelled")
    sums = train.mapInArrow(_sums(fourier), "at long, v double").groupBy("at").agg(F.sum("v")).collect()
    size = N_FOURIER + 1
    flat = np.zeros(2 * size * (size + 1))
    for at, v in sums:
        flat[at] = v
    parts = flat.reshape(2, size, size + 1)
    n = parts[:, -1, -2].sum()
    if not n:
        return Model(fourier, np.zeros(size), np.array([0.0]), np.array([1.0]))
    solve = lambda m: np.linalg.solve(m[:, :-1] + RIDGE * max(n, 1.0) / size * np.eye(size), m[:, -1])
    other = np.array([solve(parts[1]), solve(parts[0])])  # a row is scored by the model of the other half
    steps = train.select(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), _scored(fourier, other)("stats", "half"))) / STEP).alias("x"), "y")
    bins = sorted(map(tuple, steps.groupBy("x").agg(F.count("*"), F.sum("y")).collect()))
    x, count, hits = (np.array(c, float) for c in zip(*bins))
    knots, values = isotonic(x * STEP, count, hits)
    return Model(fourier, solve(parts[0] + parts[1]), knots, values)


def _judged(model: Model):
    @F.pandas_udf(DoubleType())
    def score(stats: pd.Series) -> pd.Series:
        return pd.Series(model(np.stack(stats.to_numpy())) if len(stats) else [], dtype=float)

    return score


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), _statistics(F.col(f"`{text_col}`")).alias("stats"))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    A score depends on the text alone: equal texts have equal scores, null and empty texts that of the
    all-zero statistics. Ids only decide who may teach (held_out rows never do).
    """
    rows = spool(_features(docs, id_col, text_col), "statistics")
    scored = rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), _judged(fit(rows, labels))("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEVEL).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``level``, with the columns of ``docs``."""
    model = fit(spool(_features(docs, id_col, text_col), "statistics"), labels)
    (stats,) = fresh(docs, "_stats")
    good = docs.withColumn(stats, _statistics(F.col(f"`{text_col}`"))).where(_judged(model)(F.col(stats)) >= level)
    return good.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
