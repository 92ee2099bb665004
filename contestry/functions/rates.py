"""Column expressions for ratings, shrinkage and win probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values.
GLICKO_SCALE = 173.7178
START_RATING = 1500.0
START_DEVIATION = 350.0
START_VOLATILITY = 0.06
TIER_K = {"premium": 36.0, "professional": 28.0, "amateur": 20.0, "excluded": 12.0}
OTHER_TIER_K = 24.0
PROVISIONAL_GAMES = 20
PROVISIONAL_FACTOR = 1.25


def smoothed_rate(wins: Column, games: Column, prior: float) -> Column:
    return (wins + 0.5 * prior) / (games + prior)


def elo_expected(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400.0))


def tier_k(tier: Column) -> Column:
    """Base step of a contest: missing tier counts as professional, an unknown one as other."""
    value = F.coalesce(tier, F.lit("professional"))
    k = F.lit(OTHER_TIER_K)
    for name, step in TIER_K.items():
        k = F.when(value == name, step).otherwise(k)
    return k


def _g(phi: Column) -> Column:
    return 1 / F.sqrt(1 + 3 * phi * phi / (math.pi * math.pi))


def glicko_expected(rating_a: Column, rating_b: Column, deviation_a: Column, deviation_b: Column) -> Column:
    a, b = deviation_a / GLICKO_SCALE, deviation_b / GLICKO_SCALE
    return 1 / (1 + F.exp(-_g(F.sqrt(a * a + b * b)) * (rating_a - rating_b) / GLICKO_SCALE))


def glicko_idle_periods(days_since_last: Column) -> Column:
    return F.greatest(F.lit(0), days_since_last - 1)


def glicko_inactivity(deviation: Column, volatility: Column, periods: Column) -> Column:
    phi = deviation / GLICKO_SCALE
    grown = F.least(F.lit(350.0), F.sqrt(phi * phi + periods * volatility * volatility) * GLICKO_SCALE)
    return F.when(periods > 0, grown).otherwise(deviation)


def series_probability(p: Column, best_of: int) -> Column:
    """Chance to win more than half of ``best_of`` contests at chance p each."""
    terms = [math.comb(best_of, w) * F.pow(p, w) * F.pow(1 - p, best_of - w)
             for w in range(best_of // 2 + 1, best_of + 1)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def remaining_series_probability(p: Column, won_a: Column, won_b: Column) -> Column:
    """Chance that side a takes a best-of-three from the current score."""
    return (
        F.when(won_a >= 2, 1.0).when(won_b >= 2, 0.0)
        .when((won_a == 1) & (won_b == 1), p)
        .when(won_a == 1, 1 - F.pow(1 - p, 2))
        .when(won_b == 1, F.pow(p, 2))
        .otherwise(series_probability(p, 3))
    )


def form_rating(center: Column, wins: Column, losses: Column) -> Column:
    return center + 400.0 * F.log10((wins + 2.0) / (losses + 2.0))


def recency_weight(age_days: Column, half_life_days: float) -> Column:
    return F.greatest(F.lit(0.05), F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life_days))
