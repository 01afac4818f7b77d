"""Probability to credit score to loan terms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest probability distinguished from 0 (and, mirrored, from 1).
EDGE = 1e-9

# Lowest score of the band, loan amount, duration, interest tier.
LOAN_BANDS = (
    (750, 50000.0, "6 months", "Lowest"),
    (650, 20000.0, "3 months", "Low"),
    (550, 5000.0, "1 month", "Moderate"),
    (450, 1000.0, "2 weeks", "High"),
)
DECLINED = (0.0, "Declined", "N/A")


def probability_problem(p: Column) -> Column:
    """What is wrong with a probability, or NULL."""
    return F.when(p.isNull() | F.isnan(p), "probability is missing").when(
        ~p.between(0, 1), "probability is outside [0, 1]"
    )


def credit_score(p: Column, offset: float = 600, factor: float = 20, clamp: bool = False) -> Column:
    """``offset - factor * ln(odds)``, rounded half to even.

    A probability of 0 counts as ``EDGE``. A probability of 1 has no finite
    odds: the score is NULL, or that of ``1 - EDGE`` with ``clamp``. NULL also
    where the probability itself is not valid.
    """
    odds = F.when(p == 0, F.lit(EDGE / (1 - EDGE))).when(p < 1, F.try_divide(p, 1 - p))
    if clamp:
        odds = odds.when(p == 1, F.lit((1 - EDGE) / EDGE))
    score = F.rint(F.lit(float(offset)) - F.lit(float(factor)) * F.ln(odds)).cast("int")
    return F.when(probability_problem(p).isNull(), score)


def _by_band(score: Column, position: int) -> Column:
    chosen = F.when(score.isNull(), F.lit(None))
    for band in LOAN_BANDS:
        chosen = chosen.when(score >= band[0], F.lit(band[position]))
    return chosen.otherwise(F.lit(DECLINED[position - 1]))


def loan_amount(score: Column) -> Column:
    return _by_band(score, 1)


def loan_duration(score: Column) -> Column:
    return _by_band(score, 2)


def loan_tier(score: Column) -> Column:
    return _by_band(score, 3)
