"""Scores and loan terms for accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.credit import credit_score, loan_amount, loan_duration, loan_tier, probability_problem
from ..operators.encode import NumericStats
from ..operators.features import ReferenceTime, customer_features
from ..schema import ACCOUNT, LEAKAGE, RESPONSE, TARGET, TRANSACTIONS
from ..sources.validation import validate_transactions
from .training import CreditModel

SUCCESS = "Prediction successful."


def score_and_terms(df: DataFrame, p: str = "p", clamp: bool = False) -> DataFrame:
    """Add the score, loan terms, ``status`` and ``message`` for a probability column.

    ``status`` is ``ok``, ``score_undefined`` (probability 1: no finite odds) or
    ``error`` (no valid probability); only ``ok`` rows have a score and terms.
    """
    probability = F.col(p)
    problem = probability_problem(probability)
    scored = df.withColumn("credit_score", credit_score(probability, clamp=clamp))
    score = F.col("credit_score")
    return scored.withColumns(
        {
            "risk_probability": F.when(problem.isNull(), F.bround(probability, 4)),
            "recommended_loan_amount": loan_amount(score),
            "recommended_loan_duration": loan_duration(score),
            "interest_rate_tier": loan_tier(score),
            "status": F.when(problem.isNotNull(), "error").when(score.isNull(), "score_undefined").otherwise("ok"),
            "message": F.when(problem.isNotNull(), problem)
            .when(score.isNull(), "a probability of 1 has no score")
            .otherwise(SUCCESS),
        }
    )


def response(scored: DataFrame) -> DataFrame:
    """The columns of a scoring response."""
    return scored.select(*RESPONSE)


def feature_mismatch(df: DataFrame, expected: Sequence[str]) -> str | None:
    """What keeps ``df`` from being scored by a model with ``expected`` inputs."""
    missing = [c for c in expected if c not in df.columns]
    return f"feature mismatch: missing {', '.join(missing)}" if missing else None


MISMATCH = ("raise", "status")


def refused_rows(accounts: DataFrame, message: Column) -> DataFrame:
    """A response with status ``error`` and nothing but the message for each account."""
    kinds = {
        "risk_probability": "double",
        "credit_score": "int",
        "recommended_loan_amount": "double",
        "recommended_loan_duration": "string",
        "interest_rate_tier": "string",
    }
    return accounts.select(
        *[F.col(ACCOUNT) if c == ACCOUNT else message.alias(c) if c == "message" else F.lit(None).cast(kinds[c]).alias(c) for c in RESPONSE],
        F.lit("error").alias("status"),
    )


def _mismatch(problem: str, accounts: DataFrame, on_mismatch: str) -> DataFrame:
    if on_mismatch not in MISMATCH:
        raise ValueError(f"on_mismatch must be one of {', '.join(MISMATCH)}, not {on_mismatch!r}")
    if on_mismatch == "raise":
        raise ValueError(problem)
    return refused_rows(accounts, F.lit(problem))


def score_features(
    inputs: DataFrame,
    model: CreditModel,
    scaler: Sequence[NumericStats] = (),
    clamp: bool = False,
    on_mismatch: str = "raise",
) -> DataFrame:
    """Score preprocessed inputs, every row of them.

    ``scaler`` standardises the inputs once more; they already are standardised,
    so there is none by default. Inputs that the model doesn't fit raise, or with
    ``on_mismatch="status"`` give a response with status ``error`` for each row.
    """
    mismatch = feature_mismatch(inputs, model.preprocessor.outputs)
    if mismatch:
        return _mismatch(mismatch, inputs, on_mismatch)
    scaled = inputs.withColumns({s.feature: s.standardized(F.col(s.feature)) for s in scaler}) if scaler else inputs
    return score_and_terms(model.probabilities(scaled), clamp=clamp)


def score_transactions(
    txns: DataFrame,
    model: CreditModel,
    reference_time: ReferenceTime = "account",
    clamp: bool = False,
    on_mismatch: str = "raise",
) -> DataFrame:
    """One scored row per account from its transactions.

    By default recency counts back from the account's own latest transaction,
    as when each request is scored by itself, and is therefore 0; ``"global"``
    gives the rule used in training.
    """
    features = customer_features(txns, reference_time).drop(TARGET, LEAKAGE)
    missing = model.preprocessor.missing_columns(features)
    if missing:
        return _mismatch(f"feature mismatch: missing {', '.join(missing)}", features, on_mismatch)
    scored = score_features(model.preprocessor.transform(features), model, clamp=clamp)
    return scored.select(*RESPONSE, "status")


def score_records(
    raw: DataFrame,
    model: CreditModel,
    reference_time: ReferenceTime = "account",
    clamp: bool = False,
    schema: StructType = TRANSACTIONS,
    on_mismatch: str = "raise",
) -> DataFrame:
    """Score raw records. An account with refused records gets ``status = 'error'``
    and the first problem as its message; all other accounts are scored.

    ``schema`` says what the records must be, and keeps text ids text.
    """
    valid, rejects = validate_transactions(raw, schema)
    bad = (
        rejects.withColumn(ACCOUNT, F.col(ACCOUNT).try_cast(schema[ACCOUNT].dataType))
        .groupBy(ACCOUNT)
        .agg(F.min("problems").alias("_problems"))
    )
    # left out after the aggregation, so that no join moves transactions
    scored = score_transactions(valid, model, reference_time, clamp, on_mismatch).join(bad, ACCOUNT, "left_anti")
    failed = refused_rows(bad, F.concat(F.lit("record refused: "), "_problems"))
    return scored.unionByName(failed)
