"""Penalised logistic regression by Newton's method, as reweighted least squares.

A Newton step is the least-squares fit of a working response with weights p * (1 - p) and
the same penalty. Spark sums its normal equations in one pass, combined in each task, and
solves them, one equation an input. The method reaches the optimum to the last digits in
some steps, where a first-order method stops at a tolerance.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The normal equations grow with the square of the inputs; Spark solves so many at most.
MAX_INPUTS = 4096
# Weights below this count as it, so that the working response stays finite.
LEAST_WEIGHT = 1e-12


@dataclass(frozen=True)
class LogitModel:
    """Coefficients of the inputs and an intercept."""

    inputs: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        margin = F.lit(self.intercept)
        for name, weight in zip(self.inputs, self.coefficients, strict=True):
            margin = margin + F.col(name) * F.lit(weight)
        return 1 / (1 + F.exp(-margin))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``p``, the probability of class 1, and ``prediction``."""
        return df.withColumn("p", self.probability()).withColumn("prediction", (F.col("p") > 0.5).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, n, w) for i, (n, w) in enumerate(zip(self.inputs, self.coefficients, strict=True))]
        rows.append((len(rows), None, self.intercept))
        spark.createDataFrame(rows, "position int, input string, weight double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogitModel:
        *rows, last = spark.read.parquet(path).orderBy("position").collect()
        return cls(tuple(r["input"] for r in rows), tuple(r.weight for r in rows), last.weight)


def _working(rows: DataFrame, beta: np.ndarray) -> DataFrame:
    """Each row's weight, working response and loss at ``beta``, whose last entry is the intercept."""
    weights = F.array(*[F.lit(float(b)) for b in beta[:-1]])
    product = F.aggregate(F.zip_with("_x", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    margin = F.col("_m")
    return (
        rows.withColumn("_m", product + F.lit(float(beta[-1])))
        .withColumn("_p", 1 / (1 + F.exp(-margin)))
        .withColumn("_c", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(LEAST_WEIGHT)))
        .select(
            "_x",
            (F.col("_w") * F.col("_c")).alias("weight"),
            (margin + (F.col("_y") - F.col("_p")) / F.col("_c")).alias("response"),
            (F.col("_w") * (F.log1p(F.exp(-F.abs(margin))) + F.greatest(margin, F.lit(0.0)) - F.col("_y") * margin)).alias("loss"),
        )
    )


def fit_logit(
    df: DataFrame, inputs: Sequence[str], label: str, weight: str | None = None, l2: float = 1.0, tolerance: float = 1e-10, max_steps: int = 100
) -> LogitModel:
    """Minimise the weighted log loss plus ``l2 / 2`` times the squared coefficients.

    The intercept is not penalised. ``df`` is read once a step, so pass a stored table. Rows
    with a missing input or label don't count; without any row, or with one class only and
    no finite optimum of the intercept, the fit is refused.
    """
    if len(inputs) > MAX_INPUTS:
        raise ValueError(f"{len(inputs)} inputs; Newton's method is for {MAX_INPUTS} at most")
    whole = df.select(
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("_x"),
        F.col(label).cast("double").alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
    ).where("_y is not null and _w > 0 and not exists(_x, v -> v is null)")
    spreads = [F.max(F.get("_x", F.lit(i))) > F.min(F.get("_x", F.lit(i))) for i in range(len(inputs))]
    total, bad, varies = whole.agg(F.sum("_w"), F.sum(F.col("_w") * F.col("_y")), F.array(*spreads)).first()
    if not total or bad <= 0 or bad >= total:
        raise ValueError("logistic regression needs rows of both classes")
    # The penalised coefficient of a constant is 0: the intercept does its work for nothing.
    used = [i for i, v in enumerate(varies) if v]
    rows = whole.withColumn("_x", F.array(*[F.get("_x", F.lit(i)) for i in used]).cast("array<double>"))

    def at(beta: np.ndarray) -> tuple[float, DataFrame, float, float]:
        """Loss with penalty, the working table, its total weight and the deviation of its response."""
        working = _working(rows, beta)
        mean = F.sum(F.col("weight") * F.col("response")) / F.sum("weight")
        square = F.sum(F.col("weight") * F.col("response") * F.col("response")) / F.sum("weight")
        loss, weights, spread = working.agg(F.sum("loss"), F.sum("weight"), square - mean * mean).first()
        return loss + l2 * float(beta[:-1] @ beta[:-1]) / 2, working, weights, math.sqrt(max(spread, 0.0))

    beta = np.zeros(len(used) + 1)
    beta[-1] = math.log(bad / (total - bad))
    loss, working, weights, deviation = at(beta)
    for _ in range(max_steps if used else 0):
        # The solver divides the penalty by the response's deviation; it is multiplied in here.
        solver = LinearRegression(
            featuresCol="features", labelCol="response", weightCol="weight", solver="normal", standardization=False, regParam=l2 / weights * deviation
        )
        fitted = solver.fit(working.select(array_to_vector("_x").alias("features"), "response", "weight"))
        step = np.append(fitted.coefficients.toArray(), fitted.intercept) - beta
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
        share = 1.0
        while True:
            found = at(beta + share * step)
            if found[0] <= loss + 1e-9 * abs(loss) or share < 1e-6:
                break
            share /= 2
        beta = beta + share * step
        loss, working, weights, deviation = found
    out = np.zeros(len(inputs))
    out[used] = beta[:-1]
    return LogitModel(tuple(inputs), tuple(out.tolist()), float(beta[-1]))
