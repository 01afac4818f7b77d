"""Pearson correlations over rows where both sides are present.

Each column becomes a row that carries its partners, and every row is reduced
within its task to one line per column, so nothing but sums is shuffled. The
built-in ``corr`` is not used because it raises on a constant column; here such
a pair has no correlation (NULL). NaN is missing on both sides.

One aggregation with a function for each pair was tried and is not used: Spark compiles
no code for so many, and 12 columns of 600,000 rows took ten times as long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column_label, melt, numeric_columns, present


def _pearson(covariance, left_variance, right_variance):
    return F.try_divide(covariance, F.sqrt(left_variance) * F.sqrt(right_variance))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(left, right, correlation)`` for every ordered pair of numeric columns.

    A first pass over the columns finds which have missing values. Only beside
    those does a column need a variance of its own; and each pair's covariance
    is summed once.
    """
    columns = list(columns or numeric_columns(df))
    k = len(columns)
    filled = df.agg(F.count(F.lit(1)), *[F.count(present(df, c)) for c in columns]).first()
    with_missing = {j for j in range(k) if filled[j + 1] < filled[0]}
    partners = [present(df, c).cast("double").alias(f"_y{j}") for j, c in enumerate(columns)]
    rows = melt(df.select(*columns, *partners), columns, "double", keep=[f"_y{j}" for j in range(k)])
    sums = rows.groupBy("column_id").agg(
        F.expr("var_pop(value)").alias("v"),
        *[F.expr(f"covar_pop(value, if(column_id <= {j}, _y{j}, null))").alias(f"c{j}") for j in range(k)],
        *[F.expr(f"var_pop(if(_y{j} is not null, value, null))").alias(f"v{j}") for j in with_missing],
    )
    # column i beside j: its covariance (if i <= j) and its own variance where j is present
    beside = ", ".join(f"struct(c{j} as c, {f'v{j}' if j in with_missing else 'v'} as v)" for j in range(k))
    pairs = sums.select(
        F.col("column_id").alias("i"), F.expr(f"posexplode(array({beside}))").alias("j", "m")
    ).select("i", "j", "m.c", "m.v")
    mirrored = pairs.select(
        F.col("i").alias("j"), F.col("j").alias("i"), F.col("c").alias("d"), F.col("v").alias("w")
    )
    return pairs.join(mirrored, ["i", "j"]).select(
        column_label(columns, "i").alias("left"),
        column_label(columns, "j").alias("right"),
        _pearson(F.coalesce("c", "d"), F.col("v"), F.col("w")).alias("correlation"),
    )


def correlation_with(df: DataFrame, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every numeric column with ``label``, highest first."""
    columns = list(columns or numeric_columns(df))
    rows = melt(df.withColumn("_label", present(df, label).cast("double")), columns, "double", keep=["_label"])
    return (
        rows.where("value is not null and _label is not null")
        .groupBy("column_id")
        .agg(
            F.covar_pop("value", "_label").alias("c"),
            F.var_pop("value").alias("v"),
            F.var_pop("_label").alias("w"),
        )
        .select(
            column_label(columns).alias("column"),
            _pearson(F.col("c"), F.col("v"), F.col("w")).alias("correlation"),
        )
        .orderBy(F.desc_nulls_last("correlation"), "column")
    )
