"""Choosing, aligning and unpivoting columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def plotted_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose distribution is of interest: no ids, no label."""
    return [c for c in numeric_columns(df) if "Id" not in c and c != "FraudResult"]


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the given columns where present."""
    return df.drop(*columns)


def align_columns(df: DataFrame, columns: Sequence[str], fill: float = 0) -> DataFrame:
    """Exactly ``columns`` in that order: extra ones dropped, absent ones filled."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns]
    )


def present(df: DataFrame, name: str) -> Column:
    """The column, with NaN as NULL."""
    if isinstance(df.schema[name].dataType, T.FractionalType) and not isinstance(df.schema[name].dataType, T.DecimalType):
        return F.nullif(F.col(name), F.lit(float("nan")))
    return F.col(name)


def melt(
    df: DataFrame, columns: Sequence[str], dtype: str, keep: Sequence[str | Column] = ()
) -> DataFrame:
    """One row per input row and column: ``(*keep, column_id, value)``.

    ``column_id`` is the position in ``columns``; a small integer key hashes
    faster than a name. ``column_label`` turns it back at the end. NaN is missing,
    as everywhere.
    """
    value = "nullif(cast(`{}` as double), double('NaN'))" if dtype == "double" else "cast(`{}` as " + dtype + ")"
    pairs = ", ".join(f"{i}, {value.format(name)}" for i, name in enumerate(columns))
    stacked = F.expr(f"stack({len(columns)}, {pairs})").alias("column_id", "value")
    return df.select(*keep, stacked)


def column_label(columns: Sequence[str], column_id: str | Column = "column_id") -> Column:
    position = F.col(column_id) if isinstance(column_id, str) else column_id
    return F.get(F.array(*[F.lit(c) for c in columns]), position)
