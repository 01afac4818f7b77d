"""Checks of incoming transaction records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRANSACTIONS
from .transactions import not_nan, parse_times


def validate_transactions(
    raw: DataFrame, schema: T.StructType = TRANSACTIONS
) -> tuple[DataFrame, DataFrame]:
    """Split raw records into well-typed transactions and refused records.

    Every column but ``FraudResult`` (0 if missing) is required and must fit its
    type. Refused records keep their raw columns and list what is wrong in
    ``problems``, e.g. ``Value: invalid, CurrencyCode: missing``.
    """
    absent = [name for name in schema.names if name not in raw.columns and name != "FraudResult"]
    if absent:
        raise ValueError(f"transaction columns are missing: {', '.join(absent)}")
    parsed = raw
    names = {}
    for field in schema:
        if field.name not in raw.columns:
            continue
        name = f"_typed_{field.name}"
        names[field.name] = name
        if isinstance(field.dataType, T.TimestampNTZType):
            parsed = parse_times(parsed.withColumn(name, F.col(field.name)), name, lenient=True)
            continue
        typed = F.col(field.name).try_cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            typed = not_nan(typed)
        elif isinstance(field.dataType, (T.LongType, T.IntegerType)):
            # 12.0 is an integer, 12.5 is refused rather than cut to 12
            typed = F.when(F.col(field.name).try_cast("double") % 1 == 0, typed)
        parsed = parsed.withColumn(name, typed)

    problems = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(field).isNull(),
                    F.lit(None if field == "FraudResult" else f"{field}: missing"),
                ).when(F.col(typed).isNull(), F.lit(f"{field}: invalid"))
                for field, typed in names.items()
            ]
        )
    )
    checked = parsed.withColumn("problems", F.array_join(problems, ", "))
    valid = checked.where(F.col("problems") == "").select(
        *[
            (
                F.coalesce(F.col(names[field.name]), F.lit(0))
                if field.name == "FraudResult" and field.name in names
                else F.lit(0) if field.name == "FraudResult" else F.col(names[field.name])
            )
            .cast(field.dataType)
            .alias(field.name)
            for field in schema
        ]
    )
    rejects = checked.where(F.col("problems") != "").select(*raw.columns, "problems")
    return valid, rejects
