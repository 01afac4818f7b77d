"""Readers for transaction tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRANSACTIONS
from ..session import store


def read_transactions(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = TRANSACTIONS
) -> DataFrame:
    """Transactions from headered CSV, JSON lines or parquet, with a declared schema.

    A missing path raises. A value that does not fit its column raises too for
    CSV and JSON; to sort such records out instead, read text columns and use
    ``validate_transactions``. Start times in text files may end in ``Z``.
    """
    if fmt == "parquet":
        return conform(spark.read.schema(schema).parquet(path), schema)
    reader = spark.read.schema(_text_time(schema)).option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return conform(parse_times(reader.format(fmt).load(path)), schema)


def read_with_rejects(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = TRANSACTIONS, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Transactions from CSV or JSON lines, and the records that are none.

    The rejects have the text of every column, ``problems`` as in ``validate_transactions``
    and ``line``. A line that can't be taken apart (too few or too many fields, broken JSON)
    is kept whole in ``line`` with the problem ``line: broken``; in other rejects ``line`` is
    NULL. A JSON line that is an array counts as the records in it, so an empty one is none.
    Nothing raises but a missing path or a header with other names.
    """
    from .validation import validate_transactions

    names = schema.names
    broken = "_broken_line"
    text = T.StructType([T.StructField(name, T.StringType()) for name in [*names, broken]])
    reader = spark.read.schema(text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken)
    if fmt == "csv":
        reader = reader.option("header", header).option("enforceSchema", not header)
    # Stored as parsed: both results read it, and Spark refuses to read broken lines alone.
    raw = store(reader.format(fmt).load(path), "raw-lines")
    whole = raw.where(F.col(broken).isNull()).select(*names)
    valid, rejects = validate_transactions(whole, schema)
    none = [F.when(F.col(broken).isNull(), F.col(name)).alias(name) for name in names]
    lines = raw.where(F.col(broken).isNotNull()).select(*none, F.lit("line: broken").alias("problems"), F.col(broken).alias("line"))
    return valid, rejects.withColumn("line", F.lit(None).cast("string")).unionByName(lines)


def _text_time(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType)
            for f in schema
        ]
    )


def from_records(
    spark: SparkSession, records: Iterable[dict], schema: T.StructType = TRANSACTIONS
) -> DataFrame:
    """A request body, that is a short list of transaction objects, as a table.

    ``FraudResult`` is 0 where a record leaves it out, and start times may be
    text. Bulk input comes from files through ``read_transactions``.
    """
    rows = [
        tuple(
            record.get(name, 0 if name == "FraudResult" else None)
            if name != "TransactionStartTime"
            else None if record.get(name) is None else str(record[name])
            for name in schema.names
        )
        for record in records
    ]
    return conform(parse_times(spark.createDataFrame(rows, _text_time(schema))), schema)


def parse_times(df: DataFrame, column: str = "TransactionStartTime", lenient: bool = False) -> DataFrame:
    """Parse ISO date-time text; unreadable text raises, or becomes NULL if ``lenient``.

    A trailing ``Z`` means UTC, which is the zone all naive times are in.
    """
    text = F.regexp_replace(F.trim(F.col(column).cast("string")), "Z$", "")
    parsed = text.try_cast("timestamp_ntz") if lenient else text.cast("timestamp_ntz")
    return df.withColumn(column, parsed)


def not_nan(column: Column) -> Column:
    """NaN means missing in the source data; Spark aggregates only skip NULL."""
    return F.when(~F.isnan(column), column)


def conform(df: DataFrame, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """Cast to the declared columns, turn NaN into NULL and default ``FraudResult`` to 0
    when the column is absent."""
    out = []
    for field in schema:
        if field.name in df.columns:
            column = F.col(field.name)
            if isinstance(df.schema[field.name].dataType, (T.DoubleType, T.FloatType)):
                column = not_nan(column)
            column = column.cast(field.dataType)
            if isinstance(field.dataType, T.DoubleType):  # also the text NaN
                column = not_nan(column)
        elif field.name == "FraudResult":
            column = F.lit(0).cast(field.dataType)
        else:
            raise ValueError(f"transaction column {field.name} is missing")
        out.append(column.alias(field.name))
    return df.select(*out)
