"""Stored train and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import current_version, new_version, publish


def save_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table that has a ``split`` column, one folder per set, and publish it.

    Readers see the sets of the write before until both new ones are there.
    """
    version = new_version(path)
    writer = df.write.partitionBy("split")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(version)
    publish(df.sparkSession, path, version)


def load_splits(
    spark: SparkSession, path: str, target: str, schema=None, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """The stored train and test sets; features and target stay in one row.

    The filter on ``split`` prunes folders, so each set reads only its files.
    CSV needs the ``schema`` it was written with.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    both = reader.format(fmt).load(current_version(spark, path))
    if target not in both.columns:
        raise ValueError(f"target column {target} is not in {path}")
    return tuple(both.where(F.col("split") == name).drop("split") for name in ("train", "test"))
