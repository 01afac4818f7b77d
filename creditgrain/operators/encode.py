"""Fitted encodings: median and standardising statistics, Weight of Evidence, one-hot."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import column_label, melt, numeric_columns, string_columns
from ..session import store
from .ranks import order_statistics

# The category that stands for a missing value, the smoothing
# term, and the distinct values below which an integer counts as categorical.
MISSING = "__MISSING__"
SMOOTHING = 0.001
FEW_VALUES = 50


@dataclass(frozen=True)
class NumericStats:
    """Median, and mean and population deviation after imputation, of one column."""

    feature: str
    median: float
    mean: float
    std: float

    def imputed(self, column: Column) -> Column:
        return F.coalesce(column.cast("double"), F.lit(self.median))

    def standardized(self, column: Column) -> Column:
        return (self.imputed(column) - F.lit(self.mean)) / F.lit(self.std or 1.0)


def fit_numeric(df: DataFrame, columns: Sequence[str]) -> list[NumericStats]:
    """One entry per column that has any value; all-missing columns are left out.

    The result has one row per column and is what transforms need as constants.
    """
    columns = list(columns)
    if not columns:
        return []
    fitted = []
    found = order_statistics(melt(df, columns, "double"), "value", {"median": 0.5}, ["column_id"], moments=True)
    for s in sorted(found, key=lambda s: s["column_id"]):
        if not s["n"]:
            continue
        # The medians that stand for missing values join the others as one more group.
        n = s["n"] + s["missing"]
        mean = s["mean"] + (s["median"] - s["mean"]) * (s["missing"] / n)
        m2 = s["m2"] + s["n"] * (s["mean"] - mean) ** 2 + s["missing"] * (s["median"] - mean) ** 2
        fitted.append(NumericStats(columns[s["column_id"]], s["median"], mean, math.sqrt(m2 / n)))
    return fitted


def few_valued(df: DataFrame, columns: Sequence[str], limit: int = FEW_VALUES, bits: int = 12) -> set[str]:
    """The integer columns with fewer than ``limit`` distinct values.

    Every task keeps at most ``2 ** bits`` lines a column, by a hash of the value, with the
    least and the greatest value of each, and only those are shuffled: ids of any number cost
    no more. So many lines as ``limit`` show that a column has more values; with fewer,
    and one value in each, the lines are the values. A column with few lines of which one
    has several values is looked at again with another hash of four more bits.
    """
    few, open_, salt = set(), list(columns), 0
    while open_:
        line = F.pmod(F.xxhash64(F.lit(salt), "value"), F.lit(1 << bits))
        lines = (
            melt(df, open_, "bigint")
            .where("value is not null")
            .groupBy("column_id", line.alias("line"))
            .agg(F.min("value").alias("low"), F.max("value").alias("high"))
            .groupBy("column_id")
            .agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("low") < F.col("high")).alias("shared"))
        )
        found = {open_[r.column_id]: r for r in lines.collect()}
        rows = [(c, found.get(c)) for c in open_]
        few |= {c for c, r in rows if r is None or (r.lines < limit and not r.shared)}
        # two values at least in each shared line
        open_ = [c for c, r in rows if r is not None and r.shared and r.lines + r.shared < limit]
        bits, salt = bits + 4, salt + 1
    return few


def woe_auto_columns(df: DataFrame) -> list[str]:
    """Text columns, and integer columns with few distinct values, in input order."""
    integers = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    few = few_valued(df, integers)
    text = set(string_columns(df))
    return [c for c in df.columns if c in text or c in few]


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING))


def woe_table(
    df: DataFrame, columns: Sequence[str], label: str, smoothing: float = SMOOTHING
) -> DataFrame:
    """Weight of Evidence per ``(feature, category)``.

    Good rows have label 0, bad rows label 1; a missing value is a category.
    """
    columns = list(columns)
    counts = (
        melt(df.select(label, *[_category(c).alias(c) for c in columns]), columns, "string", keep=[label])
        .groupBy("column_id", "value")
        .agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("bad"))
    )
    # Every row has a category in every column, so the totals of the first are the table's.
    # The counts are stored: one line a category, where the totals would read all rows again.
    counts = store(counts, "categories")
    first = counts.where("column_id = 0")
    all_rows = first.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    all_bad = first.agg(F.coalesce(F.sum("bad"), F.lit(0))).scalar()
    s = F.lit(smoothing)
    good_share = (F.col("n") - F.col("bad") + s) / (all_rows - all_bad + 2 * s)
    bad_share = (F.col("bad") + s) / (all_bad + 2 * s)
    return counts.select(
        column_label(columns).alias("feature"),
        F.col("value").alias("category"),
        "n",
        "bad",
        F.ln(good_share / bad_share).alias("woe"),
    )


class WoeModel:
    """A fitted Weight of Evidence table and the columns it was fitted on.

    The table is broadcast while it is small; a column with more categories than
    that is looked up by a shuffled join.
    """

    def __init__(self, columns: Sequence[str], table: DataFrame):
        self.columns = list(columns)
        self.table = table
        self._sizes: dict[str, int] | None = None

    @classmethod
    def fit(
        cls, df: DataFrame, columns: Sequence[str] | None, label: str, smoothing: float = SMOOTHING
    ) -> WoeModel:
        if columns is None:
            columns = woe_auto_columns(df.drop(label))
        present = [c for c in columns if c in df.columns]
        if not present:
            empty = df.sparkSession.createDataFrame([], "feature string, category string, n long, bad long, woe double")
            return cls(columns, empty)
        return cls(columns, store(woe_table(df, present, label, smoothing), "woe"))

    def sizes(self) -> dict[str, int]:
        if self._sizes is None:
            self._sizes = {
                r.feature: r["count"] for r in self.table.groupBy("feature").count().collect()
            }
        return self._sizes

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace categories by their weight: unseen ones and absent columns give 0."""
        out = df
        for c in self.columns:
            if c not in df.columns:
                out = out.withColumn(c, F.lit(0.0))
                continue
            weights = self.table.where(F.col("feature") == c).select(
                F.col("category").alias("_category"), F.col("woe").alias("_woe")
            )
            # Missing values are no join key: their weight is one number.
            missing = weights.where(F.col("_category") == MISSING).agg(F.coalesce(F.first("_woe"), F.lit(0.0))).scalar()
            out = (
                out.withColumn("_key", F.col(c).cast("string"))
                .join(weights, F.col("_key") == F.col("_category"), "left")
                .withColumn(c, F.when(F.col("_key").isNull(), missing).otherwise(F.coalesce("_woe", F.lit(0.0))))
                .drop("_key", "_category", "_woe")
            )
        # a joined column keeps its place
        added = [c for c in self.columns if c not in df.columns]
        return out.select(*df.columns, *added)

    def feature_names(self, input_columns: Sequence[str] | None = None) -> list[str]:
        if input_columns is None:
            return list(self.columns)
        return [c for c in input_columns if c in self.columns]

    def save(self, path: str) -> None:
        spark = self.table.sparkSession
        self.table.write.mode("overwrite").parquet(f"{path}/weights")
        rows = [(i, c) for i, c in enumerate(self.columns)]
        spark.createDataFrame(rows, "position int, feature string").write.mode("overwrite").parquet(f"{path}/columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WoeModel:
        columns = [r.feature for r in spark.read.parquet(f"{path}/columns").orderBy("position").collect()]
        return cls(columns, spark.read.parquet(f"{path}/weights"))


class OneHotModel:
    """0/1 columns ``<column>_<category>`` for the categories seen at fit.

    There is no limit: every category is a column, and its name is part of the
    schema, so the driver holds all names. For wide domains choose ``vectors``,
    which encodes the same as sparse vectors.
    """

    def __init__(self, categories: dict[str, list[str]]):
        self.categories = categories

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] | None = None) -> OneHotModel:
        columns = list(columns or string_columns(df))
        seen = (
            melt(df, columns, "string")
            .where("value is not null")
            .groupBy("column_id", "value")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("column_id", "value")
        )
        rows = seen.collect()
        categories = {c: [] for c in columns}
        for r in sorted(rows, key=lambda r: (r.column_id, r.value)):
            categories[columns[r.column_id]].append(r.value)
        return cls(categories)

    def transform(self, df: DataFrame) -> DataFrame:
        dummies = [
            F.coalesce((F.col(c) == value).cast("int"), F.lit(0)).alias(f"{c}_{value}")
            for c, values in self.categories.items()
            for value in values
        ]
        kept = [F.col(c) for c in df.columns if c not in self.categories]
        return df.select(*kept, *dummies)

    @staticmethod
    def vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Replace each column by a sparse 0/1 vector column ``<column>_vector``."""
        return OneHotVectors.fit(df, columns).transform(df)


class OneHotVectors:
    """Sparse 0/1 vectors with a place for each category seen at fit, in the order of their text.

    Categories and their places are a stored table, however many there are; the driver knows
    only how many each column has. Missing and unseen values give a vector of zeros.
    """

    def __init__(self, columns: Sequence[str], places: DataFrame, sizes: dict[str, int]):
        self.columns = list(columns)
        self.places = places
        self.sizes = sizes

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> OneHotVectors:
        columns = list(columns)
        seen = (
            melt(df, columns, "string")
            .where("value is not null")
            .groupBy("column_id", "value")
            .agg(F.count(F.lit(1)).alias("rows"))
            .select("column_id", "value")
        )
        # Ranges of categories in order, stored once: a row's number grows by one within its range.
        ranges = store(
            seen.repartitionByRange("column_id", "value")
            .sortWithinPartitions("column_id", "value")
            .select("column_id", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")),
            "categories",
        )
        # one row for each range and column
        parts = ranges.groupBy("column_id", "part").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("column_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = parts.select("column_id", "part", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        places = ranges.join(starts, ["column_id", "part"]).select("column_id", "value", (F.col("first") + F.col("at") - F.col("least")).alias("place"))
        places = store(places, "places")
        counts = {columns[r.column_id]: r["count"] for r in places.groupBy("column_id").count().collect()}
        return cls(columns, places, {c: counts.get(c, 0) for c in columns})

    def indexed(self, df: DataFrame) -> DataFrame:
        """Replace each column by its category's place ``<column>_place``; missing and unseen ones are NULL."""
        out = df
        for i, c in enumerate(self.columns):
            own = self.places.where(F.col("column_id") == i).select(F.col("value").alias("_value"), F.col("place").alias(f"{c}_place"))
            out = out.join(own, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
        return out.drop(*self.columns)

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import OneHotEncoder

        spark = df.sparkSession
        places = [f"{c}_place" for c in self.columns]
        # The place after the last stands for values without one; the encoder drops it.
        out = self.indexed(df).withColumns({p: F.coalesce(F.col(p), F.lit(self.sizes[c])).cast("double") for c, p in zip(self.columns, places, strict=True)})
        widest = spark.range(1).select(*[F.lit(float(self.sizes[c])).alias(p) for c, p in zip(self.columns, places, strict=True)])
        encoder = OneHotEncoder(inputCols=places, outputCols=[f"{c}_vector" for c in self.columns])
        return encoder.fit(widest).transform(out).drop(*places)
