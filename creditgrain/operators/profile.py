"""Data profiling: the relation behind each table or chart of an exploration."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import column_label, melt, numeric_columns, plotted_columns, present, string_columns
from .ranks import order_statistics, quantiles

HISTOGRAM_BINS = 50
KDE_POINTS = 200
KDE_CELLS = 1 << 14
KDE_FINE = 128
# exp(-u * u / 2) is below 1e-16 beyond this distance
KERNEL_REACH = 8.6


def _per_column(df: DataFrame, columns: Sequence[str], measures) -> DataFrame:
    """Aggregate every column in one pass over ``df``; one output row per column.

    ``measures(column)`` gives the aggregates as ``{name: expression}``.
    """
    wide = df.agg(
        *[
            F.struct(*[e.alias(name) for name, e in measures(c).items()]).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("m"))
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.column", "r.m.*")


def overview(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of each column, with the table's size."""
    table = _per_column(
        df, df.columns, lambda c: {"non_null": F.count(present(df, c)), "row_count": F.count(F.lit(1))}
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    position = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column"))
    return table.select(
        "column",
        F.element_at(F.array(*[F.lit(types[c]) for c in df.columns]), position.cast("int")).alias("dtype"),
        "non_null",
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns that have missing values, most affected first; none gives no rows."""
    table = _per_column(
        df, df.columns, lambda c: {"missing_count": F.count_if(present(df, c).isNull()), "rows": F.count(F.lit(1))}
    )
    return (
        table.where("missing_count > 0")
        .select("column", "missing_count", F.try_divide(F.col("missing_count") * 100.0, "rows").alias("missing_percent"))
        .orderBy(F.desc("missing_percent"), "column")
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column.

    A column without values, or of a table without rows, has a count of 0. The moments
    come with the first pass of the selection.
    """
    columns = list(columns or numeric_columns(df))
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = {s["column_id"]: s for s in order_statistics(melt(df, columns, "double"), "value", quartiles, ["column_id"], moments=True)}
    rows = []
    for i, name in enumerate(columns):
        s = found.get(i, {"n": 0})
        std = math.sqrt(s["m2"] / (s["n"] - 1)) if s["n"] > 1 else None
        rows.append((name, s["n"], s.get("mean"), std, *[s.get(c) for c in ("min", *quartiles, "max")]))
    numbers = ", ".join(f"{c} double" for c in ("mean", "std", "min", *quartiles, "max"))
    return df.sparkSession.createDataFrame(rows, f"column string, count long, {numbers}")


def _ranges(values: DataFrame) -> DataFrame:
    """Bounds per column; a constant column gets a width of 1 around its value."""
    bounds = values.groupBy("column_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return bounds.where("lo is not null").select(
        "column_id",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts in equal-width bins over each column's range, empty bins too; the last bin is closed.

    A value belongs to the bin whose edges, as doubles, enclose it.
    """
    columns = list(columns or plotted_columns(df))
    values = melt(df, columns, "double").where("value is not null")
    v, last = F.col("value"), bins - 1

    def edge(i: Column) -> Column:
        return F.col("lo") + i * ((F.col("hi") - F.col("lo")) / bins)

    near = F.col("near")  # division may land a value on an edge's wrong side
    number = F.when(v < edge(near), near - 1).when((v >= edge(near + 1)) & (near < last), near + 1).otherwise(near)
    share = (v - F.col("lo")) / (F.col("hi") - F.col("lo"))
    counted = (
        values.join(F.broadcast(_ranges(values)), "column_id")
        .withColumn("near", F.least(F.floor(share * bins), F.lit(last)).cast("int"))
        .groupBy("column_id", "lo", "hi", number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    bin_ = F.col("bin")
    return (
        # at most one entry per bin
        counted.groupBy("column_id", "lo", "hi")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("counts"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .select(
            column_label(columns).alias("column"),
            "bin",
            edge(bin_).alias("bin_start"),
            F.when(bin_ == last, F.col("hi")).otherwise(edge(bin_ + 1)).alias("bin_end"),
            F.coalesce(F.try_element_at("counts", bin_), F.lit(0)).alias("count"),
        )
    )


def kernel_density(
    df: DataFrame, columns: Sequence[str] | None = None, points: int = KDE_POINTS, cells: int = KDE_CELLS
) -> DataFrame:
    """Gaussian kernel density on an even grid over each column's range.

    The bandwidth h is the sample deviation times n to the power -1/5. Values are first
    reduced to cells by their count, mean and variance, which is all that is shuffled. A
    cell's kernel sum is that of its mean with the second-order term of its variance; a
    cell of equal values is exact. Cells are d = 1/``cells`` of the range wide and at most
    1/``KDE_FINE`` of h; the error at any point is below 0.03 * (d / h) ** 3 / h, and below
    1e-16 / h for values further than ``KERNEL_REACH`` bandwidths, which are left out. So
    there are at most 2 * KERNEL_REACH * KDE_FINE cells a point, or ``cells`` in all.
    Columns without spread have no density and give no rows.
    """
    columns = list(columns or plotted_columns(df))
    values = melt(df, columns, "double").where("value is not null")
    grid = (
        values.groupBy("column_id")
        .agg(
            F.min("value").alias("lo"),
            F.max("value").alias("hi"),
            F.count("value").alias("n"),
            F.stddev_samp("value").alias("std"),
        )
        .where("std > 0")
        .select(
            "column_id",
            "lo",
            "hi",
            "n",
            (F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
            ((F.col("hi") - F.col("lo")) / (points - 1)).alias("step"),
        )
    )
    width = F.least((F.col("hi") - F.col("lo")) / cells, F.col("h") / KDE_FINE)
    cell = F.floor((F.col("value") - F.col("lo")) / width)
    at = (F.col("value") - F.col("lo")) / F.col("step")
    near = F.abs(at - F.floor(at + 0.5)) * F.col("step") <= F.lit(KERNEL_REACH + 1 / KDE_FINE) * F.col("h")
    reduced = (
        values.join(F.broadcast(grid), "column_id")
        .where(near)
        .groupBy("column_id", "lo", "h", "step", cell.alias("cell"))
        .agg(F.count(F.lit(1)).alias("rows"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.min("value").alias("low"), F.max("value").alias("high"))
        # an average of equal values may be off by its last bit
        .withColumn("mean", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("mean")))
    )
    place = (F.col("mean") - F.col("lo")) / F.col("step")
    reach = F.lit(KERNEL_REACH) * F.col("h") / F.col("step")
    nearby = F.sequence(
        F.greatest(F.floor(place - reach), F.lit(0)).cast("int"),
        F.least(F.ceil(place + reach), F.lit(points - 1)).cast("int"),
    )
    u = (F.col("lo") + F.col("step") * F.col("point") - F.col("mean")) / F.col("h")
    bend = F.col("variance") / (F.col("h") * F.col("h")) / 2 * (u * u - 1)
    sums = (
        reduced.withColumn("point", F.explode(nearby))
        .groupBy("column_id", "point")
        .agg(F.sum(F.col("rows") * F.exp(-0.5 * u * u) * (1 + bend)).alias("kernel_sum"))
    )
    # one row per column and grid point, also where no kernel reaches
    return (
        grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .join(sums, ["column_id", "point"], "left")
        .select(
            column_label(columns).alias("column"),
            "point",
            (F.col("lo") + F.col("step") * F.col("point")).alias("x"),
            (
                F.coalesce("kernel_sum", F.lit(0.0))
                / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
            ).alias("density"),
        )
    )


def class_share(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent of each class in the data; 0 and 1 are listed even without rows.

    The percent is of all rows with a class.
    """
    listed = df.sparkSession.createDataFrame([(0, 0), (1, 0)], "class int, n long")
    counts = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
        .union(listed)
        .groupBy("class")
        .agg(F.sum("n").alias("count"))
    )
    total = F.sum("count").over(Window.partitionBy())  # of one row per class
    return counts.withColumn("percent", F.try_divide(F.col("count") * 100.0, total))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per value of each text column, most frequent first."""
    columns = list(columns or string_columns(df))
    return (
        melt(df, columns, "string")
        .where("value is not null")
        .groupBy("column_id", "value")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(column_label(columns).alias("column"), "value", "count")
        .orderBy("column", F.desc("count"), "value")
    )


def _fraud_counts(label: str) -> list[Column]:
    """Rows of class 0, of class 1 and of all other classes."""
    own = [F.count_if(F.col(label) == c).alias(f"fraud_{c}") for c in (0, 1)]
    return [*own, F.count_if(~F.col(label).isin(0, 1)).alias("fraud_other")]


def category_by_fraud(df: DataFrame, columns: Sequence[str] | None = None, label: str = "FraudResult") -> DataFrame:
    """Rows of each class per value of each text column."""
    columns = list(columns or string_columns(df))
    return (
        melt(df, columns, "string", keep=[label])
        .where("value is not null")
        .groupBy("column_id", "value")
        .agg(*_fraud_counts(label))
        .select(column_label(columns).alias("column"), "value", "fraud_0", "fraud_1", "fraud_other")
    )


def fraud_by(df: DataFrame, part: Column, name: str, label: str = "FraudResult") -> DataFrame:
    """Rows of each class per value of a time part, e.g. the hour of day."""
    return df.groupBy(part.alias(name)).agg(*_fraud_counts(label)).where(F.col(name).isNotNull())


def box_bounds(
    df: DataFrame,
    columns: Sequence[str],
    by: str | None = None,
    by_values: Sequence[int] = (),
) -> tuple[DataFrame, DataFrame]:
    """Unpivoted values and, per column (and class), quartiles with the fences at
    1.5 interquartile ranges. ``by_values`` lists the classes of ``by``."""
    keep = [] if by is None else [by]
    source = df if by is None else df.where(F.col(by).isin(*by_values))
    values = melt(source, columns, "double", keep=keep).where("value is not null")
    keys = [*keep, "column_id"]
    reach = (F.col("q3") - F.col("q1")) * 1.5
    bounds = quantiles(values, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys).withColumns(
        {"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach}
    )
    return values, bounds


def box_stats(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: str | None = None,
    by_values: Sequence[int] = (0, 1),
) -> DataFrame:
    """Quartiles, whiskers (furthest value inside the fences, never inside the
    box) and the number of values outside."""
    columns = list(columns or plotted_columns(df))
    values, bounds = box_bounds(df, columns, by, by_values)
    keys = [*([] if by is None else [by]), "column_id"]
    v = F.col("value")
    inside = v.between(F.col("fence_low"), F.col("fence_high"))
    stats = ["n", "q1", "median", "q3"]
    return (
        values.join(F.broadcast(bounds), keys)
        .groupBy(*keys, *stats)
        .agg(
            F.min(F.when(inside, v)).alias("_low"),
            F.max(F.when(inside, v)).alias("_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .select(
            *([] if by is None else [by]),
            column_label(columns).alias("column"),
            *stats,
            F.least("_low", "q1").alias("whisker_low"),
            F.greatest("_high", "q3").alias("whisker_high"),
            "outliers",
        )
    )


def outlier_rows(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every value outside its column's fences with the key of its row."""
    columns = list(columns or plotted_columns(df))
    _, bounds = box_bounds(df, columns)
    fences = bounds.select("column_id", "fence_low", "fence_high")
    return (
        melt(df, columns, "double", keep=[key])
        .join(F.broadcast(fences), "column_id")
        .where((F.col("value") < F.col("fence_low")) | (F.col("value") > F.col("fence_high")))
        .select(key, column_label(columns).alias("column"), "value")
    )


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key``; Spark tables have no order of their own."""
    return df.orderBy(key).limit(n)
