"""Stratified splitting and minority oversampling with repeatable draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash60, hash_bin
from ..session import store

_BIN_BITS = 12


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: n / (classes * rows of the class)."""
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    total, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("n")).scalar()
    return counts.withColumn("weight", total.cast("double") / (classes * F.col("n")))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Each row with the balanced weight of its class; rows without a class have none.

    The weights are stored first: a table whose size Spark knows is broadcast while it is
    small, so that the rows of a class don't meet in one task.
    """
    weights = store(class_weights(df, label).select(F.col(label).alias("_class"), F.col("weight").alias("_weight")), "weights")
    joined = df.drop(name).join(weights, F.col(label) == F.col("_class"), "left")
    return joined.withColumn(name, F.col("_weight")).drop("_class", "_weight")


def test_quotas(counts: DataFrame, label: str, test_size: float) -> DataFrame:
    """Test rows (``quota``) per class, from a stored table of ``class_counts``.

    The test total is rounded up; the training rows are shared out proportionally and
    left-over ones go to the largest remainders. All in whole numbers; the remainders are
    ordered in one window over the class table, which has a row per class.
    """
    sized = counts.withColumn("_all", counts.agg(F.sum("n")).scalar())
    sized = sized.withColumn("_train", F.col("_all") - F.ceil(F.col("_all") * F.lit(test_size)))
    product = "cast(_train as decimal(19,0)) * cast(n as decimal(18,0))"
    shared = sized.withColumns({"_share": F.expr(f"({product}) div _all"), "_rest": F.expr(f"({product}) % _all")})
    every, by_rest = Window.partitionBy(), Window.orderBy(F.desc("_rest"), label)
    left = F.col("_train") - F.sum("_share").over(every)
    given = F.col("_share") + (F.row_number().over(by_rest) <= left).cast("long")
    return shared.withColumn("quota", F.col("n") - given).select(label, "n", "quota")


def assign_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split``: in each class exactly the quota of rows with the smallest
    seeded hash of ``key`` is ``test``, the rest ``train``. ``key`` is unique.

    The last test row of a class is found by counting hash bins and ordering
    only the bin it falls in, so no task sees a whole class. Quotas, bins and
    last rows are tables with a row per class; rows meet them in joins that
    Spark broadcasts while those tables are small.
    """
    columns = [c for c in df.columns if c != "split"]
    counts = store(class_counts(df.where(F.col(label).isNotNull()), label), "classes")
    quotas = store(test_quotas(counts, label, test_size).select(F.col(label).alias("_class"), "quota"), "quotas")
    hashed = df.withColumn("_h", hash60(F.col(key), seed)).withColumn("_bin", hash_bin(F.col("_h"), _BIN_BITS))
    own = F.col(label) == F.col("_class")
    in_order = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        hashed.groupBy(label, "_bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("through", F.sum("n").over(in_order))
        .join(quotas, own)
        .where("through >= quota and through - n < quota")
        .select("_class", F.col("_bin").alias("_cut"), (F.col("quota") - F.col("through") + F.col("n")).alias("place"))
    )
    by_hash = Window.partitionBy("_class").orderBy("_h", key)
    last = (
        hashed.join(store(cuts, "cuts"), own & (F.col("_bin") == F.col("_cut")))
        .withColumn("row", F.row_number().over(by_hash))
        .where("row = place")
        .select("_class", F.col("_h").alias("_last"), F.col(key).alias("_last_key"))
    )
    is_test = (F.col("_h") < F.col("_last")) | ((F.col("_h") == F.col("_last")) & (F.col(key) <= F.col("_last_key")))
    marked = hashed.join(store(last, "last-rows"), own, "left").withColumn("split", F.when(is_test, "test").otherwise("train"))
    return marked.select(*columns, "split")


def split_data(
    df: DataFrame,
    label: str,
    key: str,
    test_size: float = 0.2,
    seed: int = 42,
    drop: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows without the columns in ``drop`` (identifier, leakage)."""
    both = assign_split(df, label, key, test_size, seed)
    return tuple(
        both.where(F.col("split") == name).drop("split", *drop) for name in ("train", "test")
    )


def numbered(df: DataFrame, key: str, seed: int, name: str = "_row") -> DataFrame:
    """Number the rows 0, 1, ... in the order of the seeded hash of ``key``.

    Rows are ordered inside even hash bins, each starting after the exact
    number of rows in the bins before.
    """
    hashed = df.withColumn("_h", hash60(F.col(key), seed)).withColumn("_bin", hash_bin(F.col("_h"), _BIN_BITS))
    # one row per bin, 2**_BIN_BITS at most
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        hashed.groupBy("_bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_bin").orderBy("_h", key)
    return (
        hashed.join(F.broadcast(starts), "_bin")
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .select(*df.columns, name)
    )


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Add random copies of the smallest class until it is as large as the largest.

    One class, or classes of equal size, come back unchanged; with three or more
    classes only the smallest grows. Draw ``i`` takes row md5(i:seed) mod n.
    """
    counts = class_counts(df.where(F.col(label).isNotNull()), label)
    least, most = counts.agg(F.min(F.struct("n", F.col(label).alias("label"))), F.max("n")).first()
    if least is None or least.n == most:
        return df
    smallest, n = least.label, least.n
    deficit = most - n
    pool = numbered(df.where(F.col(label) == smallest), key, seed)
    draws = df.sparkSession.range(deficit).select((hash60(F.col("id"), seed) % n).alias("_row"))
    # Rows are drawn so evenly that no key is hot; Spark measures whether to broadcast.
    copies = draws.join(pool, "_row")
    return df.unionByName(copies.drop("_row"))


def shuffle_rows(df: DataFrame, key: str, seed: int = 42, position: str | None = None) -> DataFrame:
    """Rows in the random but repeatable order of a seeded hash; ``position`` names a
    column with each row's place, from 0."""
    if position:
        return numbered(df, key, seed, position).orderBy(position)
    return df.orderBy(hash60(F.col(key), seed), key)
