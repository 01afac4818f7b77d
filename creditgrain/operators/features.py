"""Account features from transactions."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import whole_days_between, with_time_parts
from ..schema import ACCOUNT

# source column, its distinct-count feature, its most-frequent-value feature
ATTRIBUTES = (
    ("ProductCategory", "UniqueProductCategories", "MostFrequentProductCategory"),
    ("ChannelId", "UniqueChannels", "MostFrequentChannel"),
    ("ProviderId", "UniqueProviders", "MostFrequentProviderId"),
    ("CurrencyCode", "UniqueCurrencies", "MostFrequentCurrencyCode"),
    ("CountryCode", "UniqueCountries", "MostFrequentCountryCode"),
    ("PricingStrategy", None, "MostFrequentPricingStrategy"),
)

FEATURES = (
    "Recency",
    "Frequency",
    "Monetary",
    "HasFraud",
    "AvgAmount",
    "MaxValue",
    "MinAmount",
    "StdAmount",
    "TotalFraudTransactions",
    "UniqueProductCategories",
    "UniqueChannels",
    "UniqueProviders",
    "UniqueCurrencies",
    "UniqueCountries",
    "MostFrequentChannel",
    "MostFrequentProductCategory",
    "MostFrequentCurrencyCode",
    "MostFrequentCountryCode",
    "MostFrequentProviderId",
    "MostFrequentPricingStrategy",
    "AvgTransactionHour",
    "AvgTransactionDayOfMonth",
    "AvgTransactionDayOfWeek",
    "AvgTransactionMonth",
    "AvgTransactionYear",
    "MinTransactionHour",
    "MaxTransactionHour",
)

RFM_SUMMARY = (
    "Recency",
    "Frequency",
    "Monetary",
    "TotalFraudTransactions",
    "HasFraud",
    "AvgAmount",
    "MaxValue",
    "UniqueProductCategories",
    "UniqueChannels",
)

ReferenceTime = str | dt.datetime

# Accounts are counted in groups by a hash; those of a group of more rows are spread over tasks.
GROUPS = 1 << 16
HEAVY_ROWS = 1 << 20
SPREAD = 64
# Rows of a task that sorts accounts, so that its sort stays in memory whatever the input's size;
# below the second number a task is not worth its start.
TASK_ROWS = 1 << 18
LEAST_ROWS = 1 << 14
# More measures than this are wider as partial sums than as the columns they come from.
FEW_MEASURES = 8


def _measures(amount_for_average: str) -> dict[str, tuple[str, Column]]:
    """Feature -> (aggregate column, aggregate). Several features share ``_fraud``."""
    value = F.col("Value")
    fraud = F.coalesce(F.sum("FraudResult"), F.lit(0))
    return {
        "Recency": ("_last", F.max("TransactionStartTime")),
        "Frequency": ("Frequency", F.count("TransactionId")),
        "Monetary": ("Monetary", F.coalesce(F.sum(value), F.lit(0.0))),
        "HasFraud": ("_fraud", fraud),
        "TotalFraudTransactions": ("_fraud", fraud),
        "AvgAmount": ("AvgAmount", F.avg(amount_for_average)),
        "MaxValue": ("MaxValue", F.max(value)),
        "MinAmount": ("MinAmount", F.min(value)),
        "StdAmount": ("StdAmount", F.coalesce(F.stddev_samp(value), F.lit(0.0))),
        "AvgTransactionHour": ("AvgTransactionHour", F.avg("TransactionHour")),
        "AvgTransactionDayOfMonth": ("AvgTransactionDayOfMonth", F.avg("TransactionDayOfMonth")),
        "AvgTransactionDayOfWeek": ("AvgTransactionDayOfWeek", F.avg("TransactionDayOfWeek")),
        "AvgTransactionMonth": ("AvgTransactionMonth", F.avg("TransactionMonth")),
        "AvgTransactionYear": ("AvgTransactionYear", F.avg("TransactionYear")),
        "MinTransactionHour": ("MinTransactionHour", F.min("TransactionHour")),
        "MaxTransactionHour": ("MaxTransactionHour", F.max("TransactionHour")),
    }


def _recency(txns: DataFrame, reference_time: ReferenceTime, last: Column) -> Column:
    if reference_time == "account":
        now = last
    elif reference_time == "global":
        # a scalar subquery: one extra pass over the time column alone
        now = txns.select(F.max("TransactionStartTime")).scalar()
    else:
        now = F.lit(str(reference_time)).cast("timestamp_ntz")
    return whole_days_between(now, last)


def customer_features(
    txns: DataFrame,
    reference_time: ReferenceTime = "global",
    columns: Sequence[str] = FEATURES,
    amount_for_average: str = "Value",
) -> DataFrame:
    """One row per account with the requested ``columns``.

    ``reference_time`` sets what recency counts back from: the latest
    transaction of the whole input (``"global"``), the account's own latest one
    (``"account"``, so recency is 0) or a given time. A given time saves the
    pass that looks for the latest one.

    Rows are shuffled once, with the columns that the features need, and all features
    of an account are made where its rows have met. Accounts in a hash group of more
    than ``HEAVY_ROWS`` rows (``_heavy``) are kept apart: they are spread over ``SPREAD``
    tasks, so none waits for a third of all rows, and their distinct counts and modes
    come from counts per (account, attribute, value). So a buffer holds the values of
    ``HEAVY_ROWS`` rows at most. The accounts are counted when this is called: there are as
    many tasks as ``TASK_ROWS`` rows each ask for.
    """
    unknown = [c for c in columns if c not in FEATURES]
    if unknown:
        raise ValueError(f"unknown features: {', '.join(unknown)}")
    needed = [a for a in ATTRIBUTES if a[1] in columns or a[2] in columns]
    measures = _measures(amount_for_average)
    # Frequency always: a grouping needs at least one aggregate
    aggregates = dict(m for f, m in measures.items() if f in columns or f == "Frequency")

    plain = txns.where(F.col(ACCOUNT).isNotNull())
    measured = [a.alias(n) for n, a in aggregates.items()]
    if needed:
        heavy, light_tasks, heavy_tasks = _heavy(plain)
        grouped = _light_features(plain.where(~heavy), measured, needed, light_tasks)
        grouped = grouped.unionByName(_heavy_features(plain.where(heavy), measured, needed, heavy_tasks))
    elif len(aggregates) > FEW_MEASURES:
        heavy, light_tasks, heavy_tasks = _heavy(plain)
        grouped = with_time_parts(_spread(plain, heavy, light_tasks + heavy_tasks)).groupBy(ACCOUNT).agg(*measured)
    else:
        grouped = with_time_parts(plain).groupBy(ACCOUNT).agg(*measured)

    final = {
        "Recency": lambda: _recency(txns, reference_time, F.col("_last")),
        "HasFraud": lambda: (F.col("_fraud") > 0).cast("int"),
        "TotalFraudTransactions": lambda: F.col("_fraud"),
    }
    return grouped.select(
        ACCOUNT, *[(final[c]() if c in final else F.col(c)).alias(c) for c in columns]
    )


def _heavy(rows: DataFrame) -> tuple[Column, int, int]:
    """Whether an account is in a group of more than ``HEAVY_ROWS`` rows, and the tasks for the
    rows of other accounts and of such."""
    group = F.pmod(F.xxhash64(ACCOUNT), F.lit(GROUPS))
    # one extra pass over the accounts, of which a count a group leaves a task
    many = F.col("_n") > HEAVY_ROWS
    found = (
        rows.groupBy(group.alias("_group"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(*[F.coalesce(F.sum(F.when(own, F.col("_n"))), F.lit(0)) for own in (~many, many)], F.collect_list(F.when(many, F.col("_group"))))
        .first()
    )
    cores = rows.sparkSession.sparkContext.defaultParallelism
    light, heavy = (max(1, math.ceil(n / TASK_ROWS), min(cores, math.ceil(n / LEAST_ROWS))) for n in found[:2])
    # no group has the number -1
    return group.isin(-1, *found[2]), light, heavy


def _part(heavy: Column, own: Column) -> Column:
    """0, or for heavy accounts one of ``SPREAD`` numbers by the hash ``own``."""
    return F.when(heavy, F.pmod(own, F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("bigint"))


def _spread(rows: DataFrame, heavy: Column, tasks: int) -> DataFrame:
    """Rows of an account in one task, those of heavy accounts in ``SPREAD``: partial sums of
    many measures are several times as wide as a transaction."""
    own = F.xxhash64("TransactionId", "TransactionStartTime", "Value")
    return rows.withColumn("_part", _part(heavy, own)).repartition(tasks, ACCOUNT, "_part")


def _light_features(rows: DataFrame, measured: Sequence[Column], attributes: Sequence[tuple], tasks: int) -> DataFrame:
    """Measures, distinct counts and modes (most rows, then smallest value) of accounts of few
    rows, which meet in one task. They are sorted by account there, not by its values."""
    found = []
    for name, distinct, mode in attributes:
        found.append(F.mode(name, True).alias(mode))
        if distinct:
            found.append(F.size(F.collect_set(name)).cast("bigint").alias(distinct))
    # of the id, only whether there is one is counted
    met = rows.withColumn("TransactionId", F.when(F.col("TransactionId").isNotNull(), F.lit(True))).repartition(tasks, ACCOUNT)
    return with_time_parts(met).groupBy(ACCOUNT).agg(*measured, *found)


def _heavy_features(rows: DataFrame, measured: Sequence[Column], attributes: Sequence[tuple], tasks: int) -> DataFrame:
    """The same for accounts of many rows, each spread over several tasks."""
    grouped = with_time_parts(_spread(rows, F.lit(True), tasks)).groupBy(ACCOUNT).agg(*measured)
    grouped = grouped.join(_attribute_features(rows, attributes, tasks), ACCOUNT, "left")
    # an account whose values are all missing has no distinct ones
    return grouped.fillna(0, [distinct for _, distinct, _ in attributes if distinct])


def _attribute_features(rows: DataFrame, attributes: Sequence[tuple], tasks: int) -> DataFrame:
    """Distinct counts and modes per account, from counts of its values.

    A row becomes a line for each attribute before it is shuffled, so that all lines of a
    value go to the part that the value says: every count is whole where it is made.
    """
    names = [name for name, _, _ in attributes]
    types = {name: rows.schema[name].dataType for name in names}
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    kinds = [F.lit(None).cast(types[name]) for name in names]
    taken_apart = [
        F.struct(F.lit(i).alias("slot"), *[(F.col(n) if n == name else none).alias(n) for n, none in zip(names, kinds, strict=True)])
        for i, name in enumerate(names)
    ]
    lines = (
        rows.select(ACCOUNT, F.explode(F.array(*taken_apart)).alias("_line"))
        .select(ACCOUNT, "_line.*", _part(F.lit(True), F.xxhash64("_line")).alias("_part"))
        .repartition(tasks * len(names), ACCOUNT, "_part")
    )
    slots: list[Column] = []
    for i, name in enumerate(names):
        if isinstance(types[name], T.StringType):
            slots += [F.lit(i), F.col(name), no_number]
        else:
            slots += [F.lit(i), no_text, F.col(name).cast("bigint")]
    counts = (
        lines.select(ACCOUNT, "_part", F.stack(F.lit(len(names)), *slots).alias("_slot", "_text", "_number"))
        .where("_text is not null or _number is not null")
        .groupBy(ACCOUNT, "_part", "_slot", "_text", "_number")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    found, merged = [], []
    for i, (name, distinct, mode) in enumerate(attributes):
        here = F.col("_slot") == i
        value = F.col("_text") if isinstance(types[name], T.StringType) else F.col("_number")
        found.append(F.min(F.when(here, F.struct((-F.col("_n")).alias("order"), value.alias("value")))).alias(mode))
        merged.append(F.min(mode).getField("value").cast(types[name]).alias(mode))
        if distinct:
            found.append(F.count(F.when(here, F.lit(1))).alias(distinct))
            merged.append(F.sum(distinct).alias(distinct))
    # an account's parts have no value in common
    return counts.groupBy(ACCOUNT, "_part").agg(*found).groupBy(ACCOUNT).agg(*merged)


def rfm_summary(txns: DataFrame, reference_time: ReferenceTime = "global") -> DataFrame:
    """The reduced account table used for exploration; its ``AvgAmount`` is the
    mean of the signed amounts."""
    return customer_features(txns, reference_time, RFM_SUMMARY, amount_for_average="Amount")
