"""Exact quantiles and running sums without gathering a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
buffer, and a running sum over a whole table is a window with one partition.

Quantiles are found by radix selection: a double's bits, as an integer of the
same order, are counted 16 at a time, for all columns and quantiles at once.
Counts by leading digits say in which of them a rank lies; the next pass counts
the next digits of the values that start with those. Four passes are enough for
any data, and a pass without further digits to tell apart ends the search. Only
counts are shuffled.

The input is read more than once, so it has to give the same values each time:
pass source columns or a stored table (``session.store``), not sums of doubles
that a retried task may add up in another order.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits counted in a pass, and how many values left are few enough to count by all their bits.
DIGIT = 16
FEW = 100_000
SKETCH_ACCURACY = 10_000

BINS = 256
_SEARCH_STEPS = [1 << s for s in reversed(range(BINS.bit_length() - 1))]

_INFINITY = struct.unpack("<q", struct.pack("<d", math.inf))[0]


def with_sort_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add an integer that orders as the DOUBLE column does: its bits, negated below 0.

    SQL has no cast to bits, so they are put together from the exponent and the exact
    quotient by its power of two. The logarithm may be off by one beside powers of two.
    """
    parts = (
        df.withColumn("_size", F.abs(F.col(value)))
        .withColumn("_power", F.expr("cast(least(greatest(floor(log2(_size)), -1022), 1023) as int)"))
        .withColumn("_share", F.expr("_size / pow(2D, _power)"))
    )
    unit = "4503599627370496"  # 2 ** 52
    bits = F.expr(
        f"""case when _size = 0 then 0L when _size = double('infinity') then {_INFINITY}L
        when _share >= 2 then (_power + 1024) * {unit}L + cast((_share / 2 - 1) * {unit}D as bigint)
        when _share >= 1 then (_power + 1023) * {unit}L + cast((_share - 1) * {unit}D as bigint)
        when _power > -1022 then (_power + 1022) * {unit}L + cast((_share * 2 - 1) * {unit}D as bigint)
        else cast(_share * {unit}D as bigint) end"""
    )
    key = F.when(F.col(value) < 0, -bits).otherwise(bits)
    # Generated, so that later uses read the key and don't put it together again.
    return parts.select(*df.columns, F.explode(F.array(key)).alias(name))


def key_value(key: int) -> float:
    """The double of a sort key."""
    size = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -size if key < 0 else size


def order_statistics(
    df: DataFrame, value: str, probabilities: dict[str, float], keys: Sequence[str], moments: bool = False
) -> list[dict]:
    """Exact quantiles of a DOUBLE column with linear interpolation, a dict per key.

    The dicts have the key columns, ``n`` and ``missing`` (values and NULLs) and the names
    of ``probabilities``, which are None without values; with ``moments`` also ``mean``,
    ``m2`` (the sum of squared deviations), ``min`` and ``max``, from the first pass.
    ``keys`` are column numbers and class labels: the driver gets at most ``2 ** DIGIT``
    counts for each of them and pass.
    """
    spark = df.sparkSession
    fields = [df.select(*keys).schema[k] for k in keys]
    keyed = with_sort_key(df.select(*keys, F.col(value).alias("_v")), "_v", "_key")
    extra = {"mean": F.avg("_v"), "m2": F.var_pop("_v") * F.count("_v")} if moments else {}

    def counted(rows: DataFrame, shift: int, more: dict[str, Column]) -> dict[tuple, list]:
        found = rows.groupBy(*keys, F.shiftright("_key", shift).alias("_at")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_low"), F.max("_key").alias("_high"), *[e.alias(f"_{m}") for m, e in more.items()]
        )
        out = defaultdict(list)
        for r in found.collect():
            out[tuple(r[k] for k in keys)].append(r)
        return out

    stats, wanted, ranks = {}, defaultdict(list), {}  # wanted: by (key, digits so far), the (rank, rank among those)
    for key, rows in counted(keyed, 64 - DIGIT, extra).items():
        present = sorted((r for r in rows if r["_at"] is not None), key=lambda r: r["_at"])
        n = sum(r["_n"] for r in present)
        stat = stats[key] = dict(zip(keys, key, strict=True)) | {"n": n, "missing": sum(r["_n"] for r in rows) - n}
        if moments:
            stat |= dict.fromkeys(("mean", "m2", "min", "max"))
        if moments and n:
            low, high = key_value(present[0]["_low"]), key_value(present[-1]["_high"])
            about = low if low == high else present[0]["_mean"]  # so that equal values have no deviation
            mean = about if low == high else about + sum(r["_n"] * (r["_mean"] - about) for r in present) / n
            m2 = 0.0 if low == high else sum(r["_m2"] + r["_n"] * (r["_mean"] - mean) ** 2 for r in present)
            stat |= {"mean": mean, "m2": m2, "min": low, "max": high}
        if n:
            places = {f((n - 1) * p) for p in probabilities.values() for f in (math.floor, math.ceil)}
            ranks[key] = _located(present, [(p, p) for p in sorted(places)], wanted, key)

    shift = 64 - DIGIT
    while wanted:
        left = sum(rows for rows, _ in wanted.values())
        table = spark.createDataFrame([(*key, at) for key, at in wanted], T.StructType([*fields, T.StructField("_at", T.LongType())]))
        rows = keyed.withColumn("_at", F.shiftright("_key", shift)).join(F.broadcast(table), [*keys, "_at"]).drop("_at")
        before, shift = shift, 0 if left <= FEW else shift - DIGIT
        groups = counted(rows, shift, {})
        following = defaultdict(list)
        for (key, at), (_, places) in wanted.items():
            inside = sorted((r for r in groups[key] if r["_at"] >> (before - shift) == at), key=lambda r: r["_at"])
            ranks[key] |= _located(inside, places, following, key)
        wanted = following

    for key, found in ranks.items():
        for name, p in probabilities.items():
            place = (stats[key]["n"] - 1) * p
            low, high = found[math.floor(place)], found[math.ceil(place)]
            share = place - math.floor(place)
            stats[key][name] = low + (high - low) * share if share else low
    return [dict.fromkeys(probabilities) | stat for stat in stats.values()]


def _located(rows: list, places: list[tuple[int, int]], wanted: dict, key: tuple) -> dict[int, float]:
    """The values of the ranks that lie among equal values; others are added to ``wanted``.

    ``rows`` are counts in ascending order, ``places`` (rank, rank among these rows).
    """
    found, below, left = {}, 0, list(places)
    for r in rows:
        here = [(rank, place - below) for rank, place in left if place < below + r["_n"]]
        if here:
            left = left[len(here) :]
            if r["_low"] == r["_high"]:
                found |= dict.fromkeys((rank for rank, _ in here), key_value(r["_low"]))
            else:
                wanted[key, r["_at"]] = (r["_n"], here)
        below += r["_n"]
    return found


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """The quantiles of ``order_statistics`` as a table with ``n``, a row for each key that has values."""
    fields = [df.select(*keys).schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), *[T.StructField(p, T.DoubleType()) for p in probabilities]])
    found = [s for s in order_statistics(df, value, probabilities, keys) if s["n"]]
    return df.sparkSession.createDataFrame([tuple(s[c] for c in schema.names) for s in found], schema)


def _position(value: Column, ascending: Column) -> Column:
    """How many of the sorted ``ascending`` values lie below ``value`` (binary search)."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in _SEARCH_STEPS]),
        F.lit(0),
        lambda at, step: F.when(F.get(ascending, at + step - 1) < value, at + step).otherwise(at),
    )


def running_sums(counts: DataFrame, value: str, measures: Sequence[str]) -> DataFrame:
    """Add ``<m>_below`` (sum of ``m`` over all smaller values) and ``<m>_total``.

    ``counts`` has one row per distinct value. The value range is cut into
    ``BINS`` parts with about equally many values; each is ordered by itself and
    starts from the exact sum of the parts below.
    """
    pivots = counts.agg(
        F.percentile_approx(value, [i / BINS for i in range(1, BINS)], SKETCH_ACCURACY)
    ).scalar()
    parts = (
        counts.withColumn("_pivots", pivots)
        .withColumn("_bin", _position(F.col(value), F.col("_pivots")))
        .groupBy("_bin")
        .agg(F.max(value).alias("top"), *[F.sum(m).alias(m) for m in measures])
    )
    # at most BINS rows, and then as many structs in one row
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = parts.select(
        F.struct(
            "top",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_below") for m in measures],
            *measures,
        ).alias("cut")
    ).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))

    out = counts.withColumn("_cuts", cuts.scalar()).withColumn(
        "_bin", _position(F.col(value), F.col("_cuts.top"))
    )
    mine, last = F.get("_cuts", F.col("_bin")), F.element_at("_cuts", -1)
    out = out.withColumns(
        {f"_base_{m}": mine[f"{m}_below"] for m in measures}
        | {f"{m}_total": last[f"{m}_below"] + last[m] for m in measures}
    ).drop("_cuts")
    inside = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    for m in measures:
        out = out.withColumn(f"{m}_below", F.sum(m).over(inside) - F.col(m) + F.col(f"_base_{m}"))
    return out.drop("_bin", *[f"_base_{m}" for m in measures])
