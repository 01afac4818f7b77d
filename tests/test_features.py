import math
import random
import statistics
from collections import Counter

import pytest
from records import by_account
from pyspark.sql import functions as F

from creditgrain.operators import features
from creditgrain.operators.features import FEATURES, customer_features, rfm_summary
from creditgrain.plans import catalog
from creditgrain.schema import TRANSACTIONS, with_string_ids
from creditgrain.sources import adapters, conform, line_facts, txns_from_lines

# The account features of the ten-transaction example.
GOLDEN = {
    "Recency": (10, 4, 0, 12),
    "Frequency": (4, 2, 2, 2),
    "Monetary": (750.0, 75.0, 620.0, 155.0),
    "HasFraud": (0, 1, 1, 0),
    "AvgAmount": (187.5, 37.5, 310.0, 77.5),
    "MaxValue": (300.0, 50.0, 500.0, 80.0),
    "MinAmount": (100.0, 25.0, 120.0, 75.0),
    "StdAmount": (85.39125638, 17.67766953, 268.70057685, 3.53553391),
    "TotalFraudTransactions": (0, 1, 1, 0),
    "UniqueProductCategories": (2, 1, 1, 2),
    "UniqueChannels": (2, 1, 2, 2),
    "UniqueProviders": (2, 2, 1, 1),
    "UniqueCurrencies": (1, 1, 1, 1),
    "UniqueCountries": (1, 1, 1, 1),
    "MostFrequentChannel": ("Web", "IOS", "Android", "Android"),
    "MostFrequentProductCategory": ("A", "C", "D", "A"),
    "MostFrequentCurrencyCode": ("KES", "USD", "KES", "KES"),
    "MostFrequentCountryCode": (254, 1, 254, 254),
    "MostFrequentProviderId": (1, 1, 3, 1),
    "MostFrequentPricingStrategy": (0, 2, 1, 0),
    "AvgTransactionHour": (0.0, 0.0, 0.0, 0.0),
    "AvgTransactionDayOfMonth": (3.5, 11.0, 15.5, 3.5),
    "AvgTransactionDayOfWeek": (2.5, 3.0, 0.5, 2.5),
    "AvgTransactionMonth": (1.0, 1.0, 1.0, 1.0),
    "AvgTransactionYear": (2024.0, 2024.0, 2024.0, 2024.0),
    "MinTransactionHour": (0, 0, 0, 0),
    "MaxTransactionHour": (0, 0, 0, 0),
}


def test_golden_features(ten):
    df = customer_features(ten)
    assert df.columns == ["AccountId", *FEATURES] and len(df.columns) == 28
    got = by_account(df)
    assert sorted(got) == [1001, 1002, 1003, 1004]
    for column, expected in GOLDEN.items():
        for account, value in zip((1001, 1002, 1003, 1004), expected, strict=True):
            found = got[account][column]
            assert found == (pytest.approx(value, abs=1e-7) if isinstance(value, float) else value), column


def test_signed_average_in_summary(ten):
    got = by_account(rfm_summary(ten))
    assert got[1002]["AvgAmount"] == -37.5 and got[1002]["MaxValue"] == 50.0


def test_own_reference_time_gives_recency_zero(ten):
    got = by_account(customer_features(ten, "account", ["Recency"]))
    assert {r["Recency"] for r in got.values()} == {0}


def test_given_reference_time_rounds_down(make):
    txns = make({"TransactionStartTime": "2024-01-10 12:00:00"})
    assert customer_features(txns, "2024-01-11 11:59:59", ["Recency"]).first().Recency == 0
    assert customer_features(txns, "2024-01-11 12:00:00", ["Recency"]).first().Recency == 1
    assert customer_features(txns, "2024-01-10 11:00:00", ["Recency"]).first().Recency == -1


def test_no_result_depends_on_the_session_time_zone(spark, make):
    # clocks in New York skip an hour between these times
    txns = make(
        {"AccountId": 1, "TransactionStartTime": "2024-03-09 12:00:00"},
        {"AccountId": 2, "TransactionStartTime": "2024-03-10 12:00:00"},
    )
    utc = by_account(customer_features(txns))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        there = by_account(customer_features(txns))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert there == utc and utc[1]["Recency"] == 1


def test_recency_counts_full_days_across_midnight(make):
    txns = make(
        {"AccountId": 1, "TransactionStartTime": "2024-03-01 02:00:00"},
        {"AccountId": 2, "TransactionStartTime": "2024-03-02 00:00:00"},
    )
    assert by_account(customer_features(txns, columns=["Recency"]))[1]["Recency"] == 0


def test_missing_values_and_keys(make):
    txns = make(
        {"AccountId": None, "TransactionStartTime": "2024-06-01"},
        {"AccountId": 1, "Value": None, "CurrencyCode": None, "FraudResult": None, "ProviderId": None},
        {"AccountId": 2, "Value": float("nan"), "TransactionStartTime": "2024-05-31"},
        {"AccountId": 2, "Value": 5.0, "TransactionStartTime": "2024-05-30"},
    )
    got = by_account(customer_features(txns))
    assert sorted(got) == [1, 2]
    one, two = got[1], got[2]
    assert one["Monetary"] == 0 and one["StdAmount"] == 0 and one["AvgAmount"] is None
    assert one["HasFraud"] == 0 and one["TotalFraudTransactions"] == 0
    assert one["UniqueCurrencies"] == 0 and one["MostFrequentCurrencyCode"] is None
    assert one["UniqueProviders"] == 0 and one["MostFrequentProviderId"] is None
    # the latest time counts even where the account is unknown
    assert two["Recency"] == 1
    assert two["Monetary"] == 5.0 and two["MaxValue"] == 5.0 and two["StdAmount"] == 0


def test_account_without_any_attribute_is_kept(make):
    nothing = dict.fromkeys(
        ("ProductCategory", "ChannelId", "ProviderId", "CurrencyCode", "CountryCode", "PricingStrategy")
    )
    row = customer_features(make({"AccountId": 7} | nothing)).first()
    assert row.Frequency == 1 and row.UniqueChannels == 0 and row.MostFrequentPricingStrategy is None


def test_string_ids(ten):
    named = ten.withColumn("AccountId", F.concat(F.lit("A_"), "AccountId")).withColumn(
        "ProviderId", F.concat(F.lit("P_"), "ProviderId")
    )
    got = by_account(customer_features(conform(named, with_string_ids(TRANSACTIONS))))
    assert got["A_1001"]["MostFrequentProviderId"] == "P_1" and got["A_1003"]["UniqueProviders"] == 1


def test_unknown_feature_is_refused(ten):
    with pytest.raises(ValueError, match="unknown features"):
        customer_features(ten, columns=["Recensy"])


def test_one_account_with_most_rows_matches_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(3000):
        account = 1 if i % 3 == 0 else draw.randrange(2, 40)
        rows.append((i, account, f"c{draw.randrange(9)}", draw.randrange(400), round(draw.uniform(1, 99), 2)))
    base = spark.createDataFrame(rows, "TransactionId long, AccountId long, ChannelId string, ProviderId long, Value double")
    extra = {
        f.name: F.lit(None).cast(f.dataType) for f in TRANSACTIONS if f.name not in base.columns
    } | {"TransactionStartTime": F.lit("2024-01-01").cast("timestamp_ntz"), "FraudResult": F.lit(0)}
    got = by_account(customer_features(conform(base.withColumns(extra))))
    for account in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == account]
        for position, unique, mode in ((2, "UniqueChannels", "MostFrequentChannel"), (3, "UniqueProviders", "MostFrequentProviderId")):
            counts = Counter(r[position] for r in mine)
            assert got[account][unique] == len(counts)
            assert got[account][mode] == min(v for v, n in counts.items() if n == max(counts.values()))
        values = [r[4] for r in mine]
        assert got[account]["Frequency"] == len(mine)
        assert math.isclose(got[account]["Monetary"], sum(values))
        assert math.isclose(got[account]["StdAmount"], statistics.stdev(values))


def test_spread_accounts_have_the_same_features(make, monkeypatch):
    """Accounts of many rows are taken apart over several tasks; missing values and ties included."""
    rows = [
        {"AccountId": a, "ProviderId": i % 7, "ChannelId": None if i % 5 == 0 else f"c{i % 4}", "CurrencyCode": None, "Value": float(i % 11), "Amount": float(i % 11)}
        for a, n in ((1, 90), (2, 4), (None, 3))
        for i in range(n)
    ]
    txns = make(*rows)
    plain = {r.AccountId: r for r in customer_features(txns).collect()}
    monkeypatch.setattr(features, "HEAVY_ROWS", 10)
    spread = {r.AccountId: r for r in customer_features(txns).collect()}
    assert spread.keys() == plain.keys() == {1, 2}
    for account, row in plain.items():
        for name, value in row.asDict().items():
            assert spread[account][name] == (pytest.approx(value) if isinstance(value, float) else value), name


def test_a_transaction_is_shuffled_once_for_all_attributes(spark, tmp_path):
    """Where no rows of an account stand together, before: a shuffled row for each attribute of each row."""
    n = 2000
    ids = spark.range(n)
    txns = ids.select(
        F.col("id").alias("TransactionId"), (F.col("id") % 500).alias("AccountId"), F.lit(1.0).alias("Value"), F.lit(1.0).alias("Amount"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("TransactionStartTime"), F.lit(0).alias("FraudResult"),
        *[F.concat(F.lit(c), F.col("id")).alias(c) for c in ("ProductCategory", "ChannelId", "CurrencyCode")],
        *[F.col("id").alias(c) for c in ("ProviderId", "CountryCode", "PricingStrategy")],
    )
    txns.write.parquet(str(tmp_path / "t"))
    found = customer_features(spark.read.parquet(str(tmp_path / "t")), columns=[c for c in FEATURES if c.startswith("MostFrequent")])
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    stacked = plan[plan.index("Generate stack(") :]
    # the lines of a row are made after the rows of an account have met
    assert "hashpartitioning(AccountId" in stacked.split("Scan parquet")[0]


def test_stored_lines_hold_each_value_once(spark):
    d = "/root/testdata/sf0.001"
    txns, stored = txns_from_lines(spark, d), catalog.lines(spark, d)
    assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]
    assert stored.exceptAll(txns).isEmpty() and txns.exceptAll(stored).isEmpty()
    # before: 16 columns, some of which are others over again
    names = line_facts(spark, d).columns
    assert spark.read.parquet(*stored.inputFiles()).columns == names and len(set(names)) == 14


def test_a_transaction_is_shuffled_once_for_all_features(spark):
    """Before: once for the measures, once for the attributes, and the counts of values were sorted."""
    plan = customer_features(catalog.lines(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().sparkPlan().toString()
    branches = plan[plan.index("Union") :].split("\n+- ")
    light = branches[0]
    assert light.count("AccountId") and light.count("hashpartitioning") <= 1
    assert "ObjectHashAggregate" in light and "Generate" not in light and "Join" not in light


def test_tasks_grow_with_the_rows(make, monkeypatch):
    """Before: as many as shuffle partitions, or fewer, however many rows each had to sort."""
    monkeypatch.setattr(features, "TASK_ROWS", 10)
    txns = make(*[{"AccountId": i % 50, "Value": 1.0, "Amount": 1.0} for i in range(400)])
    shuffles = customer_features(txns)._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM, " in shuffles and "hashpartitioning(AccountId" in shuffles
    assert f"{-(-400 // 10)}), REPARTITION_BY_NUM" in shuffles and "REPARTITION_BY_COL" not in shuffles


def test_tasks_of_the_line_join_grow_with_the_lines(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    plain = line_facts(spark, d)
    monkeypatch.setattr(adapters, "TASK_ROWS", 100)
    cut = line_facts(spark, d)
    plan = cut._jdf.queryExecution().sparkPlan().toString()
    tasks = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 100)
    for key in ("l_orderkey", "o_orderkey"):
        assert any(f"hashpartitioning({key}" in line and f"{tasks}), REPARTITION_BY_NUM" in line for line in plan.split("\n"))
    assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()


def test_of_a_discount_only_the_price_step_is_shuffled(spark):
    plan = line_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("l_discount")


def test_modes_and_distinct_counts_of_odd_values(make):
    """Text in the order of its bytes, extreme numbers, repeated rows, missing values outnumbering others."""
    rows = [
        {"AccountId": 1, "ChannelId": c, "ProviderId": p}
        for c, p in (("é", 2**63 - 1), ("z", -(2**63)), ("", 0), ("é", -(2**63)), ("z", 2**63 - 1), (None, None), (None, None), (None, None))
    ]
    row = customer_features(make(*rows)).first()
    assert row.MostFrequentChannel == "z" and row.UniqueChannels == 3
    assert row.MostFrequentProviderId == -(2**63) and row.UniqueProviders == 3
