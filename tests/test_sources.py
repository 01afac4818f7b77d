import datetime as dt
import json

import pytest
from records import records
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from creditgrain.schema import TRANSACTIONS, with_string_ids
from creditgrain.sources import (
    conform,
    from_records,
    load_splits,
    parse_times,
    read_transactions,
    read_with_rejects,
    save_splits,
    validate_transactions,
    versions,
)


TRANSACTIONS_DTYPES = [(f.name, f.dataType.simpleString()) for f in TRANSACTIONS]


def rows(df):
    return sorted(df.collect(), key=lambda r: r["TransactionId"])


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_files_read_back(spark, ten, tmp_path, fmt):
    path = str(tmp_path / fmt)
    ten.write.option("header", True).format(fmt).save(path)
    back = read_transactions(spark, path, fmt)
    assert back.schema == TRANSACTIONS and rows(back) == rows(ten)


def test_csv_with_text_ids_and_zulu_times(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        ",".join(TRANSACTIONS.names)
        + "\nTransactionId_7,BatchId_1,AccountId_9,SubscriptionId_2,CustomerId_9,UGX,256,ProviderId_6,ProductId_10,"
        + "airtime,ChannelId_3,-20.0,20,2018-11-15T02:18:49Z,2,0\n"
    )
    row = read_transactions(spark, str(path), schema=with_string_ids()).first()
    assert (row.AccountId, row.ProviderId) == ("AccountId_9", "ProviderId_6")
    assert row.TransactionStartTime == dt.datetime(2018, 11, 15, 2, 18, 49) and row.Amount == -20.0


def test_missing_file_raises(spark):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_transactions(spark, "/nowhere/data.csv")


def test_ill_typed_csv_raises(spark, tmp_path):
    path = tmp_path / "bad.csv"
    values = ["1"] * 13 + ["2024-01-01", "0", "0"]
    values[2] = "not a number"
    path.write_text(",".join(TRANSACTIONS.names) + "\n" + ",".join(values) + "\n")
    with pytest.raises(Exception, match="MALFORMED"):
        read_transactions(spark, str(path)).collect()


def test_records_default_fraud_and_parse_times(spark):
    record = {k: v for k, v in records()[0].items() if k != "FraudResult"}
    record["TransactionStartTime"] = "2018-11-15T02:18:49Z"
    row = from_records(spark, [record]).first()
    assert row.FraudResult == 0 and row.TransactionStartTime == dt.datetime(2018, 11, 15, 2, 18, 49)


def test_time_parsing_strict_and_lenient(spark):
    df = spark.createDataFrame([("2024-02-30",)], "TransactionStartTime string")
    assert parse_times(df, lenient=True).first()[0] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parse_times(df).collect()


def test_conform_needs_every_column_but_fraud(ten):
    assert conform(ten.drop("FraudResult")).agg(F.sum("FraudResult")).first()[0] == 0
    with pytest.raises(ValueError, match="Value is missing"):
        conform(ten.drop("Value"))


def test_validation_sorts_records_out(spark):
    good = {k: str(v) for k, v in records()[0].items()}
    cases = [
        good,
        good | {"TransactionId": "2", "FraudResult": None},
        good | {"TransactionId": "3", "Value": "much"},
        good | {"TransactionId": "4", "CurrencyCode": None, "TransactionStartTime": "yesterday"},
        good | {"TransactionId": "5", "CountryCode": "12.5"},
        good | {"TransactionId": "6", "Amount": "NaN"},
        good | {"TransactionId": "7", "FraudResult": "maybe"},
        good | {"TransactionId": "8", "CountryCode": "254.0"},
    ]
    schema = ", ".join(f"{c} string" for c in TRANSACTIONS.names)
    raw = spark.createDataFrame([tuple(c[n] for n in TRANSACTIONS.names) for c in cases], schema)
    valid, rejects = validate_transactions(raw)
    assert valid.dtypes == TRANSACTIONS_DTYPES
    assert {r.TransactionId: r.FraudResult for r in valid.collect()} == {1: 0, 2: 0}
    assert {r.TransactionId: r.problems for r in rejects.collect()} == {
        "3": "Value: invalid",
        "4": "CurrencyCode: missing, TransactionStartTime: invalid",
        "5": "CountryCode: invalid",
        "6": "Amount: invalid",
        "7": "FraudResult: invalid",
        "8": "CountryCode: invalid",
    }
    with pytest.raises(ValueError, match="columns are missing: Value"):
        validate_transactions(raw.drop("Value"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_splits_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 0.5, "train"), (0, 1.5, "train"), (1, 2.5, "test")], "y int, x double, split string")
    save_splits(df, str(tmp_path / "s"), fmt)
    train, test = load_splits(spark, str(tmp_path / "s"), "y", df.schema if fmt == "csv" else None, fmt)
    assert sorted((r.y, r.x) for r in train.collect()) == [(0, 1.5), (1, 0.5)]
    assert [(r.y, r.x) for r in test.collect()] == [(1, 2.5)]
    with pytest.raises(ValueError, match="target column z"):
        load_splits(spark, str(tmp_path / "s"), "z", df.schema if fmt == "csv" else None, fmt)


def test_failed_write_leaves_the_sets_before(spark, tmp_path):
    path = str(tmp_path / "sets")
    rows = spark.range(1000).selectExpr("id", "id % 2 as y", "if(id % 5 = 0, 'test', 'train') as split")
    save_splits(rows, path)
    # the last partition's task fails when others have written
    failing = rows.repartition(4).withColumn("id", F.when(F.col("id") == 777, F.raise_error("broken row").cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken row"):
        save_splits(failing, path)
    train, test = load_splits(spark, path, "y")
    assert (train.count(), test.count()) == (800, 200)
    save_splits(rows.where("id < 10"), path)
    train, test = load_splits(spark, path, "y")
    assert (train.count(), test.count()) == (8, 2)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert versions.current_version(spark, path) == path
    names = []
    for k in range(4):
        names.append(versions.new_version(path))
        spark.range(k + 1).write.parquet(names[-1])
        assert versions.publish(spark, path, names[-1]) == k + 1
    (tmp_path / "v" / "_manifests" / "000000000005").write_text("version-unfin")  # a writer that died in the manifest
    assert versions.current_version(spark, path) == names[-1]
    versions.drop_old_versions(spark, path, keep=2)
    assert sorted(p.name for p in (tmp_path / "v").glob("version-*")) == sorted(n.rsplit("/", 1)[1] for n in names[2:])
    assert spark.read.parquet(versions.current_version(spark, path)).count() == 4


def test_rejects_of_broken_files(spark, tmp_path):
    good = records()[0]
    names = list(good)
    lines = [
        ",".join(names),
        ",".join(str(good[n]) for n in names),
        "1,2",
        ",".join("" if n == "Value" else str(good[n]) for n in names),
        ",".join(str(good[n]) for n in names) + ",more",
        ",".join("soon" if n == "TransactionStartTime" else str(good[n]) for n in names),
    ]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    valid, rejects = read_with_rejects(spark, str(tmp_path / "x.csv"))
    assert [(f.name, f.dataType.simpleString()) for f in valid.schema] == TRANSACTIONS_DTYPES and valid.count() == 1
    got = sorted((r.problems, r.line or "") for r in rejects.collect())
    assert got == [("TransactionStartTime: invalid", ""), ("Value: missing", ""), ("line: broken", lines[4]), ("line: broken", "1,2")]
    (tmp_path / "x.json").write_text("\n".join([json.dumps(good), "{\"TransactionId\": 5", "oops", json.dumps(good | {"Value": "lots"})]) + "\n")
    valid, rejects = read_with_rejects(spark, str(tmp_path / "x.json"), "json")
    assert valid.count() == 1
    assert sorted((r.problems, r.line or "") for r in rejects.collect()) == [
        ("Value: invalid", ""), ("line: broken", "oops"), ("line: broken", "{\"TransactionId\": 5"),
    ]
    (tmp_path / "empty.json").write_text("")
    assert [t.count() for t in read_with_rejects(spark, str(tmp_path / "empty.json"), "json")] == [0, 0]
