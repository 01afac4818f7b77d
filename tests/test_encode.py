import math

import pytest

from creditgrain.operators.encode import OneHotModel, OneHotVectors, WoeModel, few_valued, fit_numeric, woe_auto_columns, woe_table
from creditgrain.operators.features import customer_features
from creditgrain.plans.preprocess import CreditPreprocessor, CreditPreprocessorModel, feature_columns
from creditgrain.session import store

MODES = ["MostFrequentChannel", "MostFrequentProductCategory", "MostFrequentCurrencyCode"]

# Weight of Evidence over the four accounts of the example.
WOE = {
    ("MostFrequentChannel", "Android"): (2, 1, 0.0),
    ("MostFrequentChannel", "IOS"): (1, 1, -6.908755779),
    ("MostFrequentChannel", "Web"): (1, 0, 6.908754779),
    ("MostFrequentProductCategory", "A"): (2, 0, 7.601402335),
    ("MostFrequentProductCategory", "C"): (1, 1, -6.908755779),
    ("MostFrequentProductCategory", "D"): (1, 1, -6.908755779),
    ("MostFrequentCurrencyCode", "KES"): (3, 1, 0.692647556),
    ("MostFrequentCurrencyCode", "USD"): (1, 1, -6.908755779),
}


@pytest.fixture(scope="module")
def accounts(spark, ten):
    return store(customer_features(ten), "accounts")


def test_woe_golden(accounts):
    got = {(r.feature, r.category): r for r in woe_table(accounts, MODES, "HasFraud").collect()}
    assert set(got) == set(WOE)
    for key, (n, bad, woe) in WOE.items():
        assert (got[key].n, got[key].bad) == (n, bad) and got[key].woe == pytest.approx(woe, abs=1e-5)


def test_woe_transform_cases(spark):
    train = spark.createDataFrame(
        [("x", 1, 0), ("x", 1, 0), ("y", 2, 1), (None, 2, 1), (None, 1, 0)], "a string, b int, y int"
    )
    model = WoeModel.fit(train, ["a", "b", "gone"], "y")
    s = 0.001
    missing = math.log(((1 + s) / (3 + 2 * s)) / ((1 + s) / (2 + 2 * s)))
    data = spark.createDataFrame([(1, None, 1), (2, "unseen", 9)], "id int, a string, b int")
    out = model.transform(data)
    assert out.columns == ["id", "a", "b", "gone"]
    got = {r.id: r for r in out.collect()}
    assert got[1].a == pytest.approx(missing) and got[2].a == 0.0 and got[2].b == 0.0
    assert got[1].b > 0 and got[1].gone == 0.0
    absent = model.transform(data.drop("a")).collect()
    assert {r.a for r in absent} == {0.0}
    assert model.feature_names(["b", "other"]) == ["b"]


def test_auto_columns_keep_input_order(spark):
    rows = [(i, float(i % 3), i % 49, i % 50, "t") for i in range(200)]
    df = spark.createDataFrame(rows, "many long, real double, few int, fifty int, text string")
    assert woe_auto_columns(df.select("text", "many", "real", "few", "fifty")) == ["text", "few"]


def test_median_and_population_deviation(spark):
    df = spark.createDataFrame(
        [(1.0, 5, None), (2.0, 5, None), (4.0, 5, None), (10.0, 5, None), (None, 5, None)],
        "a double, same int, nothing double",
    )
    a, same = fit_numeric(df, ["a", "same", "nothing"])
    # median of 1 2 4 10 is 3, and the missing value counts as 3 from there on
    assert a.median == 3.0 and a.mean == pytest.approx(4.0)
    assert a.std == pytest.approx(math.sqrt((9 + 4 + 0 + 36 + 1) / 5))
    assert (same.feature, same.std) == ("same", 0.0)
    other = spark.createDataFrame([(7,)], "same int")
    assert other.select(same.standardized(other.same)).first()[0] == 2.0


def test_one_hot(accounts, spark):
    out = OneHotModel.fit(accounts, MODES).transform(accounts)
    assert {"MostFrequentChannel_Web", "MostFrequentProductCategory_C", "AccountId"} <= set(out.columns)
    assert not set(MODES) & set(out.columns)
    rows = {r.AccountId: r.asDict() for r in out.collect()}
    assert all(v is not None for r in rows.values() for v in r.values())
    assert rows[1001]["MostFrequentChannel_Web"] == 1 and rows[1002]["MostFrequentChannel_Web"] == 0
    model = OneHotModel({"c": ["a"]})
    other = spark.createDataFrame([(1, None), (2, "new"), (3, "a")], "id int, c string")
    assert {r.id: r.c_a for r in model.transform(other).collect()} == {1: 0, 2: 0, 3: 1}


def test_one_hot_vectors_of_a_million_categories(spark):
    df = spark.range(1_000_000).selectExpr("id", "concat('c', lpad(id, 7, '0')) as c", "if(id < 10, null, 'x') as few")
    model = OneHotVectors.fit(df, ["c", "few"])
    assert model.sizes == {"c": 1_000_000, "few": 1}
    wrong = model.indexed(df).where("c_place <> id or (few_place is null) <> (id < 10)").count()
    assert wrong == 0
    rows = {r.id: r for r in model.transform(df.where("id in (0, 999999)").union(spark.sql("select 7L, 'unseen', 'x'"))).collect()}
    assert rows[999_999].c_vector.size == 1_000_000 and rows[999_999].c_vector.indices.tolist() == [999_999]
    assert rows[0].c_vector.indices.tolist() == [0] and rows[0].few_vector.indices.tolist() == []
    assert rows[7].c_vector.indices.tolist() == [] and rows[7].few_vector.indices.tolist() == [0]


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_few_valued_columns_are_found_whatever_hashes_meet(spark, bits):
    df = spark.range(20_000).selectExpr(
        "id as ids", "id % 49 as few", "id % 50 as many", "cast(null as bigint) as none", "if(id % 2 = 0, null, -9223372036854775807) as one", "cast(id % 7 as int) as small"
    )
    assert few_valued(df, df.columns, bits=bits) == {"few", "none", "one", "small"}
    assert few_valued(df.limit(0), ["ids"]) == {"ids"} and few_valued(df, []) == set()


def test_one_hot_with_many_categories(spark):
    many = spark.range(1200).selectExpr("id", "concat('c', id) as c")
    assert len(OneHotModel.fit(many, ["c"]).categories["c"]) == 1200
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, c string")
    out = OneHotModel.vectors(df, ["c"])
    assert out.columns == ["id", "c_vector"]
    assert len({tuple(r.c_vector.indices) for r in out.collect()}) == 3


def test_preprocessor_on_training_rows(accounts, spark, tmp_path):
    numeric, text = feature_columns(accounts)
    assert len(numeric) == 22 and text == [c for c in accounts.columns if c in MODES]
    fitted = CreditPreprocessor().fit(accounts)
    out = fitted.transform(accounts)
    assert out.columns == ["AccountId", "HasFraud", *fitted.outputs]
    assert fitted.outputs[0] == "num__Recency" and fitted.outputs[-1].startswith("cat__MostFrequent")
    rows = out.collect()
    for name in ("num__Monetary", "num__Recency"):
        values = [r[name] for r in rows]
        assert sum(values) == pytest.approx(0) and sum(v * v for v in values) == pytest.approx(4)
    fitted.save(str(tmp_path / "p"))
    loaded = CreditPreprocessorModel.load(spark, str(tmp_path / "p"))
    key = lambda r: r.AccountId
    assert sorted(loaded.transform(accounts).collect(), key=key) == sorted(rows, key=key)
    with pytest.raises(ValueError, match="feature columns are missing: Monetary"):
        fitted.transform(accounts.drop("Monetary"))


def test_other_columns_pass_through(accounts):
    some = accounts.select("AccountId", "HasFraud", "Recency", "MostFrequentChannel", "Monetary")
    fitted = CreditPreprocessor(numeric=["Recency"], categorical=["MostFrequentChannel"]).fit(some)
    out = fitted.transform(some)
    assert out.columns == ["AccountId", "HasFraud", "num__Recency", "cat__MostFrequentChannel", "remainder__Monetary"]
