import numpy as np
import pytest
from pyspark.sql import functions as F

from creditgrain.functions import align_columns, drop_columns, numeric_columns, plotted_columns, string_columns
from creditgrain.operators import profile
from creditgrain.operators.correlation import correlation_matrix, correlation_with


@pytest.fixture(scope="module")
def numbers(spark):
    draw = np.random.default_rng(1)
    rows = [
        (i, float(a), None if i % 7 == 0 else float(a * 2 + b), 3.0, int(i % 4 == 0))
        for i, (a, b) in enumerate(zip(draw.normal(size=400), draw.normal(size=400), strict=True))
    ]
    return spark.createDataFrame(rows, "key int, a double, b double, same double, label int").repartition(4).cache()


def pandas_of(df):
    return df.toPandas().sort_values("key").reset_index(drop=True)


def test_column_choice(ten):
    assert "ChannelId" in string_columns(ten) and "Amount" in numeric_columns(ten)
    assert plotted_columns(ten) == ["CountryCode", "Amount", "Value", "PricingStrategy"]
    assert drop_columns(ten, ["Value", "Absent"]).columns == [c for c in ten.columns if c != "Value"]
    aligned = align_columns(ten, ["Value", "Absent", "AccountId"])
    assert aligned.columns == ["Value", "Absent", "AccountId"]
    assert aligned.agg(F.sum("Absent")).first()[0] == 0


def test_overview_and_missing(ten, numbers):
    overview = {r.column: r for r in profile.overview(numbers).collect()}
    assert overview["b"].non_null == 342 and overview["b"].row_count == 400
    assert overview["key"].dtype == "int" and overview["key"].column_count == 5
    missing = profile.missing_values(numbers).collect()
    assert [(r.column, r.missing_count, r.missing_percent) for r in missing] == [("b", 58, 14.5)]
    assert profile.missing_values(ten).count() == 0


def test_describe(numbers):
    got = {r.column: r for r in profile.describe(numbers, ["a", "b", "same"]).collect()}
    want = pandas_of(numbers)[["a", "b", "same"]].describe()
    for c in ("a", "b", "same"):
        names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "q25": "25%", "q50": "50%", "q75": "75%", "max": "max"}
        for mine, theirs in names.items():
            assert got[c][mine] == pytest.approx(want[c][theirs]), (c, mine)


def test_histogram_and_constant_column(numbers):
    got = profile.histogram(numbers, ["a", "b", "same"]).collect()
    data = pandas_of(numbers)
    for c in ("a", "b", "same"):
        counts, edges = np.histogram(data[c].dropna(), bins=50)
        mine = {r.bin: r for r in got if r.column == c}
        assert {b: r["count"] for b, r in mine.items()} == dict(enumerate(counts))
        assert all(r.bin_start == pytest.approx(edges[b]) and r.bin_end == pytest.approx(edges[b + 1]) for b, r in mine.items())


def test_kernel_density(numbers):
    got = profile.kernel_density(numbers, ["a", "same"]).collect()
    assert {r.column for r in got} == {"a"} and len(got) == 200
    a = pandas_of(numbers)["a"].to_numpy()
    h = a.std(ddof=1) * len(a) ** -0.2
    for r in got[::20]:
        want = np.exp(-0.5 * ((r.x - a) / h) ** 2).sum() / (len(a) * h * np.sqrt(2 * np.pi))
        assert r.density == pytest.approx(want)


def test_kernel_density_where_no_kernel_reaches(spark):
    df = spark.createDataFrame([(0.0,)] * 500 + [(1e-3,)] * 500 + [(1000.0,)], "x double")
    got = sorted(profile.kernel_density(df, ["x"]).collect(), key=lambda r: r.point)
    assert len(got) == 200 and got[0].density > 0


def test_class_share_without_fraud(ten):
    calm = ten.where("FraudResult = 0")
    got = {r["class"]: (r["count"], r.percent) for r in profile.class_share(calm, "FraudResult").collect()}
    assert got == {0: (8, 100.0), 1: (0, 0.0)}
    empty = profile.class_share(ten.where("false"), "FraudResult").collect()
    assert [r.percent for r in empty] == [None, None]


def test_counts(ten):
    got = [(r.value, r["count"]) for r in profile.value_counts(ten, ["ChannelId"]).collect()]
    assert got == [("Web", 5), ("Android", 3), ("IOS", 2)]
    both = {r.value: (r.fraud_0, r.fraud_1) for r in profile.category_by_fraud(ten, ["ChannelId"]).collect()}
    assert both == {"Web": (5, 0), "Android": (2, 1), "IOS": (1, 1)}
    days = {r.day: r.fraud_1 for r in profile.fraud_by(ten, F.weekday("TransactionStartTime"), "day").collect()}
    assert days[2] == 1 and days[1] == 1 and days[0] == 0


def test_correlations_with_missing_and_constant_columns(numbers):
    columns = ["a", "b", "same", "label"]
    got = {(r.left, r.right): r.correlation for r in correlation_matrix(numbers, columns).collect()}
    want = pandas_of(numbers)[columns].corr()
    assert len(got) == 16
    for (left, right), value in got.items():
        if "same" in (left, right):
            assert value is None
        else:
            assert value == pytest.approx(want.loc[left, right])
    with_label = correlation_with(numbers, "label", columns).collect()
    assert with_label[0].column == "label" and with_label[-1].column == "same"
    assert with_label[-1].correlation is None


def brute_box(x):
    q1, median, q3 = np.percentile(x, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = x[(x >= low) & (x <= high)]
    return q1, median, q3, min(inside.min(), q1), max(inside.max(), q3), len(x) - len(inside)


def test_boxes_by_class(numbers):
    got = profile.box_stats(numbers, ["a", "b", "same"], by="label").collect()
    data = pandas_of(numbers)
    assert len(got) == 6
    for r in got:
        x = data.loc[data.label == r.label, r.column].dropna().to_numpy()
        mine = (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers)
        assert mine == pytest.approx(brute_box(x))


def test_outlier_rows(numbers):
    data = pandas_of(numbers)
    got = {(r.key, r.column) for r in profile.outlier_rows(numbers, "key", ["a", "b"]).collect()}
    want = set()
    for c in ("a", "b"):
        q1, q3 = data[c].quantile([0.25, 0.75])
        reach = 1.5 * (q3 - q1)
        want |= {(int(k), c) for k in data.key[(data[c] < q1 - reach) | (data[c] > q3 + reach)]}
    assert got == want and got


def test_head_has_an_order(ten):
    assert [r.TransactionId for r in profile.head(ten, "TransactionId", 3).collect()] == [1, 2, 3]


def test_class_share_of_three_classes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (2,), (None,)], "y int")
    assert {r["class"]: (r["count"], r.percent) for r in profile.class_share(df, "y").collect()} == {
        0: (1, 25.0),
        1: (1, 25.0),
        2: (2, 50.0),
    }


def test_every_bin_and_the_edges_of_doubles(spark):
    import numpy as np

    values = [i / 10 for i in range(11)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.bin: r["count"] for r in profile.histogram(df, ["x"], 10).collect()}
    assert [got[i] for i in range(10)] == np.histogram(values, 10)[0].tolist()
    two = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    assert profile.histogram(two, ["x"]).count() == 50


def test_nan_is_missing_and_an_empty_table_has_counts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "x double")
    row = profile.describe(df).first()
    assert (row["count"], row["mean"], row["max"]) == (2, 1.5, 2.0)
    assert profile.missing_values(df).first().missing_count == 1
    empty = profile.describe(df.limit(0)).first()
    assert (empty["count"], empty["mean"]) == (0, None)


def test_kernel_density_of_many_values_is_within_its_bound(spark):
    draw = np.random.default_rng(2)
    # a heavy tail, so that the bandwidth is far below the range
    values = np.concatenate([draw.normal(size=4000), np.exp(draw.normal(size=1000) * 3), np.full(500, 2.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)
    h = values.std(ddof=1) * len(values) ** -0.2
    for cells in (1 << 14, 300):
        width = min((values.max() - values.min()) / cells, h / profile.KDE_FINE)
        for r in profile.kernel_density(df, ["x"], cells=cells).collect():
            want = np.exp(-0.5 * ((r.x - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
            assert abs(r.density - want) <= 0.03 * (width / h) ** 3 / h + 1e-15 / h


def test_correlations_leave_out_nan(spark):
    rows = [(1.0, 2.0, 1), (2.0, float("nan"), 0), (3.0, 5.0, 1), (4.0, 7.0, 0), (None, 1.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    want = np.corrcoef([1, 3, 4], [2, 5, 7])[0, 1]
    got = {(r.left, r.right): r.correlation for r in correlation_matrix(df).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(want)
    assert got["b", "y"] == pytest.approx(np.corrcoef([2, 5, 7, 1], [1, 1, 0, 1])[0, 1])
    assert len(got) == 9 and got["a", "a"] == pytest.approx(1)
    label = {r.column: r.correlation for r in correlation_with(df, "b", ["a", "y"]).collect()}
    assert label["a"] == pytest.approx(want) and label["y"] == pytest.approx(got["b", "y"])
