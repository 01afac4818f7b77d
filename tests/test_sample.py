from collections import Counter

import pytest

from creditgrain.operators import sample


def labelled(spark, *sizes):
    rows = [(i, c) for i, c in enumerate(c for c, n in enumerate(sizes) for _ in range(n))]
    return spark.createDataFrame(rows, "id long, y int").repartition(4)


@pytest.mark.parametrize(
    "sizes, test_size, test_rows",
    [
        ({0: 2, 1: 2}, 0.5, {0: 1, 1: 1}),
        ({0: 90, 1: 10}, 0.2, {0: 18, 1: 2}),
        # 11 rows: the test total is rounded up to 3
        ({0: 8, 1: 3}, 0.2, {0: 2, 1: 1}),
        ({0: 5}, 0.2, {0: 1}),
    ],
)
def test_quotas(spark, sizes, test_size, test_rows):
    counts = spark.createDataFrame(list(sizes.items()), "y int, n long")
    assert {r.y: r.quota for r in sample.test_quotas(counts, "y", test_size).collect()} == test_rows


def test_quotas_of_large_classes_are_whole_numbers(spark):
    sizes = {0: 3 * 10**15 + 1, 1: 10**15, 2: 7}
    counts = spark.createDataFrame(list(sizes.items()), "y int, n long")
    got = {r.y: r.quota for r in sample.test_quotas(counts, "y", 0.25).collect()}
    assert abs(sum(got.values()) - sum(sizes.values()) / 4) <= 1 and abs(got[0] - sizes[0] / 4) <= 1


def test_a_hundred_thousand_classes(spark):
    df = spark.range(300_000).selectExpr("id", "id % 100000 as y")
    got = sample.assign_split(df, "y", "id", 0.4).groupBy("y").pivot("split", ["test", "train"]).count().fillna(0)
    # 120,000 test rows: 1.2 a class, the left-over training rows go to the first classes
    assert {(r.test, r.train, r["count"]) for r in got.groupBy("test", "train").count().collect()} == {(1, 2, 80_000), (2, 1, 20_000)}
    weighted = sample.with_class_weight(df, "y")
    assert weighted.count() == 300_000 and weighted.where("weight <> 1").count() == 0


def test_split_is_exact_disjoint_and_repeatable(spark):
    df = labelled(spark, 900, 101)
    once = sample.assign_split(df, "y", "id").collect()
    assert Counter((r.y, r.split) for r in once) == {
        (0, "test"): 181, (0, "train"): 719, (1, "test"): 20, (1, "train"): 81,
    }
    assert sorted(r.id for r in once) == list(range(1001))
    again = sample.assign_split(df.repartition(7), "y", "id").collect()
    assert sorted(once) == sorted(again)
    other = sample.assign_split(df, "y", "id", seed=1).collect()
    assert sorted(once) != sorted(other)


def test_split_of_few_rows_and_dropped_columns(spark):
    train, test = sample.split_data(labelled(spark, 2, 2), "y", "id", test_size=0.5, drop=["id"])
    assert train.columns == test.columns == ["y"]
    assert sorted(r.y for r in train.collect()) == sorted(r.y for r in test.collect()) == [0, 1]


def test_oversampling_makes_classes_equal(spark):
    out = sample.oversample(labelled(spark, 300, 7), "y", "id").collect()
    assert Counter(r.y for r in out) == {0: 300, 1: 300}
    copies = Counter(r.id for r in out if r.y == 1)
    assert set(copies) == set(range(300, 307)) and min(copies.values()) > 20
    assert all(n == 1 for i, n in Counter(r.id for r in out if r.y == 0).items())


def test_oversampling_leaves_single_and_equal_classes(spark):
    for df in (labelled(spark, 5), labelled(spark, 4, 4)):
        assert sorted(sample.oversample(df, "y", "id").collect()) == sorted(df.collect())


def test_oversampling_grows_only_the_smallest_of_three(spark):
    out = sample.oversample(labelled(spark, 20, 5, 9), "y", "id").collect()
    assert Counter(r.y for r in out) == {0: 20, 1: 20, 2: 9}


def test_numbering_is_dense(spark):
    got = sample.numbered(labelled(spark, 500), "id", 42, "i").collect()
    assert sorted(r.i for r in got) == list(range(500))


def test_class_weights(spark):
    df = labelled(spark, 6, 2)
    got = {r.y: r.weight for r in sample.class_weights(df, "y").collect()}
    assert got == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}
    rows = sample.with_class_weight(df, "y").collect()
    assert sum(r.weight for r in rows) == pytest.approx(8)


def test_label_with_very_many_values(spark):
    df = spark.range(3000).selectExpr("id", "id % 1500 as y")
    assert sample.class_counts(df, "y").count() == 1500
    assert {r.weight for r in sample.with_class_weight(df, "y").collect()} == {1.0}
    assert sample.oversample(df.where("id < 2999"), "y", "id").count() == 3000


def test_shuffle_is_a_permutation(spark):
    got = [r.id for r in sample.shuffle_rows(labelled(spark, 50), "id").collect()]
    assert sorted(got) == list(range(50)) and got != list(range(50))
