import numpy as np
import pytest

from creditgrain.operators import ranks

PROBABILITIES = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q100": 1.0}


def groups():
    draw = np.random.default_rng(3)
    return {
        0: draw.normal(size=4001),
        1: draw.integers(0, 5, 3000).astype(float),
        2: np.exp(draw.normal(size=2500) * 8),
        3: np.array([7.0]),
        4: np.full(500, 2.5),
        5: np.array([1.0, 2.0, 4.0, 10.0]),
        # one value holds a third of the rows
        6: np.concatenate([np.full(1000, 0.25), draw.random(2000)]),
        7: draw.integers(-3, 3, 6) * 1e12,
    }


@pytest.mark.parametrize("few", [100_000, 0])
def test_quantiles_are_exact_in_any_number_of_passes(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    data = groups() | {
        # values that differ in their last bits only, and some of every size
        9: np.nextafter(np.full(300, 1.0), 2.0) + np.arange(300) * 2.0**-50,
        10: np.concatenate([[5e-324, -5e-324, 2.2e-308, -2.2e-308, 1.7e308, -1.7e308, -0.0, 0.0], 2.0 ** np.arange(-60.0, 60.0)]),
    }
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [(0, None), (8, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    got = {r.g: r for r in ranks.quantiles(df, "x", PROBABILITIES, ["g"]).collect()}
    assert sorted(got) == sorted(data)
    for k, values in data.items():
        assert got[k].n == len(values)
        for name, p in PROBABILITIES.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (k, name)
    stats = {s["g"]: s for s in ranks.order_statistics(df, "x", {"q": 0.5}, ["g"], moments=True)}
    assert stats[8] == {"g": 8, "n": 0, "missing": 1, "q": None, "mean": None, "m2": None, "min": None, "max": None}
    assert stats[0]["missing"] == 1 and stats[4]["m2"] == 0
    for k, values in data.items():
        s = stats[k]
        assert (s["min"], s["max"]) == (values.min(), values.max())
        if k != 10:
            assert s["mean"] == pytest.approx(values.mean(), rel=1e-12)
            assert s["m2"] == pytest.approx(((values - values.mean()) ** 2).sum(), rel=1e-9, abs=1e-20)


def test_sort_keys_are_the_bits(spark):
    draw = np.random.default_rng(9)
    values = np.concatenate([
        draw.integers(-(2**63), 2**63 - 1, 4000).view(np.float64),
        2.0 ** np.arange(-1074.0, 1024.0),
        np.nextafter(2.0 ** np.arange(-1000.0, 1024.0), 0),
        [0.0, -0.0, np.inf, -np.inf, 3e-324, 1.0],
    ])
    values = values[~np.isnan(values)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = ranks.with_sort_key(df, "x", "key").collect()
    for r in got:
        bits = int(np.array([abs(r.x)]).view(np.int64)[0])
        assert r.key == (-bits if r.x < 0 else bits) and ranks.key_value(r.key) == r.x


@pytest.mark.parametrize("accuracy", [2000, 2])
def test_running_sums_match_a_sorted_scan(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "SKETCH_ACCURACY", accuracy)
    draw = np.random.default_rng(4)
    values = np.unique(np.exp(draw.normal(size=3000) * 3))
    m = draw.integers(0, 9, len(values))
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, m, strict=True)], "x double, m long").repartition(4)
    got = {r.x: (r.m_below, r.m_total) for r in ranks.running_sums(df, "x", ["m"]).collect()}
    below = np.cumsum(m) - m
    assert got == {float(v): (int(b), int(m.sum())) for v, b in zip(values, below, strict=True)}
