import pytest
from pyspark.sql import functions as F

from creditgrain.functions import credit_score, loan_amount, loan_duration, loan_tier
from creditgrain.plans.scoring import SUCCESS, response, score_and_terms
from creditgrain.schema import RESPONSE

# Scores of probabilities.
SCORES = {
    0.0: 1014, 0.0001: 784, 0.0005: 752, 0.001: 738, 0.05: 659, 0.0758: 650, 0.5: 600,
    0.9: 556, 0.92: 551, 0.93: 548, 0.999: 462, 0.9995: 448, 0.9999: 416,
}


def test_scores(spark):
    df = spark.createDataFrame([(p,) for p in SCORES], "p double")
    assert {r.p: r.s for r in df.select("p", credit_score(F.col("p")).alias("s")).collect()} == SCORES


def test_other_scale_and_half_to_even(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    row = df.select(
        credit_score(F.col("p"), 500.5, 10).alias("a"), credit_score(F.col("p"), 501.5, 10).alias("b")
    ).first()
    assert (row.a, row.b) == (500, 502)


def test_edges(spark):
    cases = [1.0, -0.1, 1.1, float("nan"), None, 0.25]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(cases)], "AccountId int, p double")
    got = sorted(score_and_terms(df).collect(), key=lambda r: r.AccountId)
    assert [r.status for r in got] == ["score_undefined", "error", "error", "error", "error", "ok"]
    assert [r.credit_score for r in got[:5]] == [None] * 5
    assert [r.recommended_loan_duration for r in got[:5]] == [None] * 5
    assert [r.risk_probability for r in got] == [1.0, None, None, None, None, 0.25]
    assert got[5].message == SUCCESS and "outside" in got[1].message and "missing" in got[3].message
    assert response(score_and_terms(df)).columns == list(RESPONSE)
    clamped = sorted(score_and_terms(df, clamp=True).collect(), key=lambda r: r.AccountId)
    assert (clamped[0].credit_score, clamped[0].recommended_loan_duration) == (186, "Declined")
    assert clamped[1].credit_score is None


@pytest.mark.parametrize(
    "score, terms",
    [
        (750, (50000.0, "6 months", "Lowest")),
        (749, (20000.0, "3 months", "Low")),
        (650, (20000.0, "3 months", "Low")),
        (649, (5000.0, "1 month", "Moderate")),
        (550, (5000.0, "1 month", "Moderate")),
        (549, (1000.0, "2 weeks", "High")),
        (450, (1000.0, "2 weeks", "High")),
        (449, (0.0, "Declined", "N/A")),
    ],
)
def test_bands(spark, score, terms):
    s = F.lit(score)
    assert tuple(spark.range(1).select(loan_amount(s), loan_duration(s), loan_tier(s)).first()) == terms
