import copy

import pytest
from pyspark.sql import functions as F

from creditgrain.operators.encode import fit_numeric
from creditgrain.operators.features import customer_features
from creditgrain.operators.newton import fit_logit
from creditgrain.operators.trees import margin_sql, tree_nodes
from creditgrain.plans.scoring import feature_mismatch, score_features, score_records, score_transactions
from creditgrain.plans.training import CreditModel, evaluate, fit_credit_model, train_model
from creditgrain.schema import with_string_ids
from creditgrain.sources import txns_from_events
from creditgrain.sources.versions import current_version
from creditgrain.streaming import score_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def txns(spark):
    return txns_from_events(spark.read.parquet(f"{DATA}/events.parquet")).cache()


@pytest.fixture(scope="module")
def fitted(txns):
    return fit_credit_model(txns)


def rows(df):
    return sorted(df.collect(), key=lambda r: r["AccountId"])


def test_splits_are_whole_and_evaluated(fitted, txns):
    model, inputs = fitted
    assert inputs.count() == txns.select("AccountId").distinct().count()
    scored = model.probabilities(inputs)
    result = evaluate(scored)
    assert 0 <= result["roc_auc"].first()[0] <= 1 and 0 <= result["pr_auc"].first()[0] <= 1
    assert result["confusion_matrix"].agg(F.sum(F.expr("predicted_0 + predicted_1"))).first()[0] == inputs.count()
    assert all((r.p > 0.5) == (r.prediction == 1.0) for r in scored.collect())


def test_saved_model_scores_the_same(spark, fitted, txns, tmp_path):
    model, _ = fitted
    model.save(str(tmp_path / "m"))
    loaded = CreditModel.load(spark, str(tmp_path / "m"))
    assert rows(score_transactions(txns, loaded)) == rows(score_transactions(txns, model))


def test_model_types(fitted):
    model, inputs = fitted
    with pytest.raises(ValueError, match="model_type"):
        train_model(inputs, model.preprocessor.outputs, "random_forest")
    boosted = train_model(inputs, ["num__Monetary", "num__Frequency"], "gradient_boosting")
    assert boosted.stages[-1].getNumTrees == 100
    assert {t.depth for t in boosted.stages[-1].trees} <= {0, 1, 2, 3}


def test_stream_scores_like_the_batch(spark, fitted, txns, tmp_path):
    model, _ = fitted
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    stream = txns_from_events(
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    )
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        score_stream(stream, model, out, checkpoint).awaitTermination()
    got = rows(spark.read.parquet(out).drop("batch"))
    assert got == rows(score_records(txns, model))
    # transactions without a currency are refused
    refused = {r.AccountId for r in txns.where("CurrencyCode is null").select("AccountId").collect()}
    assert {r.AccountId for r in got if r.status == "error"} == refused


def test_refused_records_do_not_stop_other_accounts(fitted, txns):
    model, _ = fitted
    complete = txns.where("CurrencyCode is not null")
    raw = complete.select(*[F.col(c).cast("string").alias(c) for c in complete.columns])
    broken = raw.withColumn("Value", F.when(F.col("AccountId") == "3", "lots").otherwise(F.col("Value")))
    got = {r.AccountId: r for r in score_records(broken, model).collect()}
    assert got[3].status == "error" and got[3].credit_score is None
    assert "Value: invalid" in got[3].message
    others = [r for a, r in got.items() if a != 3]
    want = {r.AccountId: r for r in score_transactions(complete, model).collect()}
    assert {r.status for r in others} == {"ok"} and len(got) == len(want)
    assert all(r == want[r.AccountId] for r in others)


def test_mismatch_and_optional_scaler(fitted):
    model, inputs = fitted
    broken = inputs.drop("num__Recency")
    assert "num__Recency" in feature_mismatch(broken, model.preprocessor.outputs)
    with pytest.raises(ValueError, match="feature mismatch"):
        score_features(broken, model)
    # inputs of training rows are standardised: scaling them again changes nothing
    train = inputs.where("split = 'train'")
    scaler = fit_numeric(train, [c for c in model.preprocessor.outputs if c.startswith("num__")])
    once, twice = rows(score_features(train, model)), rows(score_features(train, model, scaler))
    assert [r.p for r in once] == pytest.approx([r.p for r in twice])


def test_serving_recency_differs_from_training(txns):
    assert customer_features(txns, "account", ["Recency"]).agg(F.max("Recency")).first()[0] == 0


def test_each_micro_batch_is_scored_by_itself(spark, fitted, tmp_path):
    model, _ = fitted
    events = spark.read.parquet(f"{DATA}/events.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("event_id < 500", "event_id >= 500"):
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = txns_from_events(
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ).fillna("XXX", ["CurrencyCode"])
    score_stream(stream, model, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(out)
    assert {r.batch for r in got.select("batch").distinct().collect()} == {0, 1}
    halves = [
        score_transactions(txns_from_events(events.where(part)).fillna("XXX", ["CurrencyCode"]), model)
        for part in ("event_id < 500", "event_id >= 500")
    ]
    want = sorted(halves[0].unionByName(halves[1]).collect())
    assert sorted(got.drop("batch").collect()) == want


def test_text_ids_keep_their_accounts(fitted, txns):
    model, _ = fitted
    raw = txns.fillna("XXX", ["CurrencyCode"]).withColumn("AccountId", F.concat(F.lit("A_"), "AccountId"))
    broken = raw.withColumn("Value", F.when(F.col("AccountId") != "A_3", F.col("Value")))
    got = {r.AccountId: r.status for r in score_records(broken, model, schema=with_string_ids()).collect()}
    assert got["A_3"] == "error" and len(got) == raw.select("AccountId").distinct().count() and None not in got


def test_newton_and_lbfgs_find_the_same_optimum(fitted):
    model, inputs = fitted
    train = inputs.where("split = 'train'")
    names = ["num__Monetary", "num__Frequency", "num__StdAmount", "cat__MostFrequentChannel"]
    one, two = (train_model(train, names, solver=s) for s in ("newton", "lbfgs"))
    assert one.coefficients == pytest.approx(two.stages[-1].coefficients.toArray().tolist(), rel=2e-3, abs=2e-4)
    assert one.intercept == pytest.approx(two.stages[-1].intercept, rel=2e-3, abs=2e-4)
    with pytest.raises(ValueError, match="solver"):
        train_model(train, names, solver="magic")


def test_newton_matches_numpy(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    x = draw.normal(size=(400, 3)) * [1, 50, 0.01]
    y = (x @ [1.0, 0.05, 30.0] + draw.normal(size=400) > 0.5).astype(int)
    w = draw.integers(0, 4, 400).astype(float)
    rows = [(*map(float, r), int(k), float(v)) for r, k, v in zip(x, y, w, strict=True)] + [(None, 1.0, 1.0, 1, 1.0), (1.0, 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, w double").repartition(3).selectExpr("*", "7.5D as same")
    got = fit_logit(df, ["a", "same", "b", "c"], "y", "w", l2=0.5)
    assert got.coefficients[1] == 0
    got = fit_logit(df, ["a", "b", "c"], "y", "w", l2=0.5)
    beta, full = np.zeros(4), np.column_stack([x, np.ones(400)])
    ridge = np.array([0.5, 0.5, 0.5, 0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ beta))
        beta -= np.linalg.solve((full * (w * p * (1 - p))[:, None]).T @ full + np.diag(ridge), full.T @ (w * (p - y)) + ridge * beta)
    assert [*got.coefficients, got.intercept] == pytest.approx(beta.tolist(), rel=1e-8)
    with pytest.raises(ValueError, match="both classes"):
        fit_logit(df.where("y = 1"), ["a"], "y")
    with pytest.raises(ValueError, match="at most"):
        fit_logit(df, ["a"] * 5000, "y")


def test_tree_walk_in_sql_is_the_model(spark, fitted):
    import duckdb

    model, inputs = fitted
    names = ["num__Monetary", "num__Frequency", "num__Recency"]
    boosted = CreditModel(model.preprocessor, train_model(inputs.where("split = 'train'"), names, "gradient_boosting"))
    nodes = tree_nodes(spark, boosted.classifier.stages[-1])
    scored = boosted.probabilities(inputs).select("AccountId", *names, "p", "prediction").toPandas()
    node_rows = nodes.toPandas()
    db = duckdb.connect()
    db.register("scored", scored)
    db.register("nodes", node_rows)
    # From node to node in the relation, without the expression.
    walked = db.sql("""
with recursive x as (select AccountId, p, prediction, [num__Monetary, num__Frequency, num__Recency] as v from scored),
walk as (
  select AccountId, tree, v, cast(0 as integer) as node from x, (select distinct tree from nodes)
  union all
  select AccountId, walk.tree, v, case when v[cast(input as integer) + 1] <= threshold then cast(low as integer) else cast(high as integer) end
  from walk join nodes using (tree, node) where value is null)
select AccountId, 1 / (1 + exp(-2 * sum(weight * value))) as p from walk join nodes using (tree, node) where value is not null group by AccountId""").fetchall()
    assert dict(walked) == pytest.approx(dict(zip(scored.AccountId, scored.p, strict=True)), rel=1e-12)
    expression = db.sql(f"select AccountId, 1 / (1 + exp(-2 * ({margin_sql(nodes, names)}))) as p from scored").fetchall()
    assert dict(expression) == pytest.approx(dict(walked), rel=1e-12)
    assert {a: float(p > 0.5) for a, p in walked} == dict(zip(scored.AccountId, scored.prediction, strict=True))


def test_mismatch_as_status(fitted, txns, spark, tmp_path):
    from creditgrain.operators.encode import NumericStats

    model, inputs = fitted
    got = score_features(inputs.drop("num__Recency"), model, on_mismatch="status").collect()
    assert len(got) == inputs.count() and {r.status for r in got} == {"error"} and "num__Recency" in got[0].message
    other = CreditModel(copy.copy(model.preprocessor), model.classifier)
    other.preprocessor.stats = [*model.preprocessor.stats, NumericStats("Income", 0.0, 0.0, 1.0)]
    with pytest.raises(ValueError, match="Income"):
        score_transactions(txns, other)
    with pytest.raises(ValueError, match="on_mismatch"):
        score_transactions(txns, other, on_mismatch="ignore")
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    stream = txns_from_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(DATA))
    paths = [str(tmp_path / p) for p in ("out", "state", "quarantine")]
    score_stream(stream, other, *paths[:2], quarantine_path=paths[2]).awaitTermination()
    rows = spark.read.parquet(paths[0]).collect()
    assert {r.status for r in rows} == {"error"} and any("Income" in r.message or "refused" in r.message for r in rows)
    counts = spark.read.parquet(f"{paths[2]}/counts").first()
    assert counts.accounts == counts.errors == len(rows)
    assert counts.refused == spark.read.parquet(f"{paths[2]}/records").count() == txns.where("CurrencyCode is null").count()
    assert counts.records == txns.count()


def test_failed_write_leaves_the_model_before(spark, fitted, txns, tmp_path, monkeypatch):
    model, _ = fitted
    path = str(tmp_path / "m")
    model.save(path)
    before = current_version(spark, path)

    def fail(*_):
        raise OSError("disk full")

    monkeypatch.setattr(type(model.classifier), "save", fail)
    with pytest.raises(OSError, match="disk full"):
        model.save(path)
    assert current_version(spark, path) == before
    assert rows(score_transactions(txns, CreditModel.load(spark, path))) == rows(score_transactions(txns, model))
