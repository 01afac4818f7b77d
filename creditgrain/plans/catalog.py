"""Named queries over a folder of the sample tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (
    align_columns,
    credit_score,
    loan_amount,
    loan_duration,
    loan_tier,
    plotted_columns,
    string_columns,
    with_time_parts,
)
from ..operators import metrics, profile, sample
from ..operators.correlation import correlation_matrix, correlation_with
from ..operators.encode import OneHotModel, OneHotVectors, WoeModel, fit_numeric, woe_auto_columns, woe_table
from ..operators.features import FEATURES, customer_features, rfm_summary
from ..operators.sketches import daily_sketches, period_distincts
from ..operators.trees import tree_nodes, walked_probability
from ..schema import ACCOUNT, LEAKAGE, TARGET, TRANSACTIONS
from ..session import new_shared_path, store
from ..sources import (
    line_facts,
    load_splits,
    read_transactions,
    read_with_rejects,
    save_splits,
    txns_from_events,
    txns_from_facts,
    validate_transactions,
)
from ..streaming import score_stream
from .preprocess import feature_columns
from .scoring import response, score_and_terms, score_records, score_transactions
from .training import CreditModel, build_features, fit_credit_model, preprocess, train_model

Query = Callable[[SparkSession, str], DataFrame]

MODES = ("MostFrequentChannel", "MostFrequentProductCategory", "MostFrequentCurrencyCode")
RFM_BOXES = (
    "Recency",
    "Frequency",
    "Monetary",
    "AvgAmount",
    "MaxValue",
    "UniqueProductCategories",
    "UniqueChannels",
)
ALIGNED = ("AccountId", "Recency", "MostFrequentChannel_PayLater", "Monetary", "Frequency")

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name, less the ``_query`` that keeps it apart
    from the operator it runs."""
    REGISTRY[function.__name__.removesuffix("_query")] = function
    return function


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to ``digits`` places: sums of doubles depend on their order beyond that.

    An average of cents can lie exactly between two roundings, where the last
    bit of the sum decides; a nudge far below the shown digits settles those.
    """
    nudge = 3 * 10.0 ** -(digits + 3)
    return df.select(
        *[
            F.round(F.col(f.name) + F.lit(nudge), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema
        ]
    )


@lru_cache(maxsize=8)
def lines(spark: SparkSession, d: str) -> DataFrame:
    """The transaction table of the order lines, joined and stored once per session."""
    return txns_from_facts(store(line_facts(spark, d), "transactions", compression="zstd"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return txns_from_events(spark.read.parquet(f"{d}/events.parquet"))


def stored_features(spark: SparkSession, d: str) -> DataFrame:
    return store(customer_features(lines(spark, d)), "features")


def features_of(txns: DataFrame, *columns: str) -> DataFrame:
    return rounded(customer_features(txns, columns=columns))


def with_ratio(features: DataFrame) -> DataFrame:
    """A probability with many ties that is no function of the label."""
    p = F.floor(F.col("MinAmount") * 100 / (F.col("MaxValue") + 1)) / 100
    return features.select(
        ACCOUNT, TARGET, p.alias("p"), (p >= 0.05).cast("int").alias("prediction")
    )


def with_fraud_rate(features: DataFrame) -> DataFrame:
    return features.select(ACCOUNT, (F.col(LEAKAGE) / F.col("Frequency")).alias("p"))


# --- transactions ---------------------------------------------------------


@query
def txn_time_parts(spark, d):
    return with_time_parts(events(spark, d)).select(
        "TransactionId",
        "TransactionHour",
        "TransactionDayOfMonth",
        "TransactionDayOfWeek",
        "TransactionMonth",
        "TransactionYear",
    )


def _raw(spark, d):
    txns = events(spark, d)
    return txns.select(*[F.col(c).cast("string").alias(c) for c in txns.columns])


@query
def txn_validate_rejects(spark, d):
    return validate_transactions(_raw(spark, d))[1].select("TransactionId", "problems")


@query
def txn_validate_accepted(spark, d):
    return rounded(validate_transactions(_raw(spark, d))[0])


def _reread(spark, d, fmt):
    path = new_shared_path(spark, fmt)
    writer = events(spark, d).write
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").format(fmt).save(path)
    return rounded(read_transactions(spark, path, fmt))


@query
def csv_transactions(spark, d):
    return _reread(spark, d, "csv")


@query
def json_transactions(spark, d):
    return _reread(spark, d, "json")


@query
def csv_rejects(spark, d):
    """Problems of a CSV file in which some lines are cut short and some values are no numbers."""
    txns = _raw(spark, d)
    number = F.col("TransactionId").cast("long")
    value = F.when(number % 50 == 1, F.lit("lots")).otherwise(F.col("Value"))
    fields = [value if c == "Value" else F.col(c) for c in txns.columns]
    whole = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in fields])
    path = new_shared_path(spark, "csv")
    txns.select(F.when(number % 50 == 0, F.concat_ws(",", *fields[:3])).otherwise(whole).alias("line")).write.text(path)
    rejects = read_with_rejects(spark, path, header=False)[1]
    first = F.coalesce("TransactionId", F.split("line", ",")[0])
    return rejects.select(first.alias("TransactionId"), "problems", "line")


@query
def json_rejects(spark, d):
    """The same for JSON lines, some of which end too early."""
    txns = _raw(spark, d)
    text = F.to_json(F.struct(*txns.columns))
    path = new_shared_path(spark, "json")
    cut = F.when(F.col("TransactionId").cast("long") % 50 == 0, F.substring(text, 1, 40)).otherwise(text)
    txns.select(cut.alias("line")).write.text(path)
    rejects = read_with_rejects(spark, path, "json")[1]
    return rejects.select("problems", F.length("line").alias("line_length")).groupBy("problems", "line_length").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_accounts(spark, d):
    return lines(spark, d).select(ACCOUNT).distinct()


# --- account features -----------------------------------------------------


@query
def account_rfm(spark, d):
    return features_of(lines(spark, d), "Recency", "Frequency", "Monetary", "HasFraud")


@query
def account_spend_stats(spark, d):
    return features_of(
        lines(spark, d), "AvgAmount", "MaxValue", "MinAmount", "StdAmount", "TotalFraudTransactions"
    )


@query
def account_distincts(spark, d):
    return features_of(lines(spark, d), *[c for c in FEATURES if c.startswith("Unique")])


@query
def account_distincts_of_period(spark, d):
    """Distinct counts of three years from stored sketches of accounts and days."""
    stored = store(daily_sketches(lines(spark, d)), "sketches")
    return period_distincts(stored, dt.date(1995, 1, 1), dt.date(1997, 12, 31))


@query
def account_modes(spark, d):
    return features_of(lines(spark, d), *[c for c in FEATURES if c.startswith("MostFrequent")])


@query
def account_time_stats(spark, d):
    return features_of(events(spark, d), *[c for c in FEATURES if "Transaction" in c and c != LEAKAGE])


@query
def account_features(spark, d):
    return rounded(customer_features(lines(spark, d)))


@query
def account_features_events(spark, d):
    return rounded(customer_features(events(spark, d)))


@query
def account_features_own_reference(spark, d):
    return rounded(customer_features(events(spark, d), reference_time="account"))


@query
def rfm_summary_signed(spark, d):
    return rounded(rfm_summary(lines(spark, d)))


@query
def head_accounts(spark, d):
    return profile.head(rounded(customer_features(lines(spark, d))), ACCOUNT, 5)


# --- profiling ------------------------------------------------------------


@query
def profile_overview(spark, d):
    return profile.overview(events(spark, d))


@query
def profile_describe(spark, d):
    return rounded(profile.describe(lines(spark, d)))


@query
def profile_histogram(spark, d):
    return rounded(profile.histogram(lines(spark, d)))


@query
def profile_kde(spark, d):
    return rounded(profile.kernel_density(lines(spark, d)), 9)


@query
def profile_class_share(spark, d):
    return rounded(profile.class_share(lines(spark, d), "FraudResult"))


@query
def profile_value_counts(spark, d):
    return profile.value_counts(events(spark, d))


@query
def profile_category_by_fraud(spark, d):
    return profile.category_by_fraud(events(spark, d))


@query
def profile_corr_matrix(spark, d):
    return rounded(correlation_matrix(lines(spark, d)), 6)


@query
def profile_corr_label(spark, d):
    return rounded(correlation_with(lines(spark, d), "FraudResult"), 6)


@query
def profile_missing(spark, d):
    return rounded(profile.missing_values(events(spark, d)))


def _in_order(df):
    """Place and first column of each row of a report with a row per column, as it comes."""
    rows = [(i, r[0]) for i, r in enumerate(df.select("column").collect())]
    return df.sparkSession.createDataFrame(rows, "position long, column string")


@query
def profile_missing_order(spark, d):
    """Columns with missing values as they are listed: the most affected first, of equal ones by name."""
    number = F.col("TransactionId")
    holes = {"Value": number % 3 > 0, "ChannelId": number % 5 > 0, "AccountId": number % 5 > 0}
    txns = events(spark, d)
    return _in_order(profile.missing_values(txns.withColumns({c: F.when(kept, F.col(c)) for c, kept in holes.items()})))


@query
def profile_box_stats(spark, d):
    return rounded(profile.box_stats(lines(spark, d)))


@query
def profile_outlier_rows(spark, d):
    return rounded(profile.outlier_rows(events(spark, d), "TransactionId"))


@query
def fraud_by_hour(spark, d):
    return profile.fraud_by(events(spark, d), F.hour("TransactionStartTime"), "hour")


@query
def fraud_by_weekday(spark, d):
    return profile.fraud_by(events(spark, d), F.weekday("TransactionStartTime"), "weekday")


@query
def account_class_share(spark, d):
    return rounded(profile.class_share(rfm_summary(lines(spark, d)), TARGET))


@query
def account_box_by_fraud(spark, d):
    accounts = store(rfm_summary(lines(spark, d)), "accounts")
    return rounded(profile.box_stats(accounts, RFM_BOXES, by=TARGET))


@query
def account_corr_matrix(spark, d):
    return rounded(correlation_matrix(rfm_summary(lines(spark, d))), 6)


@query
def account_corr_label(spark, d):
    return rounded(correlation_with(rfm_summary(lines(spark, d)), TARGET), 6)


# --- encoding -------------------------------------------------------------


@query
def align_columns_query(spark, d):
    return rounded(align_columns(customer_features(lines(spark, d)), ALIGNED))


@query
def one_hot_modes(spark, d):
    features = store(customer_features(lines(spark, d), columns=["Frequency", *MODES]), "modes")
    return OneHotModel.fit(features, MODES).transform(features)


@query
def one_hot_places(spark, d):
    """Place of each category's 1 in its sparse vector."""
    features = store(customer_features(lines(spark, d), columns=["Frequency", *MODES]), "modes")
    return OneHotVectors.fit(features, MODES).indexed(features)


@query
def impute_median(spark, d):
    txns = events(spark, d).select(
        "TransactionId",
        F.when(F.col("CurrencyCode").isNotNull(), F.col("Amount")).alias("Amount"),
        F.when(F.col("CurrencyCode") != "UGX", F.col("Value")).alias("Value"),
    )
    stats = fit_numeric(txns, ["Amount", "Value"])
    return rounded(
        txns.select("TransactionId", *[s.imputed(F.col(s.feature)).alias(s.feature) for s in stats])
    )


@query
def standardize(spark, d):
    features = stored_features(spark, d)
    stats = fit_numeric(features, feature_columns(features)[0])
    return rounded(
        features.select(ACCOUNT, *[s.standardized(F.col(s.feature)).alias(f"num__{s.feature}") for s in stats])
    )


@query
def rescale(spark, d):
    """The optional second standardisation, over already standardised inputs."""
    features = stored_features(spark, d)
    columns = ["Monetary", "AvgAmount", "StdAmount"]
    first = fit_numeric(features, columns)
    once = store(features.select(ACCOUNT, *[s.standardized(F.col(s.feature)).alias(s.feature) for s in first]), "scaled")
    second = fit_numeric(once, columns)
    return rounded(once.select(ACCOUNT, *[s.standardized(F.col(s.feature)).alias(s.feature) for s in second]))


@query
def woe_auto_columns_query(spark, d):
    chosen = woe_auto_columns(stored_features(spark, d).drop(TARGET))
    return spark.createDataFrame(list(enumerate(chosen)), "position int, feature string")


@query
def woe_fit(spark, d):
    return rounded(woe_table(stored_features(spark, d), MODES, TARGET), 6)


@query
def woe_transform(spark, d):
    features = stored_features(spark, d)
    weighted = WoeModel.fit(features, MODES, TARGET).transform(features.select(ACCOUNT, *MODES))
    return rounded(weighted, 6)


@query
def woe_absent_column(spark, d):
    """A column that the encoding was fitted on but the table lacks is 0."""
    features = stored_features(spark, d)
    model = WoeModel.fit(features, MODES[:2], TARGET)
    return rounded(model.transform(features.select(ACCOUNT, MODES[0])), 6)


@query
def preprocess_all(spark, d):
    return rounded(preprocess(build_features(lines(spark, d)))[0])


# --- sampling -------------------------------------------------------------


@query
def split_stratified(spark, d):
    return build_features(lines(spark, d)).select(ACCOUNT, TARGET, "split")


@query
def split_roundtrip(spark, d):
    path = new_shared_path(spark, "splits")
    save_splits(rounded(build_features(lines(spark, d)).select(ACCOUNT, TARGET, "Monetary", "split")), path)
    train, test = load_splits(spark, path, TARGET)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query
def class_counts(spark, d):
    return sample.class_counts(customer_features(lines(spark, d), columns=[TARGET]), TARGET)


@query
def class_weights(spark, d):
    return rounded(sample.class_weights(customer_features(lines(spark, d), columns=[TARGET]), TARGET), 6)


def _oversampled(spark, d):
    features = store(customer_features(lines(spark, d), columns=[TARGET, "Monetary"]), "labels")
    return rounded(sample.oversample(features, TARGET, ACCOUNT))


@query
def oversample_minority(spark, d):
    return _oversampled(spark, d)


@query
def oversampled_class_counts(spark, d):
    return sample.class_counts(_oversampled(spark, d), TARGET)


@query
def shuffled_rows(spark, d):
    accounts = store(customer_features(lines(spark, d), columns=[TARGET]), "labels")
    return sample.shuffle_rows(accounts, ACCOUNT, position="position")


# --- scores and terms -----------------------------------------------------


@query
def score_odd_probabilities(spark, d):
    """Probabilities below 0 and above 1, NaN, missing, exactly 1, and a plain one."""
    kind = F.col(ACCOUNT) % 6
    p = F.when(kind == 0, -0.1).when(kind == 1, 1.1).when(kind == 2, float("nan")).when(kind == 4, 1.0).when(kind == 5, 0.5)
    accounts = customer_features(events(spark, d), columns=["Frequency"])
    return score_and_terms(accounts.select(ACCOUNT, p.alias("p"))).select(ACCOUNT, "status", "credit_score")


@query
def score_from_probability(spark, d):
    rates = with_fraud_rate(customer_features(events(spark, d)))
    return rounded(rates.select(ACCOUNT, "p", credit_score(F.col("p")).alias("credit_score")), 6)


@query
def loan_terms(spark, d):
    score = F.col("credit_score")
    scored = with_fraud_rate(customer_features(lines(spark, d))).withColumn(
        "credit_score", credit_score(F.col("p"))
    )
    return scored.select(
        ACCOUNT,
        score,
        loan_amount(score).alias("recommended_loan_amount"),
        loan_duration(score).alias("recommended_loan_duration"),
        loan_tier(score).alias("interest_rate_tier"),
    )


@query
def score_report(spark, d):
    return response(score_and_terms(with_fraud_rate(customer_features(lines(spark, d)))))


# --- metrics --------------------------------------------------------------


def _judged(spark, d):
    # minimum and maximum are the same however often they are computed
    return with_ratio(customer_features(lines(spark, d), columns=["HasFraud", "MinAmount", "MaxValue"]))


@query
def roc_auc(spark, d):
    return rounded(metrics.roc_auc(_judged(spark, d), TARGET), 6)


@query
def pr_curve(spark, d):
    return rounded(metrics.pr_curve(_judged(spark, d), TARGET), 6)


@query
def pr_auc(spark, d):
    return rounded(metrics.pr_auc(_judged(spark, d), TARGET), 6)


@query
def classification_report(spark, d):
    return rounded(metrics.classification_report(_judged(spark, d), TARGET), 6)


@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_judged(spark, d), TARGET)


# --- models -------------------------------------------


@lru_cache(maxsize=8)
def _fitted(spark: SparkSession, d: str) -> tuple[CreditModel, DataFrame]:
    return fit_credit_model(lines(spark, d))


@query
def lr_scores(spark, d):
    model, inputs = _fitted(spark, d)
    test = inputs.where("split = 'test'")
    return rounded(model.probabilities(test).select(ACCOUNT, TARGET, "p", "prediction"), 6)


@lru_cache(maxsize=8)
def _boosted(spark: SparkSession, d: str) -> tuple[CreditModel, DataFrame]:
    model, inputs = _fitted(spark, d)
    classifier = train_model(
        inputs.where("split = 'train'"), model.preprocessor.outputs, "gradient_boosting"
    )
    return CreditModel(model.preprocessor, classifier), inputs


@query
def gbt_walk(spark, d):
    """Whether the paths of the flattened trees give each test account the model's probability and class."""
    boosted, inputs = _boosted(spark, d)
    nodes = tree_nodes(spark, boosted.classifier.stages[-1])
    scored = boosted.probabilities(inputs.where("split = 'test'"))
    p = walked_probability(nodes, boosted.preprocessor.outputs)
    same = (F.abs(p - F.col("p")) < 1e-12) & ((p > 0.5).cast("double") == F.col("prediction"))
    return scored.select(ACCOUNT, same.alias("same"))


@query
def gbt_scores(spark, d):
    boosted, inputs = _boosted(spark, d)
    return boosted.probabilities(inputs.where("split = 'test'")).select(ACCOUNT, TARGET, "p", "prediction")


@query
def lr_evaluation(spark, d):
    model, inputs = _fitted(spark, d)
    scored = model.probabilities(inputs.where("split = 'test'")).withColumn("p", F.round("p", 9))
    return rounded(metrics.roc_auc(scored, TARGET).withColumn("pr_auc", metrics.pr_auc(scored, TARGET).scalar()), 6)


@query
def score_transactions_query(spark, d):
    return score_transactions(lines(spark, d), _fitted(spark, d)[0])


@query
def score_raw_records(spark, d):
    return score_records(_raw(spark, d), _fitted(spark, d)[0])


@query
def score_mixed_records(spark, d):
    """A batch in which every third account has refused records."""
    filled = F.when(F.col(ACCOUNT).cast("long") % 3 > 0, F.coalesce("CurrencyCode", F.lit("XXX"))).otherwise(F.col("CurrencyCode"))
    return score_records(_raw(spark, d).withColumn("CurrencyCode", filled), _fitted(spark, d)[0])


@query
def score_stream_query(spark, d):
    source = spark.read.parquet(f"{d}/events.parquet")
    stream = (
        spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    )
    out = new_shared_path(spark, "scores")
    started = score_stream(
        txns_from_events(stream), _fitted(spark, d)[0], out, new_shared_path(spark, "stream")
    )
    started.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _quarantined(spark, d):
    source = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kept = new_shared_path(spark, "quarantine")
    out, state = new_shared_path(spark, "scores"), new_shared_path(spark, "stream")
    score_stream(txns_from_events(stream), _fitted(spark, d)[0], out, state, quarantine_path=kept).awaitTermination()
    return kept


@query
def stream_quarantine(spark, d):
    """Refused records of a stream."""
    return spark.read.parquet(f"{_quarantined(spark, d)}/records").select("TransactionId", "problems")


@query
def stream_counts(spark, d):
    """Records, refused ones, accounts and errors of the batches of a stream."""
    counts = spark.read.parquet(f"{_quarantined(spark, d)}/counts")
    return counts.agg(*[F.sum(c).alias(c) for c in ("records", "refused", "accounts", "errors")])


@query
def model_roundtrip(spark, d):
    model, inputs = _fitted(spark, d)
    path = new_shared_path(spark, "model")
    model.save(path)
    loaded = CreditModel.load(spark, path)
    test = inputs.where("split = 'test'")
    before = model.probabilities(test).select(ACCOUNT, F.col("p").alias("p_before"))
    after = loaded.probabilities(test).select(ACCOUNT, F.col("p").alias("p_after"))
    return before.join(after, ACCOUNT).select(ACCOUNT, (F.col("p_before") == F.col("p_after")).alias("same"))


@query
def lr_optimality(spark, d):
    """Size of the penalised loss's gradient at the fitted coefficients, to 3 places: 0 at the optimum.

    The balanced classes have weight 1.
    """
    model, inputs = _fitted(spark, d)
    names = model.preprocessor.outputs
    train = inputs.where("split = 'train'").select(ACCOUNT, TARGET, *names)
    scored = model.probabilities(sample.oversample(train, TARGET, ACCOUNT))
    error = F.col("p") - F.col(TARGET)
    gradient = [
        (F.avg(error * F.col(name)) + F.lit(float(weight)) / F.count(F.lit(1))).alias(name)
        for name, weight in zip(names, model.classifier.coefficients, strict=True)
    ]
    sums = scored.agg(*gradient, F.avg(error).alias("intercept"))
    lines_ = [F.struct(F.lit(c).alias("feature"), F.round(F.abs(F.col(c)), 3).alias("gradient")) for c in sums.columns]
    return sums.select(F.explode(F.array(*lines_)).alias("r")).select("r.*")
