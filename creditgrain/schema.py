"""Column contracts of the transaction, account and response tables."""

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("TransactionId", T.LongType()),
        T.StructField("BatchId", T.LongType()),
        T.StructField("AccountId", T.LongType()),
        T.StructField("SubscriptionId", T.LongType()),
        T.StructField("CustomerId", T.LongType()),
        T.StructField("CurrencyCode", T.StringType()),
        T.StructField("CountryCode", T.IntegerType()),
        T.StructField("ProviderId", T.LongType()),
        T.StructField("ProductId", T.LongType()),
        T.StructField("ProductCategory", T.StringType()),
        T.StructField("ChannelId", T.StringType()),
        T.StructField("Amount", T.DoubleType()),
        T.StructField("Value", T.DoubleType()),
        T.StructField("TransactionStartTime", T.TimestampNTZType()),
        T.StructField("PricingStrategy", T.IntegerType()),
        T.StructField("FraudResult", T.IntegerType()),
    ]
)

ID_COLUMNS = (
    "TransactionId",
    "BatchId",
    "AccountId",
    "SubscriptionId",
    "CustomerId",
    "ProviderId",
    "ProductId",
)

ACCOUNT = "AccountId"
TARGET = "HasFraud"
LEAKAGE = "TotalFraudTransactions"
# Never fed to a model: the identifier, the target and the column that gives it away.
NOT_FEATURES = (TARGET, ACCOUNT, LEAKAGE)

RESPONSE = (
    "AccountId",
    "risk_probability",
    "credit_score",
    "recommended_loan_amount",
    "recommended_loan_duration",
    "interest_rate_tier",
    "message",
)


def with_string_ids(schema: T.StructType = TRANSACTIONS) -> T.StructType:
    """The same table where ids are text, e.g. ``AccountId_123``."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name in ID_COLUMNS else f.dataType)
            for f in schema
        ]
    )
