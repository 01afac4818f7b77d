import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from creditgrain.session import session  # noqa: E402
from creditgrain.sources import from_records  # noqa: E402
from records import records  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def ten(spark):
    return from_records(spark, records()).cache()


@pytest.fixture
def make(spark):
    """Transactions from partial records; unnamed columns get plain values."""

    def build(*partial):
        base = records()[0] | {"TransactionStartTime": dt.datetime(2024, 1, 1)}
        return from_records(
            spark, [base | {"TransactionId": i} | p for i, p in enumerate(partial)]
        )

    return build
