"""Scoring as a stream: one micro-batch is one request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.features import ReferenceTime
from ..plans.scoring import score_records
from ..plans.training import CreditModel
from ..schema import TRANSACTIONS
from ..sources.validation import validate_transactions


def score_stream(
    records: DataFrame,
    model: CreditModel,
    out_path: str,
    checkpoint_path: str,
    reference_time: ReferenceTime = "account",
    trigger: dict | None = None,
    schema: StructType = TRANSACTIONS,
    quarantine_path: str | None = None,
) -> StreamingQuery:
    """Score every micro-batch of a stream of raw or typed records into parquet files.

    Records are checked as in ``score_records``: an account with a missing or
    unreadable field in the batch gets ``status = 'error'``, the others are scored
    from their transactions in the batch. A batch writes its own folder and
    replaces it when repeated, so a restart after a failure leaves each result
    once. With a model that needs other features than those of transactions every
    account gets status ``error`` and the mismatch as its message.

    In ``quarantine_path`` each batch leaves its refused records with their problems
    (``records``) and one line of counts (``counts``: records, refused, accounts,
    errors), under the same rule. The counts come last: a batch that has them is whole.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # checks and features read it several times
        try:
            scored = score_records(batch, model, reference_time, schema=schema, on_mismatch="status")
            own = f"{out_path}/batch={batch_id}"
            scored.write.mode("overwrite").parquet(own)
            if quarantine_path is None:
                return
            rejects = validate_transactions(batch, schema)[1]
            kept = f"{quarantine_path}/records/batch={batch_id}"
            rejects.write.mode("overwrite").parquet(kept)
            spark = batch.sparkSession
            done = spark.read.schema(scored.schema).parquet(own).agg(F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("status") == "error").alias("errors"))
            refused = spark.read.schema(rejects.schema).parquet(kept).agg(F.count(F.lit(1)))
            counts = done.select(F.lit(batch.count()).alias("records"), refused.scalar().alias("refused"), "accounts", "errors")
            counts.coalesce(1).write.mode("overwrite").parquet(f"{quarantine_path}/counts/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        records.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
