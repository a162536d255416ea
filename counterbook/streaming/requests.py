"""Posting requests as they arrive: Structured Streaming over a folder of
JSON request bodies, each micro-batch checked by a posting operator
(``post_wallet_transactions``, ``post_prepaid_sales``, ``post_deposits`` ...)
against the ledger as of the previous micro-batch.

Exactly-once effects come from idempotent writes keyed by the micro-batch id:
the ledger folder is partitioned by ``epoch`` (the starting table is written
as ``epoch=-1``); batch N reads only ``epoch < N`` (partition pruning) and
overwrites its own ``epoch=N`` folders of the ledger and of the outcome log
(never a folder it reads). A micro-batch replayed after a failure therefore sees the same ledger
and rewrites the same partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import new_id
from ..sources.tables import envelope_body, envelope_schema

PostFn = Callable[[DataFrame, DataFrame], DataFrame]


def start_ledger(df: DataFrame, ledger_path: str) -> None:
    """Write the starting ledger as partition ``epoch=-1``."""
    df.write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}/epoch=-1")


def post_request_stream(spark: SparkSession, source_dir: str, resource: str, schema: T.StructType, post: PostFn,
                        ledger_path: str, outcome_path: str, checkpoint_location: str,
                        id_column: str = "id", available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``. ``post(batch,
    ledger)`` must return the batch with the ledger's columns (except ids)
    and ``reject_reason``; accepted rows are appended to the ledger with an id
    derived from their unique reference number when the ledger has an id
    column the outcome lacks."""
    raw = spark.readStream.schema(envelope_schema(resource, schema)).json(source_dir)
    requests = envelope_body(raw, resource, schema)

    def handle(batch: DataFrame, epoch_id: int) -> None:
        ledger_all = spark.read.parquet(ledger_path)
        ledger = ledger_all.filter(F.col("epoch") < F.lit(epoch_id)).drop("epoch")
        outcome = post(batch, ledger)
        # each micro-batch owns its partition folders: a replay rewrites them
        outcome.write.mode("overwrite").parquet(f"{outcome_path.rstrip('/')}/epoch={epoch_id}")
        ok = outcome.filter(F.col("reject_reason").isNull())
        cols = []
        for f in ledger.schema.fields:
            if f.name in ok.columns:
                cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
            elif f.name == id_column:
                # same id on a replayed micro-batch when the reference is known
                row_id = (new_id(resource, f.dataType, "reference_number") if "reference_number" in ok.columns
                          else F.expr("uuid()"))
                cols.append(row_id.cast(f.dataType).alias(f.name))
            else:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        ok.select(*cols).write.mode("overwrite").parquet(f"{ledger_path.rstrip('/')}/epoch={epoch_id}")

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
