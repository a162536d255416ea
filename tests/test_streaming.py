"""Posting wallet requests from a stream of JSON bodies, micro-batch by micro-batch."""

import datetime as dt
import json
import os
import tempfile
from decimal import Decimal as D

from pyspark.sql import types as T

from counterbook.operators.fees import post_wallet_transactions
from counterbook.streaming.requests import post_request_stream, start_ledger

BODY = T.StructType([T.StructField("seq", T.LongType()), T.StructField("service_type", T.StringType()),
                     T.StructField("reference_number", T.StringType()),
                     T.StructField("principal_amount", T.DoubleType())])


def test_stream_posts_against_previous_batches(spark):
    root = tempfile.mkdtemp(prefix="cb-stream-")
    src, ledger, outcome, ckpt = (os.path.join(root, x) for x in ("in", "ledger", "out", "ckpt"))
    os.makedirs(src)
    rules = spark.createDataFrame([(1, "cash_in", D("0.00"), None, D("5.00"), True, None, None, None)],
                                  "id bigint, service_type string, min_amount decimal(12,2), max_amount decimal(12,2), "
                                  "fee_amount decimal(12,2), is_active boolean, effective_from timestamp_ntz, "
                                  "effective_to timestamp_ntz, created_at timestamp_ntz")
    start_ledger(spark.createDataFrame([("x1", "OLD-1", "cash_in", D("10.00"), D("5.00"), D("15.00"), D("15.00"))],
                                       "id string, reference_number string, service_type string, "
                                       "principal_amount decimal(12,2), fee_amount decimal(12,2), "
                                       "gross_amount decimal(12,2), cash_impact decimal(12,2)"), ledger)

    def post(batch, led):
        return post_wallet_transactions(batch, rules, led, as_of=dt.datetime(2024, 1, 1).isoformat(sep=" "))

    def run():
        q = post_request_stream(spark, src, "gcash_transaction", BODY, post, ledger, outcome, ckpt)
        q.awaitTermination(120)

    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps({"seq": 1, "service_type": "cash_in", "reference_number": "A", "principal_amount": 10}) + "\n")
        f.write(json.dumps({"gcash_transaction": {"seq": 2, "service_type": "cash_in", "reference_number": "OLD-1",
                                                  "principal_amount": 10}}) + "\n")
    run()
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(json.dumps({"gcash_transactions": {"seq": 3, "service_type": "cash_in", "reference_number": "A",
                                                   "principal_amount": 5}}) + "\n")
        f.write(json.dumps({"seq": 4, "service_type": "cash_in", "reference_number": "B", "principal_amount": 5}) + "\n")
    run()
    out = {r["seq"]: r["reject_reason"] for r in spark.read.parquet(outcome).collect()}
    assert out == {1: None, 2: "reference_number already exists", 3: "reference_number already exists", 4: None}
    refs = sorted(r["reference_number"] for r in spark.read.parquet(ledger).collect())
    assert refs == ["A", "B", "OLD-1"]
    gross = {r["reference_number"]: r["gross_amount"] for r in spark.read.parquet(ledger).collect()}
    assert gross["A"] == D("15.00") and gross["B"] == D("10.00")
