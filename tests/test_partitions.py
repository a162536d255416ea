"""Changes in partition folders, the closing run's pruning, malformed bodies, all references in one shuffle."""

import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterbook.operators import cash as C
from counterbook.operators import partitions as PA
from counterbook.operators import quality as Q
from counterbook.sources import tables as TB


def _stored(spark, tmp_path, days=40):
    path = str(tmp_path / "ledger")
    spark.range(4000).selectExpr("id", f"date_add(date'2024-01-01', cast(id % {days} as int)) as day", "'open' as status", "id * 2 as amount").repartition(3).write.partitionBy("day").parquet(path)
    return path


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def _folders(names):
    return {os.path.basename(os.path.dirname(f)) for f in names}


def test_small_patch_rewrites_only_its_folders(spark, tmp_path):
    path = _stored(spark, tmp_path)
    before = _files(path)
    patches = spark.createDataFrame([(i * 40 + i % 2, "late") for i in range(10)] + [(10**9, "lost")], "id long, status string")
    outcome = PA.patch_partitions(spark, path, ["day"], patches)
    after = _files(path)
    assert _folders(set(before) - set(after)) == {"day=2024-01-01", "day=2024-01-02"}
    assert _folders(set(after) - set(before)) == {"day=2024-01-01", "day=2024-01-02"}
    assert all(before[f] == after[f] for f in set(before) & set(after)) and len(_folders(after)) == 40
    now = spark.read.parquet(path)
    assert now.count() == 4000 and now.filter("status = 'late'").count() == 10
    assert {r.id: r.matched for r in outcome.collect()}[10**9] is False and outcome.filter("matched").count() == 10


def test_patch_of_the_partition_column_moves_rows(spark, tmp_path):
    path = _stored(spark, tmp_path, days=4)
    rows = spark.read.parquet(path).filter("day = date'2024-01-02'").select("id", F.lit(dt.date(2024, 1, 3)).alias("day"))
    moved = rows.count()
    PA.patch_partitions(spark, path, ["day"], rows.unionByName(spark.createDataFrame([(0, dt.date(2030, 5, 5))], "id long, day date")))
    got = {r.day.isoformat(): r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()}
    assert got == {"2024-01-01": 999, "2024-01-03": 1000 + moved, "2024-01-04": 1000, "2030-05-05": 1}
    assert _folders(_files(path)) == {"day=2024-01-01", "day=2024-01-03", "day=2024-01-04", "day=2030-05-05"}


def test_deletes_touch_their_folders_and_remove_emptied_ones(spark, tmp_path):
    path = _stored(spark, tmp_path)
    before = _files(path)
    day = spark.read.parquet(path).filter("day = date'2024-01-05'").select("id").collect()
    keys = spark.createDataFrame([*[(r.id,) for r in day], (7,), (7,), (None,), (-1,)], "id long")
    gone = PA.delete_from_partitions(spark, path, ["day"], keys)
    assert gone.count() == len(day) + 1 and gone.columns == ["id", "status", "amount", "day"]
    after = _files(path)
    assert _folders(set(before) ^ set(after)) == {"day=2024-01-05", "day=2024-01-08"}
    assert "day=2024-01-05" not in _folders(after)
    assert spark.read.parquet(path).count() == 4000 - len(day) - 1
    assert PA.delete_from_partitions(spark, path, ["day"], keys.limit(0)).count() == 0 and _files(path) == after


def test_partitions_with_null_values_and_two_columns(spark, tmp_path):
    path = str(tmp_path / "two")
    rows = [(k, None if k % 3 == 0 else k % 3, "x y" if k % 2 else None, "a") for k in range(30)]
    spark.createDataFrame(rows, "id long, p int, q string, v string").write.partitionBy("p", "q").parquet(path)
    PA.patch_partitions(spark, path, ["p", "q"], spark.createDataFrame([(0, "b"), (1, "b")], "id long, v string"))
    PA.delete_from_partitions(spark, path, ["p", "q"], spark.createDataFrame([(3,), (4,)], "id long"))
    got = sorted((r.id, r.p, r.q, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(k, p, q, "b" if k < 2 else v) for k, p, q, v in rows if k not in (3, 4)]


def test_closing_run_prunes_day_folders_without_a_job(spark, tmp_path):
    path = str(tmp_path / "wallet")
    ledger = spark.range(900).selectExpr(
        "id", "id % 3 as branch_id", "timestamp_ntz'2023-01-01 10:00:00' + make_interval(0, 0, 0, cast(id % 300 as int)) as created_at", "'cash_in' as service_type",
        "cast(10 as decimal(12,2)) as gross_amount", "cast(9 as decimal(12,2)) as principal_amount", "cast(10 as decimal(12,2)) as cash_impact")
    ledger.withColumn("day", F.to_date("created_at")).repartition("day").write.partitionBy("day").parquet(path)
    wallet = spark.read.parquet(path)
    orders = spark.createDataFrame([], "id long, branch_id long, created_at timestamp_ntz, order_status string, total_amount decimal(12,2)")
    payments = spark.createDataFrame([], "order_id long, payment_date timestamp_ntz, payment_method string, amount decimal(12,2)")
    prepaid = spark.createDataFrame([], "branch_id long, created_at timestamp_ntz, cash_impact decimal(12,2)")
    recons = spark.createDataFrame([(k, k % 3, dt.date(2023, 1, 1) + dt.timedelta(k)) for k in range(300)], "id long, branch_id long, business_date date")
    closings = spark.createDataFrame([(2,), (298,)], "id long")  # one late closing, one recent
    spark.sparkContext.setJobGroup("building", "building")
    totals = C.daily_cash_totals(orders, payments, wallet, prepaid, days=C.closing_days(recons, closings), day_col="day")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {(r.branch_id, r.business_date): r.gcash_cash_in_total for r in totals.collect()}
    assert got == {(2, dt.date(2023, 1, 3)): 30, (1, dt.date(2023, 10, 26)): 30}
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_malformed_bodies_are_set_aside_once(spark, tmp_path):
    lines = ['{"id": 1, "name": "a"}', '{"id": "abc", "name": "b"}', '{"id": 3, "name"', "", "   ", "[1, 2]", "null", "no json", '{"item": {"id": 4, "name": "d"}}',
             '{"item": {"id": "x"}}', '{"item": null, "id": 5}', '{"other": 1}', '{"item": {}}']
    path = str(tmp_path / "bodies")
    spark.createDataFrame([(x,) for x in lines], "value string").repartition(3).write.text(path)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    rows, malformed = TB.read_envelopes_checked(spark, path, "item", schema)
    assert sorted(((r.id, r.name) for r in rows.collect()), key=str) == sorted([(1, "a"), (4, "d"), (5, None), (None, None), (None, None)], key=str)
    got = {r.body: r.reason for r in malformed.collect()}
    assert malformed.count() == 6
    assert got == {'{"id": "abc", "name": "b"}': "a field has another type", '{"item": {"id": "x"}}': "a field has another type",
                   **{x: "not a JSON object" for x in ('{"id": 3, "name"', "[1, 2]", "null", "no json")}}


def test_all_references_in_one_shuffle(spark):
    parent = spark.range(100).selectExpr("id", "id % 7 as boss")
    child = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 5 when id % 3 = 1 then id else null end as up", "id % 50 as other")
    edges = [("child", "up", "parent"), ("child", "other", "parent"), ("parent", "boss", "parent"), ("child", "id", "absent")]
    found = Q.audit_all_references({"child": child, "parent": parent}, edges)
    want = Q.audit_references(child, "up", parent).count()
    assert [tuple(r) for r in found.collect()] == [("child", "up", "parent", want)]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(edge") == 2 * (2 if "Initial Plan" in text else 1)  # one for (edge, key), one for the sums per edge
    assert Q.audit_all_references({"child": child}, edges) is None
