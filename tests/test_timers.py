"""Leases and deliveries as streams, over several batches, with late, renewed, superseded and replayed facts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evispark.operators.runs import delivery_status
from evispark.streaming import streams as X
from evispark.streaming import timers as T

START = dt.datetime(2024, 1, 1)
LEASES = "item long, attempt long, event_id long, kind string, at timestamp, lease_until timestamp"
FACTS = "seq long, at timestamp, kind string, id long, from_audit boolean, missing long, seen long"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_leases(spark, rocks, tmp_path):
    event = lambda item, attempt, i, kind, at, lease=15: (item, attempt, i, kind, minutes(at), minutes(at + lease))
    batches = [
        [event(1, 1, 1, "claim", 0), event(2, 1, 2, "claim", 0), event(3, 1, 3, "claim", 1), event(4, 1, 4, "claim", 1), event(5, 1, 16, "claim", 1)],
        [event(1, 1, 5, "renew", 10), event(2, 1, 6, "result", 9), event(3, 2, 7, "claim", 12), event(5, 1, 17, "claim", 5)],
        [event(3, 1, 8, "result", 13), event(9, 1, 9, "claim", 24)],  # the first attempt of item 3 was taken over
        [event(1, 1, 10, "renew", 24), event(9, 1, 11, "renew", 38)],  # item 4 runs out by its timer; item 1 is renewed in time
        [event(4, 1, 12, "result", 37), event(3, 2, 13, "result", 36), event(9, 1, 14, "result", 90), event(8, 1, 15, "claim", 200)],
    ]
    got, log = [], f"{tmp_path}/log"
    for n, b in enumerate(batches):
        spark.createDataFrame(b, LEASES).coalesce(1).write.mode("append").parquet(log)
        s = X.tail(spark, log, spark.read.parquet(log).schema)
        rows = X.drained(T.lease_outcomes(s, "5 minutes"), "append", f"{tmp_path}/c", f"{tmp_path}/o").collect()
        got = sorted((r["item"], r["attempt"], r["outcome"], int((r["at"] - START).total_seconds() // 60)) for r in rows)
    assert got == [
        (1, 1, "stale", 39), (2, 1, "done", 9), (3, 1, "superseded", 13), (3, 2, "stale", 27), (3, 2, "superseded", 36), (4, 1, "stale", 16), (4, 1, "superseded", 37),
        (5, 1, "stale", 16), (5, 1, "superseded", 5), (9, 1, "stale", 53), (9, 1, "superseded", 90),
    ]


def batch_form(spark, rows, clock):
    f = spark.createDataFrame(rows, FACTS)
    runs = f.where("kind = 'finished'").groupBy("id").agg(F.min("at").alias("finished_at"), F.max("from_audit").alias("from_audit"))
    inv = f.where("kind = 'inventory'").groupBy("id").agg(F.max_by("missing", "seq").alias("missing"), F.max_by("seen", "seq").alias("seen"))
    return {r["id"]: r["delivery"] for r in delivery_status(runs, inv, F.lit(clock).cast("timestamp")).select("id", "delivery").collect()}


def test_reconcile_equals_the_batch_form_after_every_batch(spark, tmp_path):
    s = lambda n: START + dt.timedelta(seconds=n)
    batches = [
        [(1, s(0), "finished", 1, False, None, None), (2, s(0), "finished", 2, True, None, None), (3, s(1), "inventory", 3, None, 0, 4), (4, s(0), "finished", 4, False, None, None)],
        [(5, s(20), "inventory", 1, None, 0, 3), (6, s(20), "inventory", 4, None, 2, 1), (7, s(21), "finished", 3, True, None, None)],
        [(8, s(50), "tick", None, None, None, None)],  # 4 has waited 45 s: incomplete; 2 has nothing, pending until 60 s
        [(9, s(55), "inventory", 4, None, 0, 3), (10, s(70), "finished", 5, False, None, None)],
        [(11, s(400), "tick", None, None, None, None)],
    ]
    seen = []
    for n, b in enumerate(batches):
        T.reconcile_batch(spark.createDataFrame(b, FACTS), n, f"{tmp_path}/out")
        if n in (1, 3):  # replayed after a crash
            T.reconcile_batch(spark.createDataFrame(b, FACTS), n, f"{tmp_path}/out")
        seen += b
        got = {r["id"]: r["delivery"] for r in T.deliveries(spark, f"{tmp_path}/out").collect()}
        assert got == batch_form(spark, seen, max(x[1] for x in seen))
    assert got[1] == "original_materialized" and got[2] == "unrecoverable" and got[3] == "recovered_from_audit"
    # a final status stays, whatever comes later
    T.reconcile_batch(spark.createDataFrame([(12, s(500), "inventory", 2, None, 0, 1)], FACTS), 5, f"{tmp_path}/out")
    assert {r["id"]: r["delivery"] for r in T.deliveries(spark, f"{tmp_path}/out").collect()} == got


def test_reconcile_as_a_stream(spark, tmp_path):
    spark.createDataFrame([(i, minutes(i), "finished", i, False, None, None) for i in range(5)], FACTS).repartition(3).write.parquet(f"{tmp_path}/log")
    stream = X.tail(spark, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/log").schema)
    for _ in range(2):  # the second run finds nothing new
        T.reconcile(stream, f"{tmp_path}/out", f"{tmp_path}/c")
    got = {r["id"]: r["delivery"] for r in T.deliveries(spark, f"{tmp_path}/out").collect()}
    assert got == {0: "unrecoverable", 1: "unrecoverable", 2: "unrecoverable", 3: "unrecoverable", 4: "pending"}
