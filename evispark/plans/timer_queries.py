"""Queries on streams with timers and state, drained over the given tables, with DuckDB SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import streams as X
from ..streaming import timers as T
from .frames import table, with_frames
from .run_queries import runs
from .stream_queries import drain, log

PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


@contextmanager
def rocksdb(spark, partitions=None):
    """State with timers and lists needs the RocksDB store; ``partitions``: of the state, where keys are few. The session's own choices
    are put back."""
    before = {c: spark.conf.get(c) for c in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if partitions:
        spark.conf.set(PARTITIONS, str(partitions))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def r5_stream(spark, d):
    """The run state machine as a stream: each batch's updates are written, a run's last one counts."""
    out = shared_folder(spark)
    stream = X.run_states(log(spark, d).select("run_id", "event_id", "kind"))
    write = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/updates/batch={n}")
    with rocksdb(spark):
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema("run_id long, state string, ignored long, batch long").parquet(f"{out}/updates")
    return last.groupBy("run_id").agg(F.max_by(F.struct("state", "ignored"), "batch").alias("s")).select("run_id", "s.state", "s.ignored")


def slices(spark, events, out, rows):
    """Folders of the events in order of time, of about ``rows`` events each; events of one time stay together."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    n = -(-events.count() // rows)
    cuts = events.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts))
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= at)) if cuts else F.lit(0)
    events.withColumn("slice", number).repartition(max(n, 1) * 4, "slice", F.col("event_id") % 4).write.partitionBy("slice").parquet(out)
    return [f"{out}/slice={i}" for i in range(len(cuts) + 1)] if n else []


def r6_stream(spark, d, rows=1_000_000):
    """Events as lease events: seven items, a new attempt every 70 events; clicks claim, purchases are results, others renew.

    The table may lie in any order, and what comes more than ten minutes late is lost to a stream: events are dealt into slices by
    time, each is added to the log when the stream has drained the ones before it, and the stream goes on from its checkpoint.
    """
    f = shared_folder(spark)
    events = table(spark, d, "events")
    s = X.tail(spark, f"{f}/log*", events.schema, per_trigger=1000)
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "result").otherwise("renew")
    x = s.select((F.col("event_id") % 7).alias("item"), F.floor(F.col("event_id") / 70).alias("attempt"), "event_id", kind.alias("kind"), F.col("ts").alias("at"), (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("lease_until"))
    with rocksdb(spark, 8):
        for part in slices(spark, events, f"{f}/slices", rows) or [None]:
            (spark.read.schema(events.schema).parquet(part) if part else events).coalesce(8).write.mode("append").parquet(f"{f}/log")
            found = X.drained(T.lease_outcomes(x), "append", f"{f}/checkpoint", f"{f}/out")
        return found.select("item", "attempt", "event_id", "outcome")


R6_SQL = """WITH RECURSIVE e AS (SELECT event_id % 7 AS item, event_id // 70 AS attempt, event_id, CASE WHEN event_type = 'click' THEN 'claim' WHEN event_type = 'purchase' THEN 'result' ELSE 'renew' END AS kind,
epoch_ms(ts) AS t, epoch_ms(ts) + 900000 AS lease, row_number() OVER (PARTITION BY event_id % 7 ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT item, 0::BIGINT AS i, NULL::BIGINT AS cur, NULL::BIGINT AS until, -1::BIGINT AS newest, NULL::BIGINT AS event_id, NULL::BIGINT AS attempt, NULL::VARCHAR AS outcome, NULL::BIGINT AS stale FROM (SELECT DISTINCT item FROM e)
UNION ALL SELECT item, i, CASE WHEN kind = 'claim' AND attempt > newest THEN attempt WHEN kind = 'result' AND attempt = held THEN NULL ELSE held END,
CASE WHEN (kind = 'claim' AND attempt > newest) OR (kind = 'renew' AND attempt = held) THEN lease ELSE until END, CASE WHEN kind = 'claim' THEN greatest(newest, attempt) ELSE newest END, event_id, attempt,
CASE WHEN kind = 'claim' AND attempt > newest THEN NULL WHEN kind = 'renew' AND attempt = held THEN NULL WHEN kind = 'result' AND attempt = held THEN 'done' ELSE 'superseded' END, CASE WHEN cur IS NOT NULL AND held IS NULL THEN cur END
FROM (SELECT e.*, s.cur, s.until, s.newest, CASE WHEN s.until <= e.t THEN NULL ELSE s.cur END AS held FROM s JOIN e ON e.item = s.item AND e.i = s.i + 1))
SELECT item, attempt, event_id, outcome FROM s WHERE outcome IS NOT NULL UNION ALL SELECT item, stale, NULL, 'stale' FROM s WHERE stale IS NOT NULL
UNION ALL SELECT item, cur, NULL, 'stale' FROM s WHERE cur IS NOT NULL AND i = (SELECT max(i) FROM e WHERE e.item = s.item) AND until <= (SELECT max(t) - 600000 FROM e)"""


def facts(spark, d):
    """What becomes known of runs: that they have finished, and (of four in five) an inventory up to 89 s later."""
    r = runs(spark, d).select("id", F.col("finished_at").cast("timestamp").alias("finished_at"))
    none = F.lit(None).cast("long")
    done = r.select(F.col("id").alias("seq"), F.col("finished_at").alias("at"), F.lit("finished").alias("kind"), "id", (F.col("id") % 7 == 0).alias("from_audit"), none.alias("missing"), none.alias("seen"))
    later = F.col("finished_at") + F.make_dt_interval(secs=F.col("id") % 90)
    inventory = r.where("id % 5 <> 0").select(F.col("id").alias("seq"), later.alias("at"), F.lit("inventory").alias("kind"), "id", F.lit(None).cast("boolean").alias("from_audit"), (F.col("id") % 3).alias("missing"), (F.col("id") % 4).alias("seen"))
    return done.unionByName(inventory)


def r7_stream(spark, d):
    """Delivery reconciliation of a stream of facts; the clock is the latest fact."""
    f = shared_folder(spark)
    facts(spark, d).write.parquet(f"{f}/facts")
    schema = spark.read.parquet(f"{f}/facts").schema
    T.reconcile(X.tail(spark, f"{f}/facts", schema, per_trigger=100_000), f"{f}/out", f"{f}/checkpoint")
    return T.deliveries(spark, f"{f}/out")


QUERIES = {
    "r5_state_stream": (r5_stream, """SELECT event_id // 20 AS run_id, coalesce(min_by(event_type, event_id) FILTER (event_type IN ('completed', 'failed', 'error', 'purchase')), 'running') AS state,
greatest(count(*) FILTER (event_type IN ('completed', 'failed', 'error', 'purchase')) - 1, 0) AS ignored FROM events WHERE event_id % 19 <> 3 GROUP BY 1"""),
    "r6_lease_stream": (r6_stream, R6_SQL),
    "r7_reconcile_stream": (r7_stream, with_frames("runs", body="""SELECT id, CASE WHEN m = 0 THEN CASE WHEN id % 7 = 0 THEN 'recovered_from_audit' ELSE 'original_materialized' END WHEN age < 45 THEN 'pending' WHEN s > 0 THEN 'incomplete' WHEN age < 60 THEN 'pending' ELSE 'unrecoverable' END AS delivery
FROM (SELECT id, CASE WHEN id % 5 <> 0 THEN id % 3 END AS m, CASE WHEN id % 5 <> 0 THEN id % 4 END AS s, floor(epoch(max(finished_at + to_seconds(CASE WHEN id % 5 <> 0 THEN id % 90 ELSE 0 END)) OVER ())) - floor(epoch(finished_at)) AS age FROM runs)""")),
}
