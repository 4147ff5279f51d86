"""Streams that wait: leases that run out, and deliveries that are given time before they are judged."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import delivery_status

LEASE_COLUMNS = "item long, attempt long, event_id long, outcome string, at timestamp"


class Leases(StatefulProcessor):
    """Work items under lease. State of an item: its attempt and when the lease passes; a timer stands at that time.

    ``claim`` makes an attempt current (an older one than the current is ignored as ``superseded``), ``renew`` moves the current
    attempt's lease on, ``result`` ends it (``done``). Results and renewals of other attempts are ``superseded`` and dropped. A
    lease that passes is ``stale``, at its end: noticed by the timer, or by a later event of the item that comes first. What is stale
    isn't current any more, so its late results are superseded, too.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "attempt long, until long, newest long")

    def _until(self, ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ms is not None:
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues):
        attempt, until, newest = self.state.get() if self.state.exists() else (None, None, -1)
        out = []
        # an item's rows come in several frames, in any order; what a batch holds of it is bounded by the batch
        p = pd.concat(list(rows)).sort_values(["at", "event_id"])
        for at, event_id, kind, n, lease in zip(p["at"], p["event_id"], p["kind"], p["attempt"], p["lease_until"]):
            if attempt is not None and until <= at.value // 1_000_000:
                out.append((key[0], attempt, None, "stale", pd.Timestamp(until, unit="ms")))
                attempt = None
            if kind == "claim" and n > newest:
                attempt, newest, until = int(n), int(n), lease.value // 1_000_000
            elif kind == "renew" and n == attempt:
                until = lease.value // 1_000_000
            elif kind == "result" and n == attempt:
                attempt = None
                out.append((key[0], int(n), int(event_id), "done", at))
            else:
                out.append((key[0], int(n), int(event_id), "superseded", at))
        self.state.update((attempt, until if attempt is not None else None, newest))
        self._until(until if attempt is not None else None)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        attempt, until, newest = self.state.get()
        out = []
        if attempt is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], attempt, None, "stale", pd.Timestamp(until, unit="ms")))
            self.state.update((None, None, newest))
        yield self._frame(out)

    @staticmethod
    def _frame(rows):
        p = pd.DataFrame(rows, columns=["item", "attempt", "event_id", "outcome", "at"])
        return p.astype({"item": "int64", "attempt": "int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


def lease_outcomes(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """item, attempt, event_id, outcome (done, superseded, stale), at, of lease events (item, attempt, event_id, kind, at, lease_until).

    Event time, with a watermark: a lease is stale once no event before its end can come any more. Needs the RocksDB state store.
    """
    x = stream.select("item", "attempt", "event_id", "kind", F.col("at").cast("timestamp").alias("at"), F.col("lease_until").cast("timestamp").alias("lease_until"))
    return x.withWatermark("at", late).groupBy("item").transformWithStateInPandas(Leases(), LEASE_COLUMNS, "Append", "EventTime")


OPEN = "id long, finished_at timestamp, from_audit boolean, missing long, seen long"
FINAL = ("original_materialized", "recovered_from_audit", "unrecoverable")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def reconcile_batch(batch: DataFrame, number: int, out: str) -> None:
    """One micro-batch of facts into the deliveries kept in ``out``; a replayed batch writes the same folders again.

    Facts: (seq, at, kind, id, from_audit, missing, seen), kind ``finished``, ``inventory`` (the newest counts) or ``tick``. The clock is
    the latest ``at`` seen. Runs that are still pending or incomplete make the state of the next batch (``open``), the others have
    their last status (``final``), which later facts don't change.
    """
    spark = batch.sparkSession
    batch = batch.persist()
    before = _read(spark, f"{out}/open/batch={number - 1}", OPEN)
    clocks = batch.agg(F.max("at").alias("clock")).union(_read(spark, f"{out}/clock/batch={number - 1}", "clock timestamp"))
    clock = clocks.agg(F.max("clock")).first()[0]
    done = _read(spark, f"{out}/final", "id long, delivery string, batch long").where(F.col("batch") < number).select("id")
    facts = batch.where("id IS NOT NULL").join(done, "id", "left_anti").groupBy("id").agg(
        F.min(F.when(F.col("kind") == "finished", F.col("at"))).alias("f_at"), F.max(F.when(F.col("kind") == "finished", F.col("from_audit"))).alias("f_audit"),
        F.max(F.when(F.col("kind") == "inventory", F.struct("seq", "missing", "seen"))).alias("inv"),
    )
    j = before.join(facts, "id", "full_outer")
    known = j.select(
        "id", F.coalesce("finished_at", "f_at").alias("finished_at"), F.coalesce("from_audit", "f_audit").alias("from_audit"),
        F.coalesce("inv.missing", "missing").alias("missing"), F.coalesce("inv.seen", "seen").alias("seen"),
    )
    ended = known.where("finished_at IS NOT NULL")
    status = delivery_status(ended.select("id", "finished_at", "from_audit"), ended.where("missing IS NOT NULL").select("id", "missing", "seen"), F.lit(clock).cast("timestamp"))
    judged = known.join(status.select("id", "delivery"), "id", "left").persist()
    last = F.coalesce(F.col("delivery").isin(*FINAL), F.lit(False))
    judged.where(last).select("id", "delivery").write.mode("overwrite").parquet(f"{out}/final/batch={number}")
    judged.where(~last).select(*[x.split()[0] for x in OPEN.split(", ")]).write.mode("overwrite").parquet(f"{out}/open/batch={number}")
    spark.createDataFrame([(clock,)], "clock timestamp").write.mode("overwrite").parquet(f"{out}/clock/batch={number}")
    judged.unpersist()
    batch.unpersist()


def reconcile(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Delivery reconciliation as a stream: every micro-batch of facts is merged into the deliveries in ``out``."""
    stream.writeStream.foreachBatch(lambda b, n: reconcile_batch(b, n, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deliveries(spark: SparkSession, out: str) -> DataFrame:
    """id, delivery of all runs that have finished, after the latest batch."""
    final = _read(spark, f"{out}/final", "id long, delivery string, batch long").select("id", "delivery")
    clock = _read(spark, f"{out}/clock", "clock timestamp, batch long").agg(F.max_by("clock", "batch").alias("clock"), F.max("batch").alias("batch")).first()
    if clock["batch"] is None:
        return final
    left = _read(spark, f"{out}/open/batch={clock['batch']}", OPEN).where("finished_at IS NOT NULL")
    status = delivery_status(left.select("id", "finished_at", "from_audit"), left.where("missing IS NOT NULL").select("id", "missing", "seen"), F.lit(clock["clock"]).cast("timestamp"))
    return final.unionByName(status.select("id", "delivery"))
