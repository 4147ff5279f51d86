"""Run, audit and message analytics: paging, pairing, sequences, state, due times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written



def collection_counters(sources: DataFrame) -> DataFrame:
    live = sources.where(~F.col("deleted"))
    return live.groupBy("collection_id").agg(F.count("*").alias("source_count"), F.count_if(F.col("status") == "ready").alias("ready_count"), F.count_if(F.col("status") != "ready").alias("unavailable_count"))


def status_counts(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """A count for every known name, zero-filled, and for unknown names as they come; null is ``missing``."""
    spark = rows.sparkSession
    seen = rows.groupBy(F.coalesce(column, F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(k,) for k in known], "status string")
    return names.join(seen, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(by).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.9).alias("p90"), F.count(value).alias("n"))


def event_seq(events: DataFrame, run: str = "run_id") -> DataFrame:
    return events.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy("at", "event_id")))


def keyset_page(rows: DataFrame, order: list[str], after: tuple | None, n: int, newest_first: bool = True) -> DataFrame:
    """``n`` + 1 rows beyond an exclusive cursor; the last is the sentinel that says there is more."""
    key = F.struct(*order)
    if after is not None:
        cursor = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for v, c in zip(after, order)])
        rows = rows.where(key < cursor if newest_first else key > cursor)
    return rows.orderBy(*[F.col(c).desc() if newest_first else F.col(c).asc() for c in order]).limit(n + 1)


def prior_messages(messages: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """The newest k messages strictly before an anchor (conv_id, turn), oldest first, and whether older ones exist."""
    a = anchors.select("conv_id", F.col("turn").alias("anchor"))
    x = messages.join(a, "conv_id").where(F.col("turn") < F.col("anchor"))
    w = W.partitionBy("conv_id", "anchor")
    x = x.withColumn("back", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("older_exists", F.count("*").over(w) > k)
    return x.where(F.col("back") <= k).withColumn("place", F.least(F.lit(k), F.count("*").over(w)) - F.col("back") + 1).drop("back")


def bounded_history(messages: DataFrame, k: int = 4, budget: int = 2000) -> DataFrame:
    """Last k messages of a conversation, each cut to a quarter of the budget, newest first until the total is full, shown in order."""
    from ..functions.text import byte_prefix

    each = budget // 4
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    x = messages.withColumn("back", F.row_number().over(w)).withColumn("total", F.count("*").over(W.partitionBy("conv_id")))
    x = x.where(F.col("back") <= k).withColumn("cut", byte_prefix(F.col("text"), each)).withColumn("n", F.octet_length("cut").cast("long"))
    x = x.withColumn("used", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))).where(F.col("used") <= budget)
    return x.select("conv_id", "turn", "role", F.col("n").alias("n_bytes"), (F.col("n") < F.octet_length("text")).alias("truncated"), (F.col("total") > k).alias("omitted"))


def retry_root(runs: DataFrame, parent: str = "retry_of", conversation: str | None = None) -> DataFrame:
    """id, root, hops, valid: pointer doubling until every run has its first ancestor, whatever the depth.

    A missing ancestor, one of another conversation, or a cycle is invalid (hops double each round, so a run that still moves
    when they exceed the number of runs is in a cycle). Each round is one join of a written table with itself.
    """
    p = runs.select(F.col("id").alias("_id"), (F.col(conversation) if conversation else F.lit(0)).alias("_conv"))
    same = F.col("_conv").eqNullSafe(F.col(conversation)) if conversation else F.lit(True)
    start, known = F.col(parent).isNull(), F.col("_id").isNotNull() & same
    cur = runs.join(p, F.col(parent) == F.col("_id"), "left")
    cur = cur.select("id", F.when(start, F.col("id")).when(known, F.col(parent)).alias("up"), F.when(start, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("hops"), (start | ~known).alias("over"))
    cur, n, reach = written(cur), runs.count(), 1
    while reach <= 2 * n and cur.where("NOT over").head(1):
        far = cur.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("h2"), F.col("over").alias("o2"))
        moved = cur.where("NOT over").join(far, "up").select("id", F.col("up2").alias("up"), (F.col("hops") + F.col("h2")).alias("hops"), F.col("o2").alias("over"))
        cur, reach = written(cur.where("over").unionByName(moved)), reach * 2
    valid = F.col("over") & F.col("up").isNotNull()
    return cur.select("id", F.when(valid, F.col("up")).alias("root"), F.when(valid, F.col("hops")).alias("hops"), valid.alias("valid"))


def pair_operations(audit: DataFrame) -> DataFrame:
    """run_id, op, n_start, n_end, outcome: started operations joined to their ends; orphans and duplicates are violations."""
    s = audit.where("phase = 'start'").groupBy("run_id", "op").agg(F.count("*").alias("n_start"), F.min("at").alias("started"))
    e = audit.where("phase = 'end'").groupBy("run_id", "op").agg(F.count("*").alias("n_end"), F.max("at").alias("ended"))
    j = s.join(e, ["run_id", "op"], "full_outer").na.fill(0, ["n_start", "n_end"])
    outcome = F.when(F.col("n_start") == 0, "orphan_end").when(F.col("n_start") > 1, "duplicate_start").when(F.col("n_end") > 1, "duplicate_end").when(F.col("n_end") == 0, "open").otherwise("completed")
    return j.withColumn("outcome", outcome).select("run_id", "op", "n_start", "n_end", "outcome")


def serial_ok(audit: DataFrame) -> DataFrame:
    """run_id, ok: no start while another operation is open, no end but of the open one."""
    w = W.partitionBy("run_id").orderBy("at", "event_id")
    x = audit.withColumn("p", F.lag("phase").over(w)).withColumn("o", F.lag("op").over(w))
    good = F.when(F.col("phase") == "start", F.col("p").isNull() | (F.col("p") == "end")).otherwise(F.coalesce((F.col("p") == "start") & (F.col("o") == F.col("op")), F.lit(False)))
    return x.groupBy("run_id").agg(F.bool_and(good).alias("ok"), F.count("*").alias("n"))


def ordinal_ok(audit: DataFrame) -> DataFrame:
    """run_id, kind, ok: declared ordinals are 1, 2, … in order of time."""
    w = W.partitionBy("run_id", "kind").orderBy("at", "event_id")
    return audit.withColumn("n", F.row_number().over(w)).groupBy("run_id", "kind").agg(F.bool_and(F.col("declared") == F.col("n")).alias("ok"))


def readback_issues(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """op, issues: labels of what is wrong with each expected operation as observed."""
    o = observed.groupBy("op").agg(F.count("*").alias("seen"), F.min("run_id").alias("o_run"), F.min("at").alias("o_at"))
    j = expected.join(o, "op", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("seen").isNull(), F.lit("missing")), F.when(F.col("seen") > 1, F.lit("repeated")),
        F.when(F.col("o_run") != F.col("run_id"), F.lit("wrong_parent")), F.when(F.col("o_at") < F.col("at"), F.lit("early")),
    ))
    return j.select("op", F.array_join(issues, ",").alias("issues"))


def due_runs(runs: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Undelivered runs: scheduled ones whose time has come, and finished ones 5 s old that were never tried."""
    pending = runs.where("delivered = false")
    tried = pending.where(F.col("next_due").isNotNull() & (F.col("next_due") <= as_of)).select("id", F.col("next_due").alias("due"), F.lit("scheduled").alias("branch"))
    fresh = pending.where(F.col("next_due").isNull() & (F.col("finished_at") + F.expr("INTERVAL 5 SECONDS") <= as_of)).select("id", (F.col("finished_at") + F.expr("INTERVAL 5 SECONDS")).alias("due"), F.lit("first").alias("branch"))
    return tried.unionAll(fresh).orderBy("due", "id").limit(n)


def backoff(base: float, n: Column, cap: float) -> Column:
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), n))


def first_terminal(events: DataFrame, terminal: list[str]) -> DataFrame:
    """run_id, state, at: the first terminal event is absorbing; runs without one are running."""
    t = F.col("kind").isin(*terminal)
    key = F.when(t, F.struct("at", "event_id"))
    g = events.groupBy("run_id").agg(F.min_by(F.when(t, F.col("kind")), key).alias("state"), F.min(F.when(t, F.col("at"))).alias("at"), F.count_if(t).alias("n"))
    return g.select("run_id", F.coalesce("state", F.lit("running")).alias("state"), F.greatest(F.col("n") - 1, F.lit(0)).alias("ignored"))


def run_lifecycle(runs: DataFrame, events: DataFrame, terminal: list[str], success: list[str]) -> DataFrame:
    """id, state, ignored: queued without events, running until the first terminal one, which is absorbing.

    A success of a run that isn't ``fresh`` (its scope has changed; null counts as changed) is scope_expired.
    """
    j = runs.select("id", "fresh").join(first_terminal(events, terminal).withColumnRenamed("run_id", "id"), "id", "left")
    expired = F.col("state").isin(*success) & ~F.coalesce("fresh", F.lit(False))
    return j.select("id", F.when(expired, "scope_expired").otherwise(F.coalesce("state", F.lit("queued"))).alias("state"), F.coalesce("ignored", F.lit(0)).alias("ignored"))


def stale_work(items: DataFrame, as_of: Column) -> DataFrame:
    """The newest attempt of each item, if its lease has passed."""
    newest = items.groupBy("item").agg(F.max(F.struct("attempt", "lease_until")).alias("m")).select("item", "m.attempt", "m.lease_until")
    return newest.where(F.col("lease_until") <= as_of)


def change_log(changes: DataFrame) -> DataFrame:
    """Adds revision and live_count: running totals of a collection's changes."""
    w = W.partitionBy("collection_id").orderBy("at", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return changes.withColumn("revision", F.count("*").over(w)).withColumn("live_count", F.sum("delta").over(w))


def delivery_status(runs: DataFrame, issues: DataFrame, as_of: Column) -> DataFrame:
    """id, delivery: pending within 45 s, then by what was read back; unrecoverable after 60 s without anything."""
    j = runs.join(issues, "id", "left")
    age = F.unix_timestamp(as_of) - F.unix_timestamp("finished_at")
    status = F.when(F.col("missing") == 0, F.when(F.col("from_audit"), "recovered_from_audit").otherwise("original_materialized")).when(age < 45, "pending").when(F.col("seen") > 0, "incomplete").when(age < 60, "pending").otherwise("unrecoverable")
    return j.select("id", status.alias("delivery"))
