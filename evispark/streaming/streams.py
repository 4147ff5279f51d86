"""Structured Streaming forms of the run-log operators. Bounded runs use ``availableNow`` triggers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import digest

TERMINAL = ("completed", "failed", "error", "purchase")
SUCCESS = ("completed", "purchase")


def tail(spark: SparkSession, path: str, schema: StructType, after: int | None = None, seq: str = "event_id", per_trigger: int = 1) -> DataFrame:
    """The event log as a stream, from a cursor on."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return s if after is None else s.where(F.col(seq) > after)


def replay(log: DataFrame, after: int, seq: str = "event_id") -> DataFrame:
    """The same tail over a finished log, in order."""
    return log.where(F.col(seq) > after).orderBy(seq)


def first_write_wins(stream: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Idempotent creation: within the watermark a key is taken once."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def request_outcomes(stream: DataFrame, key: list[str], content: list[str], seq: str = "event_id", parts: int = 1_024) -> DataFrame:
    """key, seq, outcome: ``created`` for the first request of a key, ``repeated`` for one of the same content, else ``conflict``.

    State is the first request's digest of each key. Requests of one batch count in the order of ``seq``. Keys are dealt over ``parts``
    groups, each of which takes its keys' requests at once: a batch calls Python so often at most, however many keys it has.
    """
    name = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    x = stream.select(*key, seq, name.alias("request"), digest(*[F.col(c) for c in content]).alias("content"))
    x = x.withColumn("part", F.pmod(F.xxhash64("request"), F.lit(parts)))
    shown = [*key, seq]

    def step(_, frames, state):
        rows = pd.concat(list(frames)).sort_values(seq, kind="stable")
        first = dict(zip(*state.get)) if state.exists else {}
        created = (~rows.request.duplicated() & ~rows.request.isin(first.keys())).to_numpy()
        first.update(zip(rows.request[created], rows.content[created]))
        if created.any():
            state.update((list(first), list(first.values())))
        outcome = np.where(rows.content == rows.request.map(first), "repeated", "conflict")
        yield rows[shown].assign(outcome=np.where(created, "created", outcome))

    fields = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in shown)
    return x.groupBy("part").applyInPandasWithState(step, f"{fields}, outcome string", "requests array<string>, contents array<string>", "append", GroupStateTimeout.NoTimeout)


def ingest(stream: DataFrame, out: str, checkpoint: str, build) -> None:
    """Continuous ingestion: each batch is built (documents -> tables) and published as a version named by its batch, so that a replay rewrites it."""
    from ..sources.files import publish

    def one(batch: DataFrame, number: int) -> None:
        publish(build(batch), out, version=f"batch-{number:010d}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pair_step(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
    """(open op, poisoned) and the outcomes of further (op, phase) rows of one run: one operation may be open at a time."""
    open_op, poisoned = state or (None, False)
    out = []
    for op, phase in rows:
        if poisoned:
            out.append((op, "poisoned"))
        elif phase == "start":
            if open_op is None:
                open_op = op
            else:
                poisoned = True
                out.append((op, "poisoned"))
        elif open_op == op:
            out.append((op, "completed"))
            open_op = None
        else:
            poisoned = True
            out.append((op, "poisoned"))
    return (open_op, poisoned), out


def paired_operations(stream: DataFrame) -> DataFrame:
    """run_id, op, outcome: start and end events paired per run with the open operation as state."""

    def step(key, frames, state):
        old = state.get if state.exists else (None, False)
        rows = pd.concat(list(frames)).sort_values("event_id")
        new, out = pair_step((old[0], bool(old[1])), list(zip(rows.op.astype(int), rows.phase)))
        state.update(new)
        yield pd.DataFrame([(key[0], op, o) for op, o in out], columns=["run_id", "op", "outcome"])

    return stream.groupBy("run_id").applyInPandasWithState(step, "run_id long, op long, outcome string", "open_op long, poisoned boolean", "append", GroupStateTimeout.NoTimeout)


def inventory_step(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[str]]:
    """(open op, poisoned, ops seen) and the outcome that each further (op, phase) row of a run gives its operation."""
    open_op, poisoned, seen = state or (None, False, [])
    seen, out = set(seen), []
    for op, phase in rows:
        poisoned = poisoned or ((open_op is not None or op in seen) if phase == "start" else open_op is None or open_op != op)
        if poisoned:
            out.append("poisoned")
        elif phase == "start":
            open_op = op
            seen.add(op)
            out.append("unknown")
        else:
            open_op = None
            out.append("failed" if phase == "failed" else "completed")
    return (open_op, poisoned, sorted(seen)), out


def operation_changes(stream: DataFrame) -> DataFrame:
    """run_id, op, event_id, outcome: what each start, end or failed event makes of its operation, the open operation being state.

    A start makes it ``unknown``, its end ``completed`` or ``failed``. A start while another is open, one of an op seen before, or an
    end that isn't the open operation's poisons the run from there on.
    """

    def step(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("event_id")
        new, out = inventory_step(state.get if state.exists else None, list(zip(rows.op.astype(int), rows.phase)))
        state.update(new)
        yield pd.DataFrame({"run_id": key[0], "op": rows.op, "event_id": rows.event_id, "outcome": out})

    return stream.groupBy("run_id").applyInPandasWithState(step, "run_id long, op long, event_id long, outcome string", "open_op long, poisoned boolean, seen array<long>", "append", GroupStateTimeout.NoTimeout)


def operation_inventory(changes: DataFrame) -> DataFrame:
    """run_id, op, outcome: the last change of each operation (``unknown``: still open), of the changes read so far."""
    return changes.groupBy("run_id", "op").agg(F.max_by("outcome", "event_id").alias("outcome"))


class RunState(StatefulProcessor):
    """Run state machine (for ``transformWithStateInPandas``): queued until an event of another kind, then running.

    The first terminal event is absorbing and later ones are counted as ignored. Where events have a column ``fresh``, a success
    that isn't (the scope has changed) becomes scope_expired.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "kind string, ignored long")

    def handleInputRows(self, key, rows, timerValues):
        kind, ignored = self.state.get() if self.state.exists() else ("queued", 0)
        for p in rows:
            p = p.sort_values("event_id")
            for k, fresh in zip(p.kind, p.fresh if "fresh" in p else [True] * len(p)):
                if k in TERMINAL:
                    if kind in ("queued", "running"):
                        kind = "scope_expired" if k in SUCCESS and not fresh else k
                    else:
                        ignored += 1
                elif kind == "queued" and k != "queued":
                    kind = "running"
        self.state.update((kind, ignored))
        yield pd.DataFrame([(key[0], kind, ignored)], columns=["run_id", "state", "ignored"])

    def close(self) -> None:
        pass


def run_states(stream: DataFrame) -> DataFrame:
    return stream.groupBy("run_id").transformWithStateInPandas(RunState(), "run_id long, state string, ignored long", "Update", "None")


def collection_revisions(stream: DataFrame) -> DataFrame:
    """Revision and counters of each collection from its change log, updated as changes come."""
    return stream.groupBy("collection_id").agg(F.count("*").alias("revision"), F.sum("delta").alias("live_count"))


def windowed(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark, an extension."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str, checkpoint: str, out: str) -> DataFrame:
    """Runs a stream over all that is available now into a Parquet folder, and reads it."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
