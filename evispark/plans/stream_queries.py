"""Streaming and file operators as queries: streams run over the given tables until they are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import ingest as I
from ..sources import files as S
from ..sources.shared import shared_folder as shared
from ..streaming import streams as X
from .frames import table
from .run_queries import CELLS, RATES, cells


def log(spark, d):
    """The event table as a stream of audit rows."""
    t = table(spark, d, "events")
    s = X.tail(spark, f"{d}/events.parquet*", t.schema)
    return s.where("event_id % 19 <> 3").select(F.floor(F.col("event_id") / 20).alias("run_id"), "event_id", "ts", F.floor(F.col("event_id") / 2).alias("op"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("phase"), F.col("event_type").alias("kind"))


def drain(spark, stream, mode="append"):
    f = shared(spark)
    return X.drained(stream, mode, f"{f}/checkpoint", f"{f}/out")


def r1(spark, d):
    t = table(spark, d, "documents")
    s = spark.readStream.schema(t.schema).parquet(f"{d}/documents.parquet*")
    f = shared(spark)
    X.ingest(s, f"{f}/lake", f"{f}/checkpoint", lambda b: {"spans": I.line_spans(b).select("doc_id", "source", "line_no", "text", "section")})
    return S.published(spark, f"{f}/lake", "spans", every=True).groupBy("source").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


def r2(spark, d):
    return drain(spark, X.tail(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, after=5000).select("event_id", "event_type"))


def r3(spark, d):
    s = X.tail(spark, f"{d}/events.parquet*", table(spark, d, "events").schema).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    x = X.first_write_wins(s, ["user_id", "event_type"], "ts", "100 days")
    return drain(spark, x.select("user_id", "event_type"))


def r4(spark, d):
    return drain(spark, X.paired_operations(log(spark, d).select("run_id", "event_id", "op", "phase")))


def r3_conflicts(spark, d):
    s = X.tail(spark, f"{d}/events.parquet*", table(spark, d, "events").schema)
    return drain(spark, X.request_outcomes(s, ["user_id", "event_type"], ["props"]))


def r4_inventory(spark, d):
    s = log(spark, d).withColumn("phase", F.when(F.col("phase") == "start", "start").when(F.col("kind") == "error", "failed").otherwise("end"))
    return X.operation_inventory(drain(spark, X.operation_changes(s.select("run_id", "event_id", "op", "phase"))))


def s8(spark, d):
    f = shared(spark)
    spans = I.line_spans(table(spark, d, "documents"))
    S.publish({"spans": spans, "sources": table(spark, d, "documents").select("doc_id", "source")}, f)
    return S.published(spark, f, "spans").groupBy("source").agg(F.count("*").alias("n"))


def s9(spark, d):
    f = shared(spark)
    S.write_report(V.core_rates(cells(spark, d), ["variant", "generator"]), f)
    schema = "variant string, generator string, planned long, completed long, assessable long, successes long, completion double, success_rate double, conditional_success double"
    return spark.read.schema(schema).option("header", True).csv(f"{f}/csv")


def s3(spark, d):
    """Originals written one file a document, then scanned as bytes; a document without a text counts, but has no original."""
    f, docs = shared(spark), table(spark, d, "documents")
    folders = S.write_originals(docs, f"{f}/files")
    without = docs.where("text IS NULL").agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("n_bytes"))
    accepted = lambda x: x.where("reason IS NULL").agg(F.count("*").alias("n"), F.sum("size").alias("n_bytes"))
    return S.scan_folders(spark, folders, f"{f}/scanned", accepted).unionByName(without).agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"))


from .evidence_queries import SPANS  # noqa: E402

QUERIES = {
    "r1_continuous_ingest": (r1, f"WITH {SPANS} SELECT source, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY source"),
    "r2_event_tail": (r2, "SELECT event_id, event_type FROM events WHERE event_id > 5000"),
    "r3_first_write_wins": (r3, "SELECT DISTINCT user_id, event_type FROM events"),
    "r3_request_conflicts": (r3_conflicts, """SELECT user_id, event_type, event_id, CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN props IS NOT DISTINCT FROM first_value(props) OVER w THEN 'repeated' ELSE 'conflict' END AS outcome
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)"""),
    "r4_pair_stream": (r4, """WITH l AS (SELECT event_id // 20 AS run_id, event_id // 2 AS op, event_id, event_id % 2 = 0 AS starts FROM events WHERE event_id % 19 <> 3),
x AS (SELECT *, lag(starts) OVER w AS p, lag(op) OVER w AS o FROM l WINDOW w AS (PARTITION BY run_id ORDER BY event_id)),
b AS (SELECT *, bool_or(CASE WHEN starts THEN coalesce(p, false) ELSE NOT coalesce(p AND o = op, false) END) OVER (PARTITION BY run_id ORDER BY event_id) AS poisoned FROM x)
SELECT run_id, op, CASE WHEN poisoned THEN 'poisoned' ELSE 'completed' END AS outcome FROM b WHERE poisoned OR NOT starts"""),
    "r4_operation_inventory": (r4_inventory, """WITH l AS (SELECT event_id // 20 AS run_id, event_id // 2 AS op, event_id, event_id % 2 = 0 AS starts, event_type = 'error' AS fails FROM events WHERE event_id % 19 <> 3),
x AS (SELECT *, lag(starts) OVER w AS p, lag(op) OVER w AS o FROM l WINDOW w AS (PARTITION BY run_id ORDER BY event_id)),
b AS (SELECT *, bool_or(CASE WHEN starts THEN coalesce(p, false) ELSE NOT coalesce(p AND o = op, false) END) OVER (PARTITION BY run_id ORDER BY event_id) AS poisoned FROM x)
SELECT run_id, op, CASE WHEN poisoned THEN 'poisoned' WHEN starts THEN 'unknown' WHEN fails THEN 'failed' ELSE 'completed' END AS outcome
FROM b QUALIFY row_number() OVER (PARTITION BY run_id, op ORDER BY event_id DESC) = 1"""),
    "s3_scan_originals": (s3, "SELECT count(*) AS n, sum(strlen(text) + 1)::BIGINT AS n_bytes FROM documents"),
    "s8_publish": (s8, f"WITH {SPANS} SELECT source, count(*) AS n FROM spans GROUP BY source"),
    "s9_report": (s9, CELLS + f" SELECT variant, generator, {RATES} FROM rows1 GROUP BY 1, 2"),
}
