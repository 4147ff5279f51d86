"""Queries on versioned tables: deletes that rewrite a version, registration against what exists, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..sources.versions import Store, delete_sources, register
from .evidence_queries import SPANS, spans
from .frames import frame, with_frames


def s12_rewrite(spark, d):
    """Spans of all sources are published, then those of deleted sources go: both versions' counts, and the counters moved by deltas."""
    store = Store(spark, shared_folder(spark))
    src = frame(spark, d, "sources").select("id", "collection_id", "status", "deleted")
    counters = src.groupBy("collection_id").agg(F.lit(0).cast("long").alias("revision"), F.count("*").alias("source_count"), F.count_if(F.col("status") == "ready").alias("ready_count"), F.count_if(F.col("status") != "ready").alias("unavailable_count"))
    s = spans(spark, d).select(F.col("doc_id").alias("id"), F.col("source").alias("collection_id"), "line_no", "text")
    first = store.create({"sources": (src.drop("deleted"), ["id"]), "spans": (s, ["id"]), "counters": (counters, ["collection_id"])}, buckets=32)
    last = delete_sources(store, src.where("deleted").select("id"), ["spans"])
    n = lambda v: store.read("spans", v).groupBy("collection_id").agg(F.count("*").alias(f"n{v}"), F.countDistinct("id").alias(f"docs{v}"))
    return n(first).join(n(last), "collection_id", "left").join(store.read("counters"), "collection_id").select(
        "collection_id", F.col("n0").alias("n_before"), F.coalesce("n1", F.lit(0)).alias("n"), F.coalesce("docs1", F.lit(0)).alias("n_docs"), "revision", "source_count", "ready_count", "unavailable_count"
    )


def s5_merge(spark, d):
    """Sources registered in three batches of rising ids, the second one twice: the outcomes of each batch and what the table then holds."""
    store = Store(spark, shared_folder(spark))
    src = frame(spark, d, "sources").select("id", "collection_id", "request_id", "byte_count", "lang")
    key, facts = ["collection_id", "request_id"], ["byte_count", "lang"]
    store.create({"sources": (src.limit(0), key), "conflicts": (src.limit(0), key)}, buckets=16)
    ends = src.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    third = F.least(F.floor((F.col("id") - ends["lo"]) * 3 / max(ends["hi"] - ends["lo"] + 1, 1)), F.lit(2))
    outcomes = [register(store, src.where(third == k), key, facts, "id") for k in (0, 1, 2)]
    register(store, src.where(third == 1), key, facts, "id")  # a replay of a whole batch changes nothing
    kept = store.read("sources").select("id", F.lit(True).alias("in_table"))
    held = store.read("conflicts").select("id", F.lit(True).alias("quarantined"))
    rows = outcomes[0].unionByName(outcomes[1]).unionByName(outcomes[2]).join(kept, "id", "left").join(held, "id", "left")
    return rows.select("id", "outcome", "kept_id", F.coalesce("in_table", F.lit(False)).alias("in_table"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"))


S5_SQL = with_frames("sources", body="""SELECT id, outcome, kept_id, outcome = 'kept' AS in_table, outcome = 'conflict' AS quarantined FROM (SELECT id, first_value(id) OVER w AS kept_id, CASE WHEN row_number() OVER w = 1 THEN 'kept'
WHEN byte_count IS NOT DISTINCT FROM first_value(byte_count) OVER w AND lang IS NOT DISTINCT FROM first_value(lang) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM sources WINDOW w AS (PARTITION BY collection_id, request_id ORDER BY id))""")
S12_SQL = with_frames("sources", body="") + f""", {SPANS} SELECT s.source AS collection_id, n_before, coalesce(n, 0) AS n, coalesce(n_docs, 0) AS n_docs, revision, source_count, ready_count, unavailable_count
FROM (SELECT source, count(*) AS n_before, count(*) FILTER (NOT deleted) AS n, count(DISTINCT doc_id) FILTER (NOT deleted) AS n_docs FROM spans JOIN sources ON id = doc_id GROUP BY source) s
JOIN (SELECT collection_id, count(*) FILTER (deleted) AS revision, count(*) FILTER (NOT deleted) AS source_count, count(*) FILTER (NOT deleted AND status = 'ready') AS ready_count, count(*) FILTER (NOT deleted AND status <> 'ready') AS unavailable_count FROM sources GROUP BY 1) c ON c.collection_id = s.source"""
QUERIES = {"s5_merge_existing": (s5_merge, S5_SQL), "s12_rewrite_version": (s12_rewrite, S12_SQL)}
