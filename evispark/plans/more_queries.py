"""The rest of the inventory: joins, predicates, set operations, search variants and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as V
from ..operators import evidence as E
from ..operators import ingest as I
from ..operators import retrieval as R
from ..operators import search as X
from .evidence_queries import CHAIN, SPANS, UNCOVERED, asked, bm25, chunks, pages_sql, spans
from .frames import frame, table, with_frames
from .run_queries import CELLS, cells

DOCS = "documents"


def docs(spark, d):
    return table(spark, d, DOCS)


def p10(spark, d):
    return frame(spark, d, "runs").groupBy(F.coalesce("answer_status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"))


def j1(spark, d):
    s = frame(spark, d, "sources").select(F.col("id").alias("doc_id"), "status")
    return spans(spark, d).join(s, "doc_id").groupBy("status").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


def j2(spark, d):
    """Runs with their conversation and its collection, that of the source of the same number."""
    r = frame(spark, d, "runs").select("id", F.col("conversation_id").alias("conv_id"), "status")
    m = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    src = frame(spark, d, "sources")
    c = src.groupBy("collection_id").agg(F.count("*").alias("n_sources"))
    owner = src.select(F.col("id").alias("conv_id"), "collection_id")
    return r.join(m, "conv_id").join(owner, "conv_id").join(c, "collection_id").select("id", "conv_id", "collection_id", "n_messages", "n_sources")


def j5(spark, d):
    return docs(spark, d).join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


def j14(spark, d):
    x = docs(spark, d).select("doc_id", F.array(F.col("doc_id") % 5, F.col("doc_id") % 7).alias("opt"), F.when(F.col("doc_id") % 9 != 0, F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 6)).alias("avail"))
    return x.select("doc_id", V.option_available(F.col("opt"), F.col("avail")).alias("ok"))


def j20(spark, d):
    """Lookup by a canonical key of several fields, null-safe where a field may be absent."""
    a = docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("page"))
    b = docs(spark, d).select(F.col("doc_id").alias("d2"), F.when(F.col("doc_id") % 3 != 0, F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("p2"))
    return a.join(b, (F.col("doc_id") == F.col("d2")) & F.col("page").eqNullSafe(F.col("p2"))).select("doc_id", "page")


def d4(spark, d):
    g = cells(spark, d).groupBy("family").agg(F.count_if("success").alias("numerator"), F.count_if(F.col("judge_state") == "assessable").alias("denominator"))
    return g.withColumn("value", F.round(T.ratio(F.col("numerator"), F.col("denominator")), 6))


def d13(spark, d):
    """Evidence availability by stage, unknown inventories left out and counted."""
    c = cells(spark, d)
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.when(F.col("case_id") % (k + 4) != 0, F.col("case_id") % (k + 2) != 0).alias("ok")) for k, s in enumerate(("candidates", "initial", "final"))])
    g = c.select(F.explode(stages).alias("s")).groupBy("s.stage").agg(F.count_if("s.ok").alias("available"), F.count("s.ok").alias("known"), F.count("*").alias("n"))
    return g.select("stage", "available", "known", (F.col("n") - F.col("known")).alias("unknown"), F.round(T.ratio(F.col("available"), F.col("known")), 6).alias("rate"))


def d19(spark, d):
    return V.core_rates(cells(spark, d), ["variant", "generator"]).select("variant", "generator", "planned", "successes")


def d32(spark, d):
    return bm25(spark, d).where("rank <= 12").join(chunks(spark, d).select("chunk_id", "source"), "chunk_id").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def h14(spark, d):
    i = E.inventory(spans(spark, d))
    s = frame(spark, d, "sources").groupBy(F.col("collection_id").alias("source")).agg(F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") != "ready").alias("unavailable"))
    j = i.join(s, "source").withColumn("delivered", F.least("n_spans", F.lit(64)))
    return j.select("source", X.receipt(F.least(F.col("n_spans"), F.col("n_spans") % 128), F.col("delivered"), F.col("ready"), F.col("unavailable"), F.col("n_spans")).alias("receipt"))


def h16(spark, d):
    s = spans(spark, d)
    return X.collect_scope(E.collection_pages(s, 16384), s)


def w5(spark, d):
    return I.line_classes(spans(spark, d)).where("kind = 'identity'").select("doc_id", F.col("line_no").cast("long").alias("line_no"))


def w7(spark, d):
    return bm25(spark, d).where("rank <= 5").select("query_id", "chunk_id", "rank")


def k4(spark, d):
    return R.rerank(bm25(spark, d).where("rank <= 64").select("query_id", "chunk_id", "score"), chunks(spark, d), asked(spark, d), 12).select("query_id", "chunk_id", "place")


def u4(spark, d):
    """Cited minus delivered, by row."""
    x = docs(spark, d).select("doc_id", F.array_except(F.array(F.col("doc_id") % 5, F.col("doc_id") % 11), F.array(F.col("doc_id") % 3, F.lit(4).cast("long"))).alias("x"))
    return x.select("doc_id", F.array_join(F.array_sort("x"), ",").alias("undelivered"))


def u6(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("turn"), F.col("turn") * 2))))), ",").alias("evidence"))


def g6(spark, d):
    c = cells(spark, d)
    done = F.col("state") == "completed"
    return c.select("case_id", "variant", "generator", F.when(done, F.col("case_id") % 41 != 0).alias("ids_valid"), F.when(done, F.col("coverage_valid")).alias("coverage_ok"), F.when(done, ~F.exists("edge_labels", lambda x: x == "wrong")).alias("edges_complete"))


def v2(spark, d):
    """Family digests (sums of two hashes of the ids, so that a family is never gathered), compared with those of a declared inventory that lacks some documents."""
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "doc_id").cast("decimal(20,0)"))
    digests = lambda df, name: df.groupBy(F.col("source").alias("family")).agg(F.struct(F.count("*"), part(1), part(2)).alias(name), F.count("*").alias("n"))
    a, b = digests(docs(spark, d), "found"), digests(docs(spark, d).where("doc_id % 111 <> 5"), "declared").drop("n")
    return a.join(b, "family", "left").select("family", "n", F.coalesce(F.col("found") == F.col("declared"), F.lit(False)).alias("same"))


def v3(spark, d):
    """Cases: the anchor must be in scope, turns 1 or 2."""
    c = frame(spark, d, "cases").select("case_id", F.sequence(F.col("case_id") - 2, F.col("case_id") + F.col("case_id") % 2 - 1).alias("scope"), (F.col("case_id") % 4).alias("turns"))
    return c.select("case_id", F.array_contains("scope", F.col("case_id")).alias("anchor_in_scope"), F.col("turns").between(1, 2).alias("turns_ok"))


def v5(spark, d):
    """Gold references without a review entry, and entries reviewed more than once."""
    gold = table(spark, d, "labels").select("doc_id").distinct()
    entries = docs(spark, d).where("doc_id % 6 <> 1").select("doc_id").unionAll(docs(spark, d).where("doc_id % 29 = 0").select("doc_id"))
    lost = gold.join(entries, "doc_id", "left_anti").withColumn("problem", F.lit("unreviewed"))
    twice = entries.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit("repeated").alias("problem"))
    return lost.unionByName(twice)


def v6(spark, d):
    """The documents of each collection's source map, as rows: distinct source ids and readiness."""
    x = docs(spark, d).select("source", (F.col("doc_id") % 500).alias("sid"), (F.col("doc_id") % 8 != 0).alias("ready"))
    return x.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("sid").alias("n_ids"), F.bool_and("ready").alias("all_ready"))


def v7(spark, d):
    """The live inventory against the frozen one."""
    live = docs(spark, d).where("doc_id % 90 <> 3").select(F.col("doc_id").alias("a"), F.col("n_chars").alias("na"))
    frozen = docs(spark, d).where("doc_id % 95 <> 4").select(F.col("doc_id").alias("b"), (F.col("n_chars") + F.when(F.col("doc_id") % 77 == 0, 1).otherwise(0)).alias("nb"))
    j = live.join(frozen, F.col("a") == F.col("b"), "full_outer").where(~(F.col("a").eqNullSafe(F.col("b")) & (F.col("na") == F.col("nb"))) | F.col("a").isNull() | F.col("b").isNull())
    return j.select(F.coalesce("a", "b").alias("doc_id"), F.when(F.col("a").isNull(), "gone").when(F.col("b").isNull(), "new").otherwise("changed").alias("problem"))


def v10(spark, d):
    """Frozen primary digests against fresh projections."""
    c = cells(spark, d)
    fresh = F.md5(F.concat_ws("|", F.col("case_id").cast("string"), "variant", "generator", F.coalesce("verdict", F.lit("~"))))
    frozen = F.md5(F.concat_ws("|", F.col("case_id").cast("string"), "variant", "generator", F.when(F.col("case_id") % 16 == 0, F.lit("old")).otherwise(F.coalesce("verdict", F.lit("~")))))
    return c.where(fresh != frozen).select("case_id", "variant", "generator")


def v14(spark, d):
    """The wide metric row: cells with their case, messages, source status and quote support."""
    c = cells(spark, d).where("generator = 'sol'").select("case_id", "variant", "judge_state", "success")
    s = frame(spark, d, "sources").select(F.col("id").alias("case_id"), "status", "byte_count")
    m = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.count("*").alias("n_messages"))
    a = frame(spark, d, "audit").groupBy(F.col("run_id").alias("case_id")).agg(F.count("*").alias("n_events"))
    return c.join(s, "case_id").join(m, "case_id", "left").join(a, "case_id", "left").select("*")


QUERIES = {
    "p10_status_coalesce": (p10, with_frames("runs", body="SELECT coalesce(answer_status, 'missing') AS status, count(*) AS n FROM runs GROUP BY 1")),
    "j1_spans_with_source": (j1, with_frames("sources", body="") + f", {SPANS} SELECT status, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM spans JOIN sources ON id = doc_id GROUP BY status"),
    "j2_run_scope": (j2, with_frames("runs", "sources", body=", m AS (SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY 1), c AS (SELECT collection_id, count(*) AS n_sources FROM sources GROUP BY 1) SELECT r.id, m.conv_id, c.collection_id, n_messages, n_sources FROM runs r JOIN m ON m.conv_id = r.conversation_id JOIN sources s ON s.id = m.conv_id JOIN c ON c.collection_id = s.collection_id")),
    "j5_restrict": (j5, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "j14_option_available": (j14, "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN greatest(doc_id % 5, doc_id % 7) <= doc_id % 6 END AS ok FROM documents"),
    "j20_ref_key": (j20, "SELECT a.doc_id, a.page FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS page FROM documents) a JOIN (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN lang END AS page FROM documents) b ON a.doc_id = b.doc_id AND a.page IS NOT DISTINCT FROM b.page"),
    "d4_ratio": (d4, CELLS + " SELECT family, count(*) FILTER (success) AS numerator, count(*) FILTER (judge_state = 'assessable') AS denominator, round(count(*) FILTER (success) / nullif(count(*) FILTER (judge_state = 'assessable'), 0), 6) AS value FROM rows1 GROUP BY family"),
    "d13_availability_by_stage": (d13, CELLS + ", s AS (SELECT unnest([{'s': 'candidates', 'k': 0}, {'s': 'initial', 'k': 1}, {'s': 'final', 'k': 2}]) AS t, case_id FROM rows1), o AS (SELECT t.s AS stage, CASE WHEN case_id % (t.k + 4) <> 0 THEN case_id % (t.k + 2) <> 0 END AS ok FROM s) SELECT stage, count(*) FILTER (ok) AS available, count(ok) AS known, count(*) - count(ok) AS unknown, round(count(*) FILTER (ok) / nullif(count(ok), 0), 6) AS rate FROM o GROUP BY stage"),
    "d19_cells": (d19, CELLS + " SELECT variant, generator, count(*) AS planned, count(*) FILTER (success) AS successes FROM rows1 GROUP BY 1, 2"),
    "d32_delivered_sources": (d32, f"{CHAIN} SELECT query_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM bm25 b JOIN chunks c ON c.chunk_id = b.chunk_id WHERE rank <= 12 GROUP BY query_id"),
    "h14_receipt": (h14, with_frames("sources", body="") + f", {SPANS}, i AS (SELECT source, count(*) AS n FROM spans GROUP BY 1), s AS (SELECT collection_id AS source, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status <> 'ready') AS un FROM sources GROUP BY 1) SELECT i.source, CASE WHEN least(n, 64) < least(n, n % 128) THEN 'truncated' WHEN un = 0 AND ready <= 64 AND n <= 64 THEN 'complete' ELSE 'subset' END AS receipt FROM i JOIN s ON s.source = i.source"),
    "h16_collect_scope": (h16, pages_sql(16384) + ", g AS (SELECT source, max(page) AS pages, sum(n)::BIGINT AS n_bytes FROM f WHERE page <= 4 GROUP BY source), z AS (SELECT source, sum(strlen(text)) AS total FROM spans GROUP BY source) SELECT source, pages, n_bytes, n_bytes = total AS whole FROM g JOIN z USING (source)"),
    "w5_standalone_headers": (w5, UNCOVERED + " SELECT doc_id, line_no FROM k WHERE kind = 'identity'"),
    "w7_rank_lane": (w7, f"{CHAIN} SELECT query_id, chunk_id, rank FROM bm25 WHERE rank <= 5"),
    "k4_top_rerank": (k4, f"{CHAIN}, b AS (SELECT * FROM bm25 WHERE rank <= 64), h AS (SELECT query_id, chunk_id, count(*) AS k FROM qt JOIN posted USING (term) GROUP BY ALL), m AS (SELECT query_id, count(*) AS m FROM qt GROUP BY ALL) SELECT query_id, chunk_id, place FROM (SELECT b.query_id, b.chunk_id, row_number() OVER (PARTITION BY b.query_id ORDER BY round(k / m, 6) DESC, score DESC, b.chunk_id) AS place FROM b JOIN h ON h.query_id = b.query_id AND h.chunk_id = b.chunk_id JOIN m ON m.query_id = b.query_id) WHERE place <= 12"),
    "u4_undelivered": (u4, "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([doc_id % 5, doc_id % 11], lambda x: x <> doc_id % 3 AND x <> 4))), ',') AS undelivered FROM documents"),
    "u6_evidence_union": (u6, "SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list([turn, turn * 2])))), ',') AS evidence FROM conversations GROUP BY conv_id"),
    "g6_machine_checks": (g6, CELLS + " SELECT case_id, variant, generator, CASE WHEN state = 'completed' THEN case_id % 41 <> 0 END AS ids_valid, CASE WHEN state = 'completed' THEN coverage_valid END AS coverage_ok, CASE WHEN state = 'completed' THEN case_id % 51 <> 0 END AS edges_complete FROM rows1"),
    "v2_family_digest": (v2, "WITH a AS (SELECT source, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS f, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS g FROM documents WHERE doc_id % 111 <> 5 GROUP BY 1) SELECT a.source AS family, n, coalesce(f = g, FALSE) AS same FROM a LEFT JOIN b ON b.source = a.source"),
    "v3_cases": (v3, with_frames("cases", body="SELECT case_id, case_id % 2 = 1 AS anchor_in_scope, case_id % 4 BETWEEN 1 AND 2 AS turns_ok FROM cases")),
    "v5_extraction_reviews": (v5, "SELECT DISTINCT l.doc_id, 'unreviewed' AS problem FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 6 <> 1 OR doc_id % 29 = 0) UNION ALL SELECT doc_id, 'repeated' FROM documents WHERE doc_id % 6 <> 1 AND doc_id % 29 = 0"),
    "v6_source_map": (v6, "SELECT source, count(*) AS n, count(DISTINCT doc_id % 500) AS n_ids, bool_and(doc_id % 8 <> 0) AS all_ready FROM documents GROUP BY source"),
    "v7_live_inventory": (v7, "SELECT doc_id, CASE WHEN doc_id % 90 = 3 THEN 'gone' WHEN doc_id % 95 = 4 THEN 'new' ELSE 'changed' END AS problem FROM documents WHERE NOT (doc_id % 90 = 3 AND doc_id % 95 = 4) AND (doc_id % 90 = 3 OR doc_id % 95 = 4 OR doc_id % 77 = 0)"),
    "v10_projection_freshness": (v10, CELLS + " SELECT case_id, variant, generator FROM rows1 WHERE case_id % 16 = 0"),
    "v14_metric_rows": (v14, with_frames("sources", "audit", "cells", body="") + CELLS.split("FROM {cells_sql}")[0][len(with_frames("cells", body="")) - 1:] + ", m AS (SELECT conv_id, count(*) AS n_messages FROM conversations GROUP BY 1), ev AS (SELECT run_id, count(*) AS n_events FROM audit GROUP BY 1) SELECT r.case_id, variant, judge_state, success, s.status, byte_count, n_messages, n_events FROM rows1 r JOIN sources s ON s.id = r.case_id LEFT JOIN m ON m.conv_id = r.case_id LEFT JOIN ev ON ev.run_id = r.case_id WHERE generator = 'sol'"),
}
