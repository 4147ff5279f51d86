"""Frames that queries use, derived from the given tables by SQL that Spark and DuckDB both read.

The tables stand in for the engine's own: documents are originals (source = collection), events are run logs, labels are
judgements, conversations are messages, lineitem holds calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FRAMES = {
    "sources": """SELECT doc_id AS id, source AS collection_id, n_chars AS byte_count, lang, doc_id % 400 AS request_id, doc_id % 13 = 0 AS deleted,
        CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'pending' WHEN doc_id % 17 = 0 THEN 'processing' ELSE 'ready' END AS status FROM {documents}""",
    "runs": """SELECT event_id AS id, user_id AS conversation_id, event_type AS kind, ts AS created_at, value AS latency,
        CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 6 = 0 THEN 'queued' WHEN event_id % 10 = 1 THEN 'scope_expired' ELSE 'completed' END AS status,
        CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'partial' WHEN event_id % 5 = 2 THEN 'not_documented' ELSE 'supported' END AS answer_status,
        CASE WHEN event_id % 97 = 1 THEN event_id + 1000000000 WHEN event_id % 6 = 0 THEN NULL ELSE event_id - 1 END AS retry_of,
        event_id % 3 = 0 AS delivered, CASE WHEN event_id % 4 = 1 THEN ts + INTERVAL 60 SECONDS ELSE NULL END AS next_due, ts AS finished_at, event_id % 8 AS tries FROM {events}""",
    "audit": """SELECT CAST(floor(event_id / 20) AS BIGINT) AS run_id, event_id, event_id AS at, CAST(floor(event_id / 2) AS BIGINT) AS op,
        CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'end' END AS phase, event_type AS kind, event_id % 3 + 1 AS declared FROM {events} WHERE event_id % 19 <> 3""",
    "calls": """SELECT l_orderkey AS run, l_orderkey * 10 + l_linenumber AS call, l_linestatus AS cell, l_returnflag AS campaign,
        CASE WHEN l_linenumber % 3 = 0 THEN 'gpt-6-sol' WHEN l_linenumber % 7 = 4 THEN 'other' ELSE 'gpt-6-luna' END AS model,
        CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 8000 END AS input_tokens, CAST(l_quantity AS BIGINT) * 300 AS cached_tokens,
        CASE WHEN l_orderkey % 53 = 0 THEN 5 WHEN l_orderkey % 59 = 0 THEN 9000000 ELSE 0 END AS write_tokens, l_linenumber * 150 AS output_tokens FROM {lineitem}""",
    "cases": """SELECT l.doc_id AS case_id, d.source AS family, d.lang AS question_class, max(l.quality) AS quality, max(l.toxic) AS toxic FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id GROUP BY l.doc_id, d.source, d.lang""",
    "cells": """SELECT c.case_id, c.family, c.question_class, v.variant, g.generator, CASE WHEN c.case_id % 3 = 0 THEN NULL WHEN c.case_id % 3 = 1 THEN 'whole' ELSE 'claims' END AS policy,
        CASE WHEN (c.case_id + v.k) % 9 = 0 THEN 'failed' ELSE 'completed' END AS state,
        CASE WHEN (c.case_id + g.k) % 14 = 0 THEN 'no_budget' ELSE NULL END AS judge_na_reason,
        CASE WHEN (c.case_id + v.k) % 11 = 0 THEN NULL WHEN (c.case_id + g.k) % 13 = 0 THEN 'not_assessable' WHEN c.quality = 1 AND (c.toxic = 0 OR v.k = 1) THEN 'pass' ELSE 'fail' END AS verdict,
        (c.case_id + v.k + g.k) % 17 <> 0 AS coverage,
        CASE WHEN c.case_id % 4 = 0 THEN 'partial' ELSE 'supported' END AS gold_status,
        CASE WHEN c.case_id % 23 = 0 THEN NULL WHEN c.case_id % 29 = 0 THEN 'not_documented' WHEN c.case_id % 4 = 0 THEN 'partial' ELSE 'supported' END AS answer_status,
        c.case_id % 19 <> 0 AS status_correct, c.case_id % 31 <> 0 AS coverage_valid, CASE WHEN c.case_id % 37 = 0 THEN 'S1' ELSE 'S3' END AS severity, c.case_id % 41 <> 0 AS machine_ok
        FROM ({cases_sql}) c CROSS JOIN (SELECT 'V0' AS variant, 0 AS k UNION ALL SELECT 'V3', 1) v CROSS JOIN (SELECT 'luna' AS generator, 0 AS k UNION ALL SELECT 'sol', 5) g""",
    "reviews": """SELECT conv_id AS case_id, turn AS idx, CASE WHEN length(text) % 19 = 0 THEN -1 ELSE turn END AS claim_index,
        CASE WHEN length(text) % 6 = 0 THEN 'unsupported' WHEN length(text) % 7 = 0 THEN 'not_assessable' ELSE 'supported' END AS support,
        CASE WHEN length(text) % 5 = 0 THEN 'missing' WHEN length(text) % 8 = 0 THEN 'not_assessable' ELSE 'present' END AS label,
        CASE WHEN length(text) % 4 = 0 THEN 'redundant' WHEN length(text) % 9 = 0 THEN 'wrong' ELSE 'useful' END AS edge FROM {conversations}""",
    "messages": """SELECT conv_id, turn, role, text FROM {conversations}""",
}
#: Names that status counts always show.
RUN_STATUS = ["queued", "running", "completed", "failed", "cancelled", "scope_expired"]
ANSWER_STATUS = ["supported", "partial", "not_documented", "missing"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FRAMES[name].replace("{cases_sql}", FRAMES["cases"])
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_frames(*names: str, body: str) -> str:
    """DuckDB SQL: the frames as common table expressions before ``body``."""
    parts = []
    for n in names:
        text = FRAMES[n].replace("{cases_sql}", FRAMES["cases"])
        parts.append(f"{n} AS ({text.format(**{t: t for t in TABLES})})")
    return "WITH " + ", ".join(parts) + " " + body
