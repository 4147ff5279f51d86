"""Queries on pages of whole collections, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import ingest as I
from ..operators import paging as P
from .evidence_queries import SPANS, pages_sql, spans


def k6_all(spark, d):
    """Every page of each collection; spans over a page are cut into pieces of its size."""
    size = F.octet_length("text").cast("long")
    x = spans(spark, d).select("source", "doc_id", "line_no", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(size / P.PAGE_BYTES) - 1)).alias("piece"))
    x = x.withColumn("n", F.least(F.lit(P.PAGE_BYTES), F.col("size") - F.col("piece") * P.PAGE_BYTES))
    return P.pages(x, "source", ["doc_id", "line_no", "piece"]).groupBy("source", "page").agg(F.count("*").alias("n"), F.sum("n").alias("n_bytes"), F.min("doc_id").alias("first_doc"))


def h16_whole(spark, d):
    """Whole-scope reading: fragments of all spans, read page by page to the end, put together again and compared with the spans."""
    s = spans(spark, d)
    f = I.fragment_spans(s).join(s.select("doc_id", "source").distinct(), "doc_id").withColumn("n", F.octet_length("text"))
    paged = P.pages(f, "source", ["doc_id", "line_no", "piece"])
    got = P.delivered(paged, "source", ["doc_id", "line_no"])
    built = E.reassemble(paged).select("doc_id", "line_no", F.col("text").alias("built"), "complete")
    same = s.join(built, ["doc_id", "line_no"], "left").groupBy("source").agg(F.count_if(F.col("complete") & (F.col("built") == F.col("text"))).alias("n_same"))
    return got.join(same, "source").select("source", "n_spans", "n_bytes", "whole", "n_same")


QUERIES = {
    "k6_all_pages": (k6_all, pages_sql(4096).replace(" WHERE i <= 256", "") + " SELECT source, page, count(*) AS n, sum(n)::BIGINT AS n_bytes, min(doc_id) AS first_doc FROM f GROUP BY source, page"),
    "h16_whole_scope": (h16_whole, f"WITH {SPANS} SELECT source, count(*) AS n_spans, sum(strlen(text))::BIGINT AS n_bytes, TRUE AS whole, count(*) AS n_same FROM spans GROUP BY source"),
}
