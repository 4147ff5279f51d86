"""Search variants and whole-scope collection, composed of lanes and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence as E
from . import retrieval as R

POOL, PROTECTED = {"V0": 12, "V1": 20, "V2": 20, "V3": 64}, {"V1": 4, "V2": 4, "V3": 20}


def protected(literal: DataFrame, phrase: DataFrame, n: int) -> DataFrame:
    """query_id, chunk_id: the first ``n`` verified rows of each query, literal and phrase hits in turn."""
    lane = lambda df, i: df.select("query_id", "chunk_id", F.lit(i).alias("lane"), F.col("rank").alias("pos"))
    return R.interleave(lane(literal, 0).unionByName(lane(phrase, 1)), n, ["query_id"]).select("query_id", "chunk_id")


def search(variant: str, lanes: DataFrame) -> DataFrame:
    """query_id, chunk_id, score, branches, place, of lane rows (query_id, chunk_id, rank, branch).

    V0 is dense only; V1 and V2 fuse the dense, bm25, literal and phrase lanes; V3 has a pool of 64 for reranking. Verified rows
    hold protected places and have their share of the score.
    """
    of = lambda branch: lanes.where(F.col("branch") == branch)
    names = ("dense",) if variant == "V0" else ("dense", "bm25", "literal", "phrase")
    kept = protected(of("literal"), of("phrase"), PROTECTED[variant]) if variant != "V0" else lanes.limit(0)
    return R.fused_pool(R.rrf([(n, of(n)) for n in names]), kept, POOL[variant])


def receipt(requested: Column, delivered: Column, ready: Column, unavailable: Column, spans: Column, cap: int = E.IDS) -> Column:
    """complete, truncated or subset: complete needs all ready sources, none unavailable and an inventory within the cap."""
    return F.when(delivered < requested, "truncated").when((unavailable == 0) & (ready <= cap) & (spans <= cap) & (delivered == spans), "complete").otherwise("subset")


def collect_scope(pages: DataFrame, spans: DataFrame, by: str = "source") -> DataFrame:
    """by, pages, n, whole: what the first four pages of a collection hold, and whether that is all of it."""
    got = pages.groupBy(by).agg(F.max("page").alias("pages"), F.sum("n").alias("n_bytes"))
    all_ = spans.groupBy(by).agg(F.sum(F.octet_length("text")).alias("total"))
    return got.join(all_, by).select(by, "pages", "n_bytes", (F.col("n_bytes") == F.col("total")).alias("whole"))
