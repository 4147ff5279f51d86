"""Whole-collection pages without end: every piece of a collection gets its page, however many pages there are.

Pages are filled in order, so where one begins depends on all before it. But a page holds ``most`` pieces at most: whatever came
before, the first page that begins in a block of pieces begins at one of the block's first ``most``. So blocks are looked at side by
side: each says, for every place at which its first page may begin, where the first page of the next block would begin and how
many pages begin within. The cursors are then carried from block to block over this table (a row a block), and each block
numbers its pages from its own cursor.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import written

BLOCK, PIECES_IN_PAGE, PAGE_BYTES = 4096, 64, 4096


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds i: the number (from 0) of each row of ``by`` in ``order`` (unique in it). Rows are dealt into ranges that are numbered
    apart; what the ranges before hold is added, so a collection of any size is many tasks."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    spread = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = written(rows.repartitionByRange(spread, F.col(by).asc_nulls_first(), *keys).withColumn("_part", F.spark_partition_id()))
    sizes = laid.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy("_by").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = laid.withColumn("_own", F.row_number().over(W.partitionBy("_part", by).orderBy(*keys)))
    return own.join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p"))).withColumn("i", F.col("_own") - 1 + F.col("_before")).drop("_part", "_by", "_p", "_own", "_before")


def starts(sizes: list[int], first: int, block: int, most: int, budget: int) -> tuple[list[int], int]:
    """(pages that begin within the block, where the next block's first one does), of the pieces from the block's beginning on."""
    out, at = [], first
    while at < min(block, len(sizes)):
        out.append(at)
        used, end = sizes[at], at + 1
        while end < len(sizes) and end - at < most and used + sizes[end] <= budget:
            used += sizes[end]
            end += 1
        at = end
    return out, at - block


def pages(pieces: DataFrame, by: str, order: list[str], page_bytes: int = PAGE_BYTES, most: int = PIECES_IN_PAGE, block: int = BLOCK) -> DataFrame:
    """Adds i and page (from 1) to pieces (``by``, ``order``, ``n`` bytes): a page ends before the piece that would take it over
    ``page_bytes``, or after ``most`` pieces; a larger piece is a page of its own."""
    if block < most:
        raise ValueError("a block holds a page at least")
    rows = written(numbered(pieces, by, order))
    narrow = rows.select(F.col(by).alias("by"), "i", F.col("n").cast("long").alias("n"))
    here = F.floor(F.col("i") / block)
    # the pieces that the block's last page may reach are looked at in both blocks
    seen = F.when((F.col("i") % block < most) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    spread = narrow.withColumn("block", F.explode(seen))

    def look(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i")
        sizes = p.n.tolist()
        own = int((p.i // block == p.block).sum())
        found = [starts(sizes, k, own, most, page_bytes) for k in range(min(most, own))]
        return pd.DataFrame({"by": p.by.iloc[:1], "block": p.block.iloc[:1], "next": [[x[1] for x in found]], "count": [[len(x[0]) for x in found]]})

    table = spread.groupBy("by", "block").applyInPandas(look, f"by {narrow.schema['by'].dataType.simpleString()}, block long, next array<long>, count array<long>")
    steps = table.groupBy("by").agg(F.sort_array(F.collect_list(F.struct("block", "next", "count"))).alias("blocks"))

    def carry(s, b):
        at = F.greatest(s["cursor"], F.lit(0).cast("long")).cast("int")
        more = F.struct(b["block"].alias("block"), s["cursor"].alias("cursor"), s["page"].alias("page"))
        return F.struct(F.get(b["next"], at).alias("cursor"), (s["page"] + F.get(b["count"], at)).alias("page"), F.concat(s["out"], F.array(more)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("cursor"), F.lit(0).cast("long").alias("page"), F.array().cast("array<struct<block:bigint,cursor:bigint,page:bigint>>").alias("out"))
    cursors = written(steps.select("by", F.explode(F.aggregate("blocks", zero, carry, lambda s: s["out"])).alias("c")).select("by", "c.block", "c.cursor", "c.page"))
    joined = spread.join(cursors.withColumnsRenamed({"by": "_by", "block": "_block"}), F.col("by").eqNullSafe(F.col("_by")) & (F.col("block") == F.col("_block"))).drop("_by", "_block")

    def number(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i").reset_index(drop=True)
        own = int((p.i // block == p.block).sum())
        at, _ = starts(p.n.tolist(), int(p.cursor.iloc[0]), own, most, page_bytes)
        mark = pd.Series(0, index=p.index)
        mark[at] = 1
        out = p[["by", "i"]].assign(page=p.page + mark.cumsum())
        return out[: own]

    paged = joined.groupBy("by", "block").applyInPandas(number, f"by {narrow.schema['by'].dataType.simpleString()}, i long, page long")
    return rows.join(paged.withColumnsRenamed({"by": "_by", "i": "_i"}), F.col(by).eqNullSafe(F.col("_by")) & (F.col("i") == F.col("_i"))).drop("_by", "_i")


def delivered(paged: DataFrame, by: str, order: list[str], last_page: int | None = None) -> DataFrame:
    """by, pages, n_spans, n_bytes, whole: what the pages up to ``last_page`` (all) deliver. ``whole``: every span of the collection has all its
    pieces among them."""
    read = F.lit(True) if last_page is None else F.col("page") <= last_page
    span = paged.groupBy(by, *order).agg(F.count("*").alias("pieces"), F.count_if(read).alias("got"), F.sum(F.when(read, F.col("n"))).alias("bytes"), F.max(F.when(read, F.col("page"))).alias("page"))
    return span.groupBy(by).agg(F.max("page").alias("pages"), F.count_if(F.col("got") == F.col("pieces")).alias("n_spans"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("n_bytes"), F.bool_and(F.col("got") == F.col("pieces")).alias("whole"))
