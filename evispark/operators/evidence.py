"""Evidence: ordered lookups, packing under byte budgets, receipts, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BYTES, IDS = 16_384, 64


def lookup_lenient(ids: DataFrame, spans: DataFrame) -> DataFrame:
    """req, pos, id, and the span's columns: unknown ids are dropped, repeats and order kept."""
    return ids.select("req", F.posexplode("ids").alias("pos", "id")).join(spans, "id")


def lookup_strict(ids: DataFrame, spans: DataFrame) -> DataFrame:
    """As lenient, but one unknown id rejects the request; adds accepted."""
    x = ids.select("req", F.posexplode("ids").alias("pos", "id")).join(spans.withColumn("_known", F.lit(True)), "id", "left")
    return x.withColumn("accepted", F.count_if(F.col("_known").isNull()).over(W.partitionBy("req")) == 0).drop("_known")


def first_seen(rows: DataFrame, by: str, item: str, pos: str) -> DataFrame:
    """Distinct items in order of first appearance: by, item, place."""
    f = rows.groupBy(by, item).agg(F.min(pos).alias("pos"))
    return f.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("pos"))).drop("pos")


def pack_skip(items: Column, budget: int, most: int = IDS) -> Column:
    """Greedy fold over an array of (id, n): an item that does not fit is skipped, later smaller ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda a, x: F.when(a["used"] + x["n"] <= budget, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    return F.aggregate(F.slice(items, 1, most), start, step)


def read_evidence(requests: DataFrame, spans: DataFrame, budget: int = BYTES, most: int = IDS) -> DataFrame:
    """req, requested, delivered, used_bytes, truncated, ids: first-seen distinct spans packed with skipping (64 ids at most)."""
    known = lookup_lenient(requests, spans.select("id", F.octet_length("text").cast("long").alias("n")))
    seen = known.groupBy("req", "id").agg(F.min("pos").alias("pos"), F.max("n").alias("n"))
    top = seen.withColumn("r", F.row_number().over(W.partitionBy("req").orderBy("pos"))).where(F.col("r") <= most)
    packed = top.groupBy("req").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "n"))).alias("items")).withColumn("p", pack_skip(F.col("items"), budget, most))
    return packed.select("req", F.size("items").cast("long").alias("requested"), F.size("p.ids").cast("long").alias("delivered"), F.col("p.used").alias("used_bytes"), (F.size("p.ids") < F.size("items")).alias("truncated"), F.array_join("p.ids", ",").alias("ids"))


def fit_prefix(spans: DataFrame, by: str, order: list[str], budget: int) -> DataFrame:
    """The longest prefix of each group within the budget: stops at the first span that does not fit."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return spans.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") <= budget)


def inventory(spans: DataFrame, by: str = "source", cap: int = IDS) -> DataFrame:
    """by, n_sources, n_spans, n_bytes, complete (at most ``cap`` spans)."""
    g = spans.groupBy(by).agg(F.countDistinct("doc_id").alias("n_sources"), F.count("*").alias("n_spans"), F.sum(F.octet_length("text")).alias("n_bytes"))
    return g.withColumn("complete", F.col("n_spans") <= cap)


def collection_pages(spans: DataFrame, page_bytes: int, fragments: int = 64, pages: int = 4, by: str = "source") -> DataFrame:
    """by, page, doc_id, line_no, piece, n: the first pages of a collection in (doc, line) order; at most ``fragments`` pieces and ``page_bytes`` a page.

    Spans over the page size are cut into pieces of it. The reader takes ``pages`` pages, so at most pages x fragments leading pieces
    of a collection are folded.
    """
    pieces = F.ceil(F.octet_length("text") / page_bytes)
    x = spans.select(by, "doc_id", "line_no", F.octet_length("text").cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    x = x.withColumn("n", F.least(F.lit(page_bytes), F.col("size") - F.col("piece") * page_bytes))
    r = F.row_number().over(W.partitionBy(by).orderBy("doc_id", "line_no", "piece"))
    lead = x.withColumn("r", r).where(F.col("r") <= pages * fragments)
    g = lead.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("r", "doc_id", "line_no", "piece", "n"))).alias("xs"))
    start = F.struct(F.lit(1).alias("page"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("count"), F.array().cast("array<int>").alias("pages"))

    def step(a, v):
        new = (a["used"] + v["n"] > page_bytes) | (a["count"] >= fragments)
        page = F.when(new, a["page"] + 1).otherwise(a["page"])
        return F.struct(page.alias("page"), F.when(new, v["n"]).otherwise(a["used"] + v["n"]).alias("used"), F.when(new, 1).otherwise(a["count"] + 1).alias("count"), F.concat(a["pages"], F.array(page)).alias("pages"))

    f = g.withColumn("ps", F.aggregate("xs", start, step)["pages"])
    y = f.select(by, F.explode(F.arrays_zip("xs", "ps")).alias("z"))
    return y.select(by, F.col("z.ps").alias("page"), "z.xs.doc_id", "z.xs.line_no", "z.xs.piece", "z.xs.n").where(F.col("page") <= pages)


def reassemble(fragments: DataFrame) -> DataFrame:
    """doc_id, line_no, text, complete: fragments of a span joined in order; complete if their numbers are 0..n-1."""
    g = fragments.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("piece", "text"))).alias("fs"))
    return g.select("doc_id", "line_no", F.array_join(F.transform("fs", lambda f: f["text"]), "").alias("text"), (F.transform("fs", lambda f: f["piece"]) == F.sequence(F.lit(0), F.size("fs") - 1)).alias("complete"))


def merge_evidence(batches: DataFrame, most: int = IDS) -> DataFrame:
    """req, ids, missing: current ids and extra groups in order, distinct, first ``most``; missing lists groups of which nothing was delivered."""
    x = batches.select("req", "group_no", F.posexplode("ids").alias("pos", "id"))
    seen = x.groupBy("req", "id").agg(F.min(F.struct("group_no", "pos")).alias("at"))
    kept = seen.withColumn("place", F.row_number().over(W.partitionBy("req").orderBy("at"))).where(F.col("place") <= most)
    ids = kept.groupBy("req").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]), ",").alias("ids"))
    served = x.join(kept.select("req", "id"), ["req", "id"], "left_semi").select("req", "group_no").distinct()
    lost = batches.join(served, ["req", "group_no"], "left_anti").groupBy("req").agg(F.array_join(F.array_sort(F.collect_list("group_no")), ",").alias("missing"))
    return ids.join(lost, "req", "left").select("req", "ids", F.coalesce("missing", F.lit("")).alias("missing"))
