"""Mixing sources to target weights. Native DataFrame code only.

1. Targets: sources in code-point order (null last) weigh by ``weights`` in turn and share ``share`` times all sizes; a target
   stops at ``most`` times its source's size and what is over goes to the others by weight, until none is above.
2. Packing: each source's documents form streams (one for each hash bucket, so that a hot source spreads over many tasks), and
   each stream is cut into blocks of ``block`` words. Sources of few words have shorter blocks, so that each has ``FINE`` of
   them, or blocks of a word: whole blocks then come near any target.
3. Draw: the output is shards of ``shard`` slots. Every slot draws its source by the targets (in blocks), so a shard's source
   counts are multinomial. A source's counts are summed up over the shards; where the sum strays from the target by more than
   ``stray`` of it, as with few draws it will, the running sums are stretched to that distance.
4. Running sums number a source's slots: slot j takes block p(j mod blocks), p a pseudorandom index permutation of the source
   and round; no block is taken more often than ``most`` times. Slots and blocks are joined by that index.

Permutations are swap-or-not networks: exact bijections on any range, computed by built-in functions.

Rows that are the same in id, source and text are one row with a count until the end, so a row that repeats without bound
makes no hot key. Tables with a row for each source are broadcast up to ``SOURCES_TO_BROADCAST`` sources and shuffled beyond.

Defined cases: a null or empty text has size 0 and is never taken; null source is a source of its own, last in order; null
doc_id is kept; repeated rows are documents of their own and share what is taken of them as evenly as can be; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, FINE, SHARD, STRAY, ROUNDS, ROWS = 64, 256, 8192, 0.005, 10, 2000
SLOTS_IN_TASK, SOURCES_TO_BROADCAST, BINS, STEP = 50_000, 100_000, 1024, 4096
WORD = r"[^\x20\x09-\x0D]+"
WORD_END = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SOURCES_TO_BROADCAST + BINS else df


def _skey() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def sizes(docs: DataFrame, marks: list[Column] | None = None) -> DataFrame:
    """skey, source, doc_id, h (a hash of id and text, or of ``marks``), size, copies: a row for each different document."""
    h = F.xxhash64(*(marks or ["doc_id", "text"]))
    rows = docs.select(_skey().alias("skey"), "source", "doc_id", h.alias("h"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.groupBy("skey", "source", "doc_id", "h").agg(F.max("size").alias("size"), F.count("*").alias("copies"))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size). A row for each source: one window over so small a table is cheap."""
    everything = W.partitionBy()
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    x = per_source.withColumn("w", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    x = x.withColumn("budget", share * F.sum("source_size").over(everything))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    x = x.withColumn("level", (F.col("budget") - before) / rest)
    x = x.withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    left = F.max("budget").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    return x.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("w") / free).alias("target"))


def packed(documents: DataFrame, block: int = BLOCK, weights=WEIGHTS, share: float = SHARE, most: float = MOST, rows: int = ROWS) -> tuple[DataFrame, DataFrame, int]:
    """(documents with their place, sources, number of sources).

    Documents get block (their source's block length), bucket, off (words before them in their stream) and first_block (their
    stream's first block within the source). Sources have sizes, target, block, blocks and slots (the target in blocks).
    """
    size = F.sum(F.col("size") * F.col("copies")).alias("source_size")
    per = documents.groupBy("skey", "source").agg(size, F.count("*").alias("n"))
    shape = per.select("skey", F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.col("source_size") / FINE))).cast("long").alias("block"), F.ceil(F.col("n") / F.greatest(F.lit(rows), F.sqrt("n"))).alias("buckets"))
    n = per.count()
    d = documents.join(_small(shape, n), "skey").withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(7)), F.col("buckets")))
    stream = W.partitionBy("skey", "bucket").orderBy("doc_id", "h").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("off", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(stream), F.lit(0))).drop("buckets")
    streams = d.groupBy("skey", "source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.max("block").alias("block")).withColumn("n", F.ceil(F.col("words") / F.col("block")))
    upto = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    streams = streams.withColumn("first_block", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    firsts = streams.select("skey", "bucket", "first_block")
    d = d.join(firsts, ["skey", "bucket"])
    s = streams.groupBy("skey", "source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("blocks"), F.max("block").alias("block"))
    t = targets(s.select("source", "source_size"), weights, share, most).select(_skey().alias("skey"), "target")
    s = s.join(_small(t, n), "skey")
    slots = F.when(F.col("source_size") > 0, F.least(most * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0)
    return d, s.withColumn("slots", slots.cast("long")), n


def shard_counts(sources: DataFrame, n_sources: int, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """skey, shard, n: the multinomial draw of each output shard's source counts. Each slot draws a number below the sum of all
    targets and finds its source in a bin of numbers, so that no slot looks at all sources."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    tasks = max(1, -(-total // SLOTS_IN_TASK))
    width = max(1, -(-total // BINS))
    upto = F.sum("slots").over(W.orderBy("skey"))  # a row for each source
    bounds = sources.where("slots > 0").select("skey", (upto - F.col("slots")).alias("lo"), upto.alias("hi"))
    bounds = bounds.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    draws = spark.range(0, total, 1, tasks).select(F.floor(F.col("id") / shard).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("u"))
    draws = draws.withColumn("bin", F.floor(F.col("u") / width))
    drawn = draws.join(_small(bounds, n_sources + BINS), "bin").where("u >= lo AND u < hi")
    return drawn.groupBy("skey", "shard").agg(F.count("*").alias("n"))


def numbered(counts: DataFrame, sources: DataFrame, n_sources: int, most: float = MOST, stray: float = STRAY, seed: int = 17) -> DataFrame:
    """skey, shard, first, end, blocks: which slots of its source (end excluded) each shard has."""
    aim = sources.where("slots > 0").select("skey", "slots", "blocks")
    seat = aim.select("skey", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("n"))  # a source that no slot drew has a shard, too
    cells = counts.unionByName(seat).groupBy("skey", "shard").agg(F.sum("n").alias("n"))
    by = W.partitionBy("skey")
    order = by.orderBy("shard")
    x = cells.withColumn("sum", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("drawn", F.sum("n").over(by)).join(_small(aim, n_sources), "skey")
    low, high = F.floor(F.col("slots") * (1 - stray) + 0.5), F.least(F.floor(F.col("slots") * (1 + stray) + 0.5), (most * F.col("blocks")).cast("long"))
    x = x.withColumn("final", F.greatest(F.lit(0), F.least(high, F.greatest(low, F.col("drawn")))))
    end = F.when(F.col("final") == F.col("drawn"), F.col("sum")).when(F.col("drawn") == 0, F.col("final")).otherwise(F.floor(F.col("sum") / F.col("drawn") * F.col("final") + 1e-9))
    x = x.withColumn("end", end.cast("long"))
    return x.withColumn("first", F.coalesce(F.lag("end").over(order), F.lit(0))).where("end > first").select("skey", "shard", "first", "end", "blocks")


def permuted(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where the keyed permutation of 0..n-1 puts i."""

    def turn(x, r):
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), key, r + 1000), F.lit(2)) == 1, other).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), i, turn)


def slots_of(cells: DataFrame, tasks: int, seed: int = 17) -> DataFrame:
    """A row for each output slot: skey, shard, j (the source's slot), block_no (within the source). Cells are dealt to as many
    tasks as their slots call for before they are unfolded."""
    x = cells.withColumn("c", F.explode(F.sequence(F.floor(F.col("first") / STEP), F.floor((F.col("end") - 1) / STEP)))).repartition(tasks, "skey", "shard", "c")
    x = x.withColumn("j", F.explode(F.sequence(F.greatest("first", F.col("c") * STEP), F.least("end", (F.col("c") + 1) * STEP) - 1)))
    key = F.xxhash64(F.lit(seed), "skey", F.floor(F.col("j") / F.col("blocks")))
    return x.select("skey", "shard", "first", "j", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), key).alias("block_no"))


def _pieces(placed: DataFrame) -> DataFrame:
    """A row for each (document, block that it reaches into). piece_start counts on through a document's copies."""
    d = placed.where("size > 0").withColumn("words", F.col("size") * F.col("copies"))
    d = d.withColumn("low", F.floor(F.col("off") / F.col("block"))).withColumn("high", F.floor((F.col("off") + F.col("words") - 1) / F.col("block")))
    d = d.withColumn("c", F.explode(F.sequence(F.floor(F.col("low") / STEP), F.floor(F.col("high") / STEP))))  # in steps: no array grows with the copies
    d = d.withColumn("k", F.explode(F.sequence(F.greatest("low", F.col("c") * STEP), F.least("high", (F.col("c") + 1) * STEP - 1))))
    start = F.greatest(F.lit(0), F.col("k") * F.col("block") - F.col("off"))
    end = F.least(F.col("words"), (F.col("k") + 1) * F.col("block") - F.col("off"))
    return d.select("skey", "source", "doc_id", "h", (F.col("first_block") + F.col("k")).alias("block_no"), start.alias("piece_start"), (end - start).alias("piece_words"))


def _drawn(sources: DataFrame, n: int, shard: int, most: float, stray: float, seed: int) -> tuple[DataFrame, int]:
    """(cells with their slot numbers, tasks to unfold them in)."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    return numbered(shard_counts(sources, n, shard, seed), sources, n, most, stray, seed), max(1, -(-total // SLOTS_IN_TASK))


def mixed(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, share: float = SHARE, most: float = MOST, stray: float = STRAY, seed: int = 17, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(slots, pieces): the output's slots (shard, at, skey, j, block_no), and for each slot the pieces of documents that its block holds.

    pieces: shard, at, source, doc_id, h, piece_start (word of the document), piece_words.
    """
    placed, sources, n = packed(saved(sizes(docs), "mix"), block, weights, share, most, rows)
    sources = saved(sources, "sources")
    cells, tasks = _drawn(sources, n, shard, most, stray, seed)
    whole = W.partitionBy("shard")
    cells = saved(cells.withColumn("base", F.sum(F.col("end") - F.col("first")).over(whole.orderBy("skey")) - (F.col("end") - F.col("first"))).withColumn("all", F.sum(F.col("end") - F.col("first")).over(whole)), "cells")
    at = permuted(F.col("base") + F.col("j") - F.col("first"), F.col("all"), F.xxhash64(F.lit(seed), "shard"))
    slots = slots_of(cells, tasks, seed).join(cells.select("skey", "shard", "base", "all"), ["skey", "shard"]).select("shard", at.alias("at"), "skey", "j", "block_no")
    return slots, slots.join(_pieces(placed), ["skey", "block_no"]).drop("skey", "j")


def _taken(docs: DataFrame, marks, block, shard, weights, share, most, stray, seed, rows) -> DataFrame:
    """skey, source, doc_id, h, size, copies, source_size, target, taken (by all copies): a row for each different document."""
    placed, sources, n = packed(saved(sizes(docs, marks), "mix"), block, weights, share, most, rows)  # texts are read once; what follows needs sizes only
    placed, sources = saved(placed, "placed"), saved(sources, "sources")
    cells, tasks = _drawn(sources, n, shard, most, stray, seed)
    uses = slots_of(cells, tasks, seed).groupBy("skey", "block_no").agg(F.count("*").alias("uses"))
    key = ["skey", "doc_id", "h"]
    taken = _pieces(placed).join(uses, ["skey", "block_no"]).groupBy(*key).agg(F.sum(F.col("piece_words") * F.col("uses")).alias("t"))
    taken = taken.select(*[F.col(k).alias(f"_{k}") for k in key], "t")
    on = (F.col("skey") == F.col("_skey")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h"))
    d = placed.join(taken, on, "left").join(_small(sources.select("skey", "source_size", "target"), n), "skey")
    return d.select("skey", "source", "doc_id", "h", "size", "copies", "source_size", "target", F.coalesce("t", F.lit(0)).alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, share: float = SHARE, most: float = MOST, stray: float = STRAY, seed: int = 17, rows: int = ROWS) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source, source_size, target, taken, h."""
    m = _taken(docs, None, block, shard, weights, share, most, stray, seed, rows)
    m = m.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STEP))))
    m = m.withColumn("copy", F.explode(F.sequence(F.col("c") * STEP, F.least("copies", (F.col("c") + 1) * STEP) - 1)))
    each = F.floor(F.col("taken") / F.col("copies")) + F.when(F.col("copy") < F.col("taken") % F.col("copies"), 1).otherwise(0)
    return m.select("doc_id", "size", "source", "source_size", "target", each.cast("long").alias("taken"), "h")


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, share: float = SHARE, most: float = MOST, stray: float = STRAY, seed: int = 17, rows: int = ROWS) -> DataFrame:
    """The documents of the mix, with their columns: a document stands whole as often as the words taken of it fill it, and once more
    with its first words for the rest, so that each source has the very number of words that the mix takes of it. Columns other
    than text are the whole document's; documents of which nothing is taken go. Rows that are the same in every column (those of
    map types aside) share what is taken of them."""
    marks = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    m = _taken(docs, marks, block, shard, weights, share, most, stray, seed, rows).where("taken > 0")
    m = m.select(F.struct("source", "doc_id", "h", "size", "copies", "taken").alias("__mix"))
    rows_ = docs.select(F.struct("*").alias("__row"), F.xxhash64(*marks).alias("__h"))
    r, k = F.col("__row"), F.col("__mix")
    kept = rows_.join(m, r["source"].eqNullSafe(k["source"]) & r["doc_id"].eqNullSafe(k["doc_id"]) & (F.col("__h") == k["h"]))
    again = kept.where(k["copies"] > 1).groupBy("__mix").agg(F.first("__row").alias("__row"))
    flat = lambda x: x.select("__row", k["size"].alias("__size"), k["taken"].alias("__taken"), F.ceil(k["taken"] / k["size"]).alias("__times"))
    out = flat(kept.where(k["copies"] == 1)).unionByName(flat(again))
    whole, rest = F.floor(F.col("__taken") / F.col("__size")), F.col("__taken") % F.col("__size")
    out = out.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__times") - 1) / STEP))))
    out = out.withColumn("__time", F.explode(F.sequence(F.col("__c") * STEP + 1, F.least("__times", (F.col("__c") + 1) * STEP))))
    first_words = F.array_join(F.slice(F.split(r["text"], WORD_END), F.lit(1), rest.cast("int")), "")
    text = F.when(F.col("__time") <= whole, r["text"]).otherwise(first_words)
    return out.select(r.withField("text", text).alias("__row")).select("__row.*")
