"""Chat formatting: cumulative-snapshot collapse, then rendering. Native DataFrame code only.

Chat logs often hold a snapshot of the conversation after every turn. Each conversation gets a rolling hash after each of
its turns: the sums, over the turns so far, of two 60-bit hashes of the turn's number and content (SHA-256). So a prefix's hash
follows from the one before by addition, and hashes of stretches of turns add up: conversations are laid out in ranges of
(conversation, turn), each range is summed for itself, and the sums of the ranges before are added, a row a range. A
conversation of any length, or the one of all null ids, is spread over many tasks, and no conversation is gathered to be hashed.

A conversation whose last hash is a hash inside a longer one is a prefix of it. Equal conversations are first reduced to the
smallest id; anti-joins on the hashes then leave the maximal ones, which are rendered: only these are gathered, as each is one
text.

Defined cases: turns are ordered by (turn, role, text), nulls first, and repeated rows are turns of their own; a null role
is rendered as ``unknown`` and null text as empty, but neither equals the empty string in a hash; rows with null conv_id
form one conversation with null id; very long conversations are hashed in linear time; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Hex digits of a hash half: 60 bits, so that sums of up to 10^19 turns fit a decimal.
HALF = 15


def snapshots(messages: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, k (its number, from 1), n (turns of the conversation), p1, p2 (the hash up to it). Texts are
    shuffled once, to be laid out; from then on a turn is the digest of its content."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.sha2(c, 256)), F.lit("n"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    m = messages.select("conv_id", "turn", "role", "text", F.unhex(F.sha2(F.concat(part("role"), part("text")), 256)).alias("key"))
    spread = max(messages.sparkSession.sparkContext.defaultParallelism, int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = m.repartitionByRange(spread, F.col("conv_id").asc_nulls_first(), *order).withColumn("part", F.spark_partition_id())
    laid = laid.withColumn("place", F.row_number().over(W.partitionBy("part", "conv_id").orderBy(*order)))
    laid = saved(laid.select("conv_id", "part", "place", "key"), "turns")

    def before(df, columns):
        """Sums of the parts before, a row a part of a conversation."""
        w = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        sums = df.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in columns])
        zero = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in columns]
        return sums.select(F.col("conv_id").alias("c_"), F.col("part").alias("part_"), *zero, *[F.sum(c).over(W.partitionBy("conv_id")).alias(f"{c}_all") for c in columns])

    def offset(df, sums):
        return df.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("part_"))).drop("c_", "part_")

    numbered = offset(laid, before(laid.withColumn("one", F.lit(1).cast("long")), ["one"]))
    numbered = numbered.withColumn("k", F.col("place") + F.col("one_before")).withColumn("n", F.col("one_all")).drop("one_before", "one_all")
    digest = F.sha2(F.concat(F.encode(F.col("k").cast("string"), "utf-8"), F.lit(b"|"), F.col("key")), 256)
    number = lambda at: F.conv(F.substring(digest, at, HALF), 16, 10).cast("decimal(38,0)")
    hashed = numbered.withColumn("h1", number(1)).withColumn("h2", number(1 + HALF))
    hashed = saved(hashed.select("conv_id", "part", "k", "n", "h1", "h2"), "hashes")
    upto = W.partitionBy("part", "conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    local = hashed.select("conv_id", "part", "k", "n", *[F.sum(h).over(upto).alias(h) for h in ("h1", "h2")])
    rolled = offset(local, before(hashed, ["h1", "h2"]))
    total = lambda h: (F.col(h) + F.col(f"{h}_before")).cast("decimal(38,0)")
    return rolled.select("conv_id", "k", "n", total("h1").alias("p1"), total("h2").alias("p2"))


def collapse(messages: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id (smallest of equal ones), n_turns, n_copies (equal conversations, itself included)."""
    hashes = saved(snapshots(messages), "prefixes")
    # the smallest id of each group of equal conversations; null counts as the largest
    firsts = hashes.where("k = n").groupBy("k", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = hashes.where("k < n").select("k", "p1", "p2")
    return firsts.join(inner, ["k", "p1", "p2"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def chat_format(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: maximal conversations, each turn rendered as ``<|role|>`` line, text line, end mark."""
    kept = collapse(messages).select(F.col("conv_id").alias("keep"), "n_turns", "n_copies")
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n<|end|>\n"))
    turns = messages.select("conv_id", F.struct("turn", "role", "text").alias("t")).join(kept, F.col("conv_id").eqNullSafe(F.col("keep")))
    whole = turns.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return whole.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join(F.transform("turns", line), "").alias("chat"))


ORACLE = """
WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text FROM conversations),
p AS (SELECT conv_id, k, string_agg(coalesce('v' || sha256(role), 'n') || coalesce('v' || sha256(text), 'n'), ';') OVER (PARTITION BY conv_id ORDER BY k) || ';' AS prefix,
      string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY k) AS chat,
      count(*) OVER (PARTITION BY conv_id) AS n FROM m),
whole AS (SELECT * FROM p WHERE k = n),
kept AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY prefix)
SELECT w.conv_id, w.n::BIGINT AS n_turns, kept.n_copies::BIGINT AS n_copies, w.chat FROM kept JOIN whole w ON w.prefix = kept.prefix AND w.conv_id IS NOT DISTINCT FROM kept.conv_id
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.prefix = kept.prefix)"""
