"""Spelling variant grouping: words one edit apart by asymmetric q-chunks, each word led to its commonest near form. DataFrame code.

Of two words one edit apart let s be the shorter (or the first by code points) and r the other, 0 or 1 code point longer. s
contributes two disjoint chunks, its halves; r contributes, for each length a partner may have, its positional grams of the
chunks' lengths. One edit lies in one half of s, so the other half stands in r unchanged: the first at the same place, the second
shifted by the difference in length (0 or 1). Grams elsewhere can meet no chunk within shift one and are not emitted. The join is
on the gram, its place and the lengths; what it pairs is verified by edit distance.

Common chunks are split, not capped: where a chunk brings together more than ``bucket`` x ``bucket`` pairs, the part of the words
outside the chunk is again halved, and two new chunks join the one that is shared (so again one of them is unchanged), until few
enough words are left or the part is one code point long. Then all words of a bucket differ at that place only and are near each
other, as many as the alphabet allows. The bucket sizes are counted by an aggregation; no group is ever collected.

Forms: a word's form is its near word of largest count (ties: smallest by code points), if that count is at least ``ratio`` times
its own. Counts grow along forms, so chains end; roots are found by pointer doubling, in log2 of the chain's length rounds.

Defined cases: null or empty texts have no words; a null doc_id is hashed as nothing and no letter is deleted from its words; very
long texts and words are taken whole; repeated rows count again; ties as stated; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of these are words; one word in DELETE_EVERY loses a letter.
LETTERS, DELETE_EVERY = r"[A-Za-zÀ-ÿ]+", 97
SHORTEST, FEWEST, RATIO, BUCKET = 5, 3, 2, 64


def runs(docs: DataFrame) -> DataFrame:
    """word: every run of letters of every text, lower-cased (A-Z), a row each; of some a letter is deleted, as their digest asks."""
    found = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), 0)).alias("run"))
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary"))
    hashed = found.withColumn("h", h).withColumn("size", F.length("run"))
    place = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.col("size")))
    return hashed.select(F.when(F.col("h") % DELETE_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word, n: the words of ``shortest`` code points or more that stand ``fewest`` times or more."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


#: A row is a word in a role: word, n, size (code points of the shorter word), more (0 or 1: by how much the other is longer),
#: lo and hi (the shorter word's part that is still open), long (whether this is the longer word).
_ROLE = ["word", "n", "size", "more", "lo", "hi", "long"]


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its open part as a chunk (the second stays open), and the other way round."""
    mid = F.col("lo") + ((F.col("hi") - F.col("lo")) / 2).cast("int")
    open_parts = F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi")))
    return rows.withColumn("__open", F.explode(open_parts)).withColumn("lo", F.col("__open.lo")).withColumn("hi", F.col("__open.hi")).drop("__open")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with gram: what stands before and after the open part. In a longer word it is open for one code point more."""
    after = F.col("hi") + F.when(F.col("long"), F.col("more")).otherwise(0)
    return rows.withColumn("gram", F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit(" "), F.substring("word", after + 1, F.length("word"))))


_KEY = ["gram", "size", "more", "lo", "hi"]


def near_pairs(vocab: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """s, s_n, r, r_n: each pair of words (word, n) that differ by exactly one inserted, deleted or replaced code point, once."""
    w = vocab.select("word", "n", F.length("word").alias("size"))
    shape = F.array(*[F.struct(F.lit(more).alias("more"), F.lit(long).alias("long")) for more, long in ((0, False), (1, False), (1, True))])
    rows = w.withColumn("__s", F.explode(shape)).select("word", "n", (F.col("size") - F.when(F.col("__s.long"), 1).otherwise(0)).alias("size"), "__s.more", F.lit(0).alias("lo"), F.col("__s.long").alias("long"))
    rows = rows.withColumn("hi", F.col("size")).select(*_ROLE)
    found = None
    while True:
        keyed = saved(_keyed(_halved(rows)), "grams")
        n, longer = F.count("*"), F.count_if("long")
        pairs = F.when(F.col("more") == 0, n * (n - 1) / 2).otherwise(longer * (n - longer))
        common = saved(keyed.groupBy(*_KEY).agg(pairs.alias("pairs")).where((F.col("pairs") > bucket * bucket) & (F.col("hi") - F.col("lo") > 1)).select(*_KEY), "common")
        some = not common.isEmpty()
        small = keyed.join(common, _KEY, "left_anti") if some else keyed
        s = small.where(~F.col("long")).select(*_KEY, F.col("word").alias("s"), F.col("n").alias("s_n"))
        r = small.where(F.col("long") | (F.col("more") == 0)).select(*_KEY, F.col("word").alias("r"), F.col("n").alias("r_n"))
        met = s.join(r, _KEY).where((F.col("more") == 1) | (F.col("s") < F.col("r")))
        met = met.where(F.levenshtein("s", "r", 1) == 1).select("s", "s_n", "r", "r_n").distinct()
        found = saved(met, "pairs") if found is None else found.union(saved(met, "pairs"))
        if not some:
            return found.distinct()
        rows = keyed.join(common, _KEY, "left_semi").select(*_ROLE)


def forms(vocab: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n for each word of the vocabulary."""
    both = pairs.select(F.col("s").alias("word"), F.struct((-F.col("r_n")).alias("minus"), F.col("r").alias("form")).alias("near"))
    both = both.union(pairs.select("r", F.struct((-F.col("s_n")).alias("minus"), F.col("s").alias("form"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    joined = vocab.join(best, "word", "left")
    led = -F.col("near.minus") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("near.form")).alias("form"), F.when(led, -F.col("near.minus")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of each word that has a form: the last of its chain of forms."""
    chain = saved(formed.where("form is not null").select("word", F.col("form").alias("root")), "chain")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = saved(chain.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chain")
        chain = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return chain


def variants(words: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word (a row for each time it stands) that is long and common enough."""
    vocab = saved(vocabulary(words, shortest, fewest), "vocabulary")
    formed = saved(forms(vocab, near_pairs(vocab, bucket), ratio), "forms")
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the runs of letters of documents."""
    return variants(runs(docs))
