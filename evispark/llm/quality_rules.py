"""Quality rules with adaptive thresholds. Native DataFrame code only.

Each document gets base counts and, from them, whole-number measures (``MEASURES``). For each language and source the measures
of the documents that pass the base rules are summed up in quantile sketches: histograms whose buckets keep the first six bits
of a value (relative error 1/32 at most), so that sketches of any parts of the data merge by adding counts. Sketches of a
language's sources merge into the language's, those into one of all documents. A group with fewer than ``least`` documents
uses its language's sketch; a language with fewer, that of all.

A measure is an outlier beyond a fence: the ``far`` percentile (or its mirror image) plus ``reach`` times its distance from the
median, and at least ``slack`` from the median. So fences move with each group's own median and spread instead of being fixed,
and as they rest on the middle half of a group, junk does not widen them. The fences are joined to the documents, and a document
beyond any of them is not kept.

Sketches are aggregated before they are shuffled, so a hot language or source costs no more than any other; the fences, a row a
group, are broadcast when there are ``BROADCAST_GROUPS`` or fewer (they are counted), else joined by shuffle, where AQE splits hot
groups.

Defined cases: null or empty texts have no words and fail the base rules; null languages and sources are groups of their own;
very long texts are counted whole; repeated rows each count and each give a row; ties need no order; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Base rules: fewest words, and the greatest share (percent) of words in repeated windows.
FEWEST_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: measure: (value from the counts, whether low values are outliers too, least distance of a fence from the median)
MEASURES = {
    "repeat_milli": ("n_repeat_words * 1000 div n_words", False, 200),
    "line_milli": ("n_dup_lines * 1000 div n_words", False, 20),
    "symbol_milli": ("n_symbols * 1000 div word_chars", False, 20),
    "length_centi": ("word_chars * 100 div n_words", True, 200),
}
FAR, REACH, LEAST = 75, 3, 200
BROADCAST_GROUPS = 100_000


def _let(value: Column, use) -> Column:
    """``use(value)``, the value being worked out once for each row."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that stands twice or more."""

    def exact(w):
        places = F.sequence(F.lit(0), F.size(w) - WINDOW)
        # windows in order, each with its place: equal ones are neighbours
        windows = F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("x"), i.alias("i"))))

        def again(s):
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["x"] == x["x"])) | ((k < last) & (F.get(s, k + 1)["x"] == x["x"])))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            # a window covers what it adds beyond the one before it
            return _let(at, lambda a: F.aggregate(F.transform(a, lambda i, k: F.when(k == 0, WINDOW).otherwise(F.least(i - F.get(a, k - 1), F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y))

        return _let(windows, again)

    def hashes(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    # equal windows have equal hashes: where all hashes differ nothing repeats, and nothing needs to be sorted
    return _let(words, lambda w: F.when(F.size(w) < WINDOW + 1, 0).otherwise(F.when(_let(hashes(w), lambda h: F.size(F.array_distinct(h)) == F.size(h)), 0).otherwise(exact(w))))


def counts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.col("__text")
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    plain = docs.select(*carry, "lang", "source", F.coalesce("text", F.lit("")).alias("__text"))
    made = plain.select(
        *carry, "lang", "source",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("__text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    n, again = F.col("w.n_words"), F.col("w.n_repeat_words")
    failed = (n < FEWEST_WORDS) | (100 * again > REPEATED_PERCENT * n)
    return made.select(*carry, "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", again.alias("n_repeat_words"), failed.alias("base_failed"))


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """A mergeable quantile sketch of ``value`` (a whole number, 0 or more) for each group: rows (*keys, bucket, n)."""
    low = F.greatest(F.length(F.bin("value")) - 6, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, __low), __low)")
    return values.withColumn("__low", low.cast("int")).withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts merged into one for each group of ``keys``."""
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], percents: dict[str, int]) -> DataFrame:
    """A row for each group: n and, for each named percentage, the smallest bucket that at least so many percent are up to."""
    # a sketch has some hundred rows whatever it sums up, so a group's window is small
    by = Window.partitionBy(*keys)
    up = sketches.select("*", F.sum("n").over(by.orderBy("bucket")).alias("up"), F.sum("n").over(by).alias("total"))
    return up.groupBy(*keys).agg(F.max("total").alias("n"), *[F.min(F.when(100 * F.col("up") >= p * F.col("total"), F.col("bucket"))).alias(name) for name, p in percents.items()])


def fences(counted: DataFrame, far: int = FAR, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """low and high of each measure (columns <measure>_low, <measure>_high) for each lang and source of the documents."""
    good = counted.where(~F.col("base_failed"))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(e).alias("value")) for m, (e, _, _) in MEASURES.items()])
    values = good.select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.measure", "p.value")
    by_source = saved(sketch(values, ["lang", "source", "measure"]), "sketches")
    by_lang = merged(by_source, ["lang", "measure"])
    spots = {"low": 100 - far, "mid": 50, "high": far}

    def named(sketches, keys, prefix):
        q = quantiles(sketches, [*keys, "measure"], spots)
        return q.select(*keys, "measure", F.struct("n", *spots).alias(prefix))

    groups = counted.select("lang", "source").distinct().crossJoin(F.broadcast(counted.sparkSession.createDataFrame([(m, two, slack) for m, (_, two, slack) in MEASURES.items()], "measure string, two boolean, slack long")))
    q1 = named(by_source, ["lang", "source"], "q1").withColumnsRenamed({"lang": "l1", "source": "s1", "measure": "m1"})
    q2 = named(by_lang, ["lang"], "q2").withColumnsRenamed({"lang": "l2", "measure": "m2"})
    q3 = named(merged(by_lang, ["measure"]), [], "q3").withColumnsRenamed({"measure": "m3"})
    all_of = groups.join(q1, F.col("lang").eqNullSafe(F.col("l1")) & F.col("source").eqNullSafe(F.col("s1")) & (F.col("measure") == F.col("m1")), "left")
    all_of = all_of.join(q2, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("measure") == F.col("m2")), "left").join(F.broadcast(q3), F.col("measure") == F.col("m3"), "left")
    q = F.when(F.col("q1.n") >= least, F.col("q1")).when(F.col("q2.n") >= least, F.col("q2")).otherwise(F.col("q3"))
    spread = all_of.select("lang", "source", "measure", "two", "slack", q.alias("q"))
    high = F.col("q.mid") + F.greatest((reach + 1) * (F.col("q.high") - F.col("q.mid")), F.col("slack"))
    low = F.when(F.col("two"), F.col("q.mid") - F.greatest((reach + 1) * (F.col("q.mid") - F.col("q.low")), F.col("slack")))
    one = spread.select("lang", "source", "measure", low.alias("low"), high.alias("high"))
    return one.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")])


def _within(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """Counted documents with their measures, their group's fences, and kept."""
    limits = limits.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    rows = counted.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))).drop("__lang", "__source")
    measured = rows.select("*", *[F.when(~F.col("base_failed"), F.expr(e)).alias(m) for m, (e, _, _) in MEASURES.items()])
    inside = ~F.col("base_failed")
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"{m}_high")) & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    return measured.withColumn("kept", F.coalesce(inside, F.lit(False)))


def judged(docs: DataFrame, far: int = FAR, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """The counts of each document, its measures, its group's fences, and kept: no base rule failed, no measure beyond a fence."""
    counted = saved(counts(docs), "counts")
    return _within(counted, saved(fences(counted, far, reach, least), "fences"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filtered(docs: DataFrame, far: int = FAR, reach: int = REACH, least: int = LEAST) -> DataFrame:
    """The documents that are kept, all columns as they were. Texts are counted once for the fences and once more to be judged,
    so that they need not be shuffled or written."""
    limits = saved(fences(saved(counts(docs), "counts"), far, reach, least), "fences")
    whole = docs.select(F.struct("*").alias("__row")).select("__row", *[F.col("__row")[c].alias(c) for c in ("lang", "source", "text")])
    return _within(counts(whole, ("__row",)), limits).where("kept").select("__row.*")


def oracle() -> str:
    """DuckDB SQL for ``quality_rules``."""
    measures = " union all ".join(f"select rid, lang, source, base_failed, '{m}' measure, {e.replace(' div ', ' // ')} v, {str(two).lower()} two, {slack} slack from c where not base_failed" for m, (e, two, slack) in MEASURES.items())
    spot = f"min(case when 100 * up >= {100 - FAR} * total then bucket end) lo, min(case when 100 * up >= 50 * total then bucket end) mid, min(case when 100 * up >= {FAR} * total then bucket end) hi, max(total) n"

    def level(name, keys):
        over = f"partition by {', '.join([*keys, 'measure'])}"
        return f"""{name} as (select {''.join(k + ', ' for k in keys)}measure, {spot} from (
            select *, sum(n) over ({over} order by bucket) up, sum(n) over ({over}) total
            from (select {''.join(k + ', ' for k in keys)}measure, bucket, count(*) n from b group by all)) group by {', '.join([*keys, 'measure'])})"""

    pick = ", ".join(f"case when q1.n >= {LEAST} then q1.{x} when q2.n >= {LEAST} then q2.{x} else q3.{x} end {x}" for x in ("lo", "mid", "hi"))
    return f"""with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
        w as (select rid, regexp_extract_all(t, '[^ \t-\r]+') ws from d),
        win as (select rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') x from (select rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i from w)),
        twice as (select rid, i from win qualify count(*) over (partition by rid, x) > 1),
        again as (select rid, sum(k) n from (select rid, least({WINDOW}, coalesce(i - lag(i) over (partition by rid order by i), {WINDOW})) k from twice) group by rid),
        l as (select rid, count(*) - count(distinct x) n from (select rid, unnest(string_split(t, chr(10))) x from d) where regexp_matches(x, '[^ \t-\r]') group by rid),
        k as (select d.rid, doc_id, lang, source, len(ws)::bigint n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::bigint word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, coalesce(l.n, 0)::bigint n_dup_lines, coalesce(again.n, 0)::bigint n_repeat_words
            from d join w on d.rid = w.rid left join l on d.rid = l.rid left join again on d.rid = again.rid),
        c as (select *, n_words < {FEWEST_WORDS} or 100 * n_repeat_words > {REPEATED_PERCENT} * n_words base_failed from k),
        m as ({measures}),
        b as (select *, (v >> greatest(length(bin(v)) - 6, 0)::int) << greatest(length(bin(v)) - 6, 0)::int bucket from m),
        {level('q1', ['lang', 'source'])}, {level('q2', ['lang'])}, {level('q3', [])},
        f as (select m.rid, v, two, slack, {pick} from m join q1 on m.lang is not distinct from q1.lang and m.source is not distinct from q1.source and m.measure = q1.measure
            join q2 on m.lang is not distinct from q2.lang and m.measure = q2.measure join q3 on m.measure = q3.measure),
        bad as (select distinct rid from f where v > mid + greatest({REACH + 1} * (hi - mid), slack) or (two and v < mid - greatest({REACH + 1} * (mid - lo), slack)))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.rid is null kept from c left join bad on c.rid = bad.rid"""
