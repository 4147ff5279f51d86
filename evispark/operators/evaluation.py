"""Evaluation: judge state, strict success, rates with explicit denominators, slices, paired comparison, bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ratio


def judge_coverage(gold: str = "gold_ids", reviewed: str = "reviewed_ids", claims: str = "claim_count", indices: str = "claim_indices") -> Column:
    """Every declared item is reviewed exactly once: multiset equality; negative indices are unlisted prose and don't count."""
    declared = F.when(F.col(claims) > 0, F.sequence(F.lit(0), F.col(claims) - 1)).otherwise(F.array().cast("array<int>"))
    listed = F.array_sort(F.filter(indices, lambda i: i >= 0))
    return (F.size(gold) == F.size(F.array_distinct(gold))) & (F.array_sort(gold) == F.array_sort(reviewed)) & (listed == declared)


def judge_state(rows: DataFrame) -> DataFrame:
    """Adds judge_state and na_reason: six rules in order of precedence."""
    given = F.col("judge_na_reason")
    reason = (
        F.when(F.col("state") != "completed", F.coalesce(given, "state"))
        .when(F.col("verdict").isNull(), F.coalesce(given, F.lit("missing_judge")))
        .when(F.col("verdict") == "not_assessable", F.coalesce(given, F.lit("judge_not_assessable")))
        .when(~F.col("coverage"), F.lit("invalid_judge_coverage"))
    )
    return rows.withColumn("na_reason", reason).withColumn("judge_state", F.when(F.col("na_reason").isNull(), "assessable").otherwise("not_assessable"))


def confirmed(rows: DataFrame) -> DataFrame:
    """Adds success: every condition of the strict gate holds; an unassessable case is no success."""
    ok = (
        (F.col("judge_state") == "assessable") & (F.col("verdict") == "pass") & F.col("answer_status").eqNullSafe(F.col("gold_status"))
        & F.col("status_correct") & F.col("coverage_valid") & ~F.coalesce("severity", F.lit("")).isin("S0", "S1")
        & F.forall("claim_indices", lambda i: i >= 0) & F.forall("claim_labels", lambda x: x == "supported")
        & F.forall("gold_labels", lambda x: x == "present") & F.forall("edge_labels", lambda x: x.isin("useful", "redundant")) & F.col("machine_ok")
    )
    return rows.withColumn("success", F.coalesce(ok, F.lit(False)))


def core_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Planned, completed, assessable and successful cases, and their ratios; failed rows stay in the planned population."""
    g = rows.groupBy(*by).agg(
        F.count("*").alias("planned"), F.count_if(F.col("state") == "completed").alias("completed"),
        F.count_if(F.col("judge_state") == "assessable").alias("assessable"), F.count_if("success").alias("successes"),
    )
    r = lambda n, d: F.round(ratio(F.col(n), F.col(d)), 6)
    return g.withColumn("completion", r("completed", "planned")).withColumn("success_rate", r("successes", "planned")).withColumn("conditional_success", r("successes", "assessable"))


def slices(rows: DataFrame, fields: list[str], many: list[str] = ()) -> DataFrame:
    """Slices with overlapping membership: a row counts in each value of each field (array fields explode); never sum over slices."""
    pairs = [F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields]
    named = lambda f: lambda v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    pairs = [F.array(*pairs)] + [F.transform(F.array_distinct(f), named(f)) for f in many]
    x = rows.withColumn("_s", F.explode(F.concat(*pairs))).select("*", "_s.field", "_s.value")
    return core_rates(x, ["field", "value"])


def macro(sliced: DataFrame) -> DataFrame:
    """Unweighted mean of the slices' success rates for each field."""
    return sliced.groupBy("field").agg(F.round(F.avg("success_rate"), 6).alias("macro"), F.count("*").alias("n_slices"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gold_status", F.coalesce("answer_status", F.lit("missing")).alias("answer_status")).agg(F.count("*").alias("n"))


def label_rates(rows: DataFrame, labels: str, good: list[str], assessable: list[str]) -> DataFrame:
    """In one pass over nested reviews: good, assessable, all, NA; conditional and conservative ratios."""
    a = F.sum(F.size(F.filter(labels, lambda x: x.isin(*assessable)))).alias("assessed")
    g = F.sum(F.size(F.filter(labels, lambda x: x.isin(*good)))).alias("good")
    t = rows.agg(g, a, F.sum(F.size(labels)).alias("total"))
    return t.select("good", "assessed", "total", (F.col("total") - F.col("assessed")).alias("na"), F.round(ratio(F.col("good"), F.col("assessed")), 6).alias("conditional"), F.round(ratio(F.col("good"), F.col("total")), 6).alias("conservative"))


def option_available(option: Column, available: Column) -> Column:
    """A non-empty evidence option all of whose ids are available."""
    return (F.size(option) > 0) & (F.size(F.array_except(option, available)) == 0)


def evidence_availability(rows: DataFrame) -> DataFrame:
    """case_id, known, claims_ok, case_ok: a claim has an available option; a case has all its claims; null where the inventory is unknown."""
    claim = F.transform("claims", lambda c: F.exists(c, lambda o: option_available(o, F.col("available"))))
    ok = F.when(F.col("available").isNotNull(), F.forall(claim, lambda x: x))
    return rows.select("case_id", F.col("available").isNotNull().alias("known"), F.when(F.col("available").isNotNull(), F.size(F.filter(claim, lambda x: x))).cast("long").alias("claims_ok"), ok.alias("case_ok"))


def receipt_rate(rows: DataFrame, flag: str) -> DataFrame:
    """Complete receipts among the known ones; unknown ones are counted apart."""
    g = rows.agg(F.count_if(flag).alias("complete"), F.count(flag).alias("known"), F.count("*").alias("n"))
    return g.select("complete", "known", (F.col("n") - F.col("known")).alias("unknown"), F.round(ratio(F.col("complete"), F.col("known")), 6).alias("rate"))


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n for several counters in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def pair_cells(a: DataFrame, b: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """key, in_a, in_b, same: full outer pairing of two cells with what must agree."""
    x = a.select(F.col(key).alias("ka"), *[F.col(f).alias(f"a_{f}") for f in facts], F.lit(True).alias("ia"))
    y = b.select(F.col(key).alias("kb"), *[F.col(f).alias(f"b_{f}") for f in facts], F.lit(True).alias("ib"))
    j = x.join(y, F.col("ka") == F.col("kb"), "full_outer")
    same = F.lit(True)
    for f in facts:
        same = same & F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))
    return j.select(F.coalesce("ka", "kb").alias(key), F.coalesce("ia", F.lit(False)).alias("in_a"), F.coalesce("ib", F.lit(False)).alias("in_b"), same.alias("same"))


def paired(pairs: DataFrame) -> DataFrame:
    """n, rates, gained, lost, difference in percentage points, of (success_a, success_b) pairs."""
    g = pairs.agg(F.count("*").alias("n"), F.count_if("success_a").alias("a"), F.count_if("success_b").alias("b"), F.count_if(~F.col("success_a") & F.col("success_b")).alias("gained"), F.count_if(F.col("success_a") & ~F.col("success_b")).alias("lost"))
    return g.withColumn("points", F.round(100 * ratio(F.col("b") - F.col("a"), F.col("n")), 6))


def bootstrap_ci(pairs: DataFrame, family: str, seed: str, reps: int = 1000) -> DataFrame:
    """low, high: percentile interval of the change, families resampled with replacement; divides by the drawn families' cases.

    Draw d of replicate r takes family number hex(md5(seed|r|d))[:8] mod families, so every engine draws alike.
    """
    f = pairs.groupBy(family).agg(F.sum(F.col("success_b").cast("int") - F.col("success_a").cast("int")).alias("change"), F.count("*").alias("size"))
    f = f.withColumn("k", F.row_number().over(W.orderBy(family)) - 1)  # a row for each family
    n = f.count()
    draws = pairs.sparkSession.range(reps).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("d"))
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("r").cast("string"), F.col("d").cast("string"))), 1, 8), 16, 10).cast("long") % max(n, 1)
    each = draws.select("r", pick.alias("k")).join(f, "k").groupBy("r").agg((F.sum("change") / F.sum("size")).alias("x"))
    return each.agg(F.round(100 * F.percentile("x", 0.025), 6).alias("low"), F.round(100 * F.percentile("x", 0.975), 6).alias("high"))


def execution_order(cases: DataFrame, cells: list[str]) -> DataFrame:
    """Balanced design: cases in family order, their cells rotated by the family's number."""
    n = len(cells)
    fam = cases.select("family").distinct().withColumn("fi", F.row_number().over(W.orderBy("family")) - 1)
    c = cases.join(fam, "family").withColumn("ci", F.row_number().over(W.partitionBy("family").orderBy("case_id")) - 1)
    x = c.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return x.select("family", "case_id", "slot", F.element_at(F.array(*map(F.lit, cells)), F.pmod(F.col("slot") + F.col("fi") + F.col("ci"), F.lit(n)) + 1).alias("cell"))


def resolve_locators(locators: DataFrame, spans: DataFrame) -> DataFrame:
    """loc, n, line_no: optional constraints restrict only where given; a locator must match exactly one span.

    Spans are counted for each set of constraints, so that a locator without any meets a count and not all lines.
    """
    case = lambda line, section: line.isNotNull().cast("int") + 2 * section.isNotNull().cast("int")
    each = spans.select("doc_id", "line_no", "section", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("case"))
    keys = [F.col("doc_id").alias("d"), F.col("case").alias("c"), F.when(F.col("case").isin(1, 3), F.col("line_no")).alias("ln"), F.when(F.col("case").isin(2, 3), F.col("section")).alias("sec")]
    counted = each.groupBy(*keys).agg(F.count("*").alias("k"), F.min("line_no").alias("least"))
    j = locators.withColumn("c2", case(F.col("line_no"), F.col("prefix_section")))
    j = j.join(counted, (F.col("doc_id") == F.col("d")) & (F.col("c2") == F.col("c")) & F.col("line_no").eqNullSafe(F.col("ln")) & F.col("prefix_section").eqNullSafe(F.col("sec")), "left")
    return j.select("loc", F.coalesce("k", F.lit(0)).alias("n"), F.when(F.col("k") == 1, F.col("least")).alias("line_no"))


#: Quotes of so few words that they have no whole word inside are looked for in every text, so many at a time.
SHORT_QUOTES_AT_ONCE, QUOTES_TO_BROADCAST = 1000, 100_000


def quote_support(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id, doc_id: texts that hold a quote, white space normalised.

    A quote's ends may be parts of words, so its key is the 5-gram (with 3 to 6 words: the word) after its first word. Texts'
    keys that no quote has are dropped before anything is shuffled; ``contains`` decides on the texts of the candidates.
    """
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    q = quotes.select("item_id", norm(F.col("text")).alias("quote")).withColumn("qs", F.split("quote", " "))
    n = F.size("qs")
    keyed = q.where(n >= 3).select("item_id", "quote", F.xxhash64(F.when(n >= 7, F.array_join(F.slice("qs", 2, 5), " ")).otherwise(F.get("qs", F.lit(1)))).alias("g"))
    d = texts.select("doc_id", norm(F.col("text")).alias("t"))
    # the words are an argument of the outer function, so that they are split once and not for every gram
    grams = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, F.lit(5)), " ")))
    single = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    both = F.flatten(F.transform(F.array(F.split("t", " ")), lambda ws: F.array_distinct(F.concat(grams(ws), single(ws)))))
    keys, few = keyed.select("g").distinct(), keyed.count()
    probes = d.select("doc_id", F.explode(both).alias("g")).join(F.broadcast(keys) if few <= QUOTES_TO_BROADCAST else keys, "g", "left_semi")
    pairs = probes.join(keyed, "g").select("item_id", "quote", "doc_id")
    found = [pairs.join(d, "doc_id").where(F.contains("t", "quote")).select("item_id", "doc_id")]
    short = q.where(n < 3).select("item_id", "quote")
    blocks = -(-short.count() // SHORT_QUOTES_AT_ONCE)
    for b in range(blocks):
        some = short.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks)) == b)
        found.append(d.join(F.broadcast(some), F.contains("t", "quote")).select("item_id", "doc_id"))
    return reduce(DataFrame.unionAll, found).distinct()


def primary_latest(history: DataFrame) -> DataFrame:
    """The first attempt is frozen as primary, the last one is the latest; corrected if there is more than one."""
    return history.select("case_id", F.element_at("attempts", 1)["label"].alias("primary"), F.element_at("attempts", -1)["label"].alias("latest"), (F.size("attempts") > 1).alias("corrected"))
