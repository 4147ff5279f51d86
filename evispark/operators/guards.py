"""Guards over answers: citations, coverage, limits, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citation_violation() -> Column:
    """First violation of an answer row (status, claims[text, evidence_ids], delivered ids), or null."""
    cited = F.flatten(F.transform("claims", lambda c: c["evidence_ids"]))
    return (
        F.when(F.size(F.array_except(cited, F.col("delivered"))) > 0, "citation_outside_delivered")
        .when(F.exists("claims", lambda c: F.size(c["evidence_ids"]) == 0), "claim_without_citation")
        .when(F.exists("claims", lambda c: F.trim(c["text"]) == ""), "claim_without_text")
        .when((F.col("status") == "supported") & (F.size("claims") == 0), "supported_without_claims")
    )


def guard(answers: DataFrame) -> DataFrame:
    return answers.withColumn("violation", citation_violation())


def guard_action(needs_scope: Column, absent: Column, complete: Column, missing: Column, budget_left: Column) -> Column:
    return (
        F.when(missing & ~budget_left, "tool_budget_exhausted")
        .when(missing, "requested_evidence_missing")
        .when((needs_scope | absent) & ~complete, "coverage_unverified")
        .otherwise("none")
    )


def limit_answer(answers: DataFrame, most: int = 3, chars: int = 400) -> DataFrame:
    """Down-graded answers: an explained partial keeps its claims, others keep ``most`` excerpts; limitations are united."""
    cut = F.transform(F.slice("claims", 1, most), lambda c: F.left(c["text"], F.lit(chars)))
    whole = F.transform("claims", lambda c: c["text"])
    kept = F.when((F.col("status") == "partial") & (F.size("limitations") > 0), whole).otherwise(cut)
    return answers.select("id", F.lit("partial").alias("status"), F.array_join(kept, "\n").alias("answer"), F.array_join(F.array_sort(F.array_union("limitations", F.array(F.lit("coverage_unverified")))), ",").alias("limitations"))


def render_answer(answers: DataFrame, most: int = 32_000) -> DataFrame:
    text = F.array_join(F.transform("claims", lambda c: c["text"]), "\n")
    cites = F.array_sort(F.array_distinct(F.flatten(F.transform("claims", lambda c: c["evidence_ids"]))))
    return answers.select("id", F.left(text, F.lit(most)).alias("answer"), F.array_join(cites, ",").alias("citations"))


def answers_markdown(answers: DataFrame) -> DataFrame:
    """id, markdown: title, prose, source bullets, limitations."""
    bullets = F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform("claims", lambda c: c["evidence_ids"])))), lambda i: F.concat(F.lit("- span "), i.cast("string"))), "\n")
    prose = F.array_join(F.transform("claims", lambda c: c["text"]), "\n")
    limits = F.when(F.size("limitations") > 0, F.concat(F.lit("\n\nLimitations: "), F.array_join("limitations", "; "))).otherwise("")
    return answers.select("id", F.concat(F.lit("# Answer "), F.col("id").cast("string"), F.lit("\n\n"), prose, F.lit("\n\n"), bullets, limits).alias("markdown"))


def conform(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds violations: names of the rules that a row breaks (null counts as broken)."""
    return rows.withColumn("violations", F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])), ","))
