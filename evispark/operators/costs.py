"""Token costs in exact decimals. Unknown is never zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dollars for a million tokens, and the limit above which a context is long.
PRICES = (("gpt-6-sol", "2.00", "0.20", "10.00"), ("gpt-6-luna", "0.10", "0.01", "0.50"))
LONG_CONTEXT = 272_000
USD = "decimal(38,12)"


def price_table(spark) -> DataFrame:
    rows = spark.createDataFrame(list(PRICES), "model string, a string, b string, c string")
    return rows.select("model", *[F.col(x).cast("decimal(18,9)").alias(y) for x, y in (("a", "p_input"), ("b", "p_cached"), ("c", "p_output"))])


def call_cost(calls: DataFrame, prices: DataFrame | None = None, limit: int = LONG_CONTEXT) -> DataFrame:
    """Adds cost (null if unknown) and limitation (why). The order of the checks decides the label. The fixed price list has a few rows; a caller's own is joined as its size calls for."""
    j = calls.join(F.broadcast(price_table(calls.sparkSession)) if prices is None else prices, "model", "left")
    parts = ("input_tokens", "cached_tokens", "write_tokens", "output_tokens")
    bad = F.lit(False)
    for c in parts:
        bad = bad | F.col(c).isNull() | F.coalesce(F.col(c) < 0, F.lit(False))
    why = F.when(F.col("p_input").isNull(), "unsupported_model").when(bad, "missing_or_invalid_bucket").when(F.col("cached_tokens") + F.col("write_tokens") > F.col("input_tokens"), "partitions_exceed_total").when(F.col("write_tokens") > 0, "cache_write_unverified")
    long = F.col("input_tokens") > limit
    million = F.lit("0.000001").cast("decimal(7,6)")
    amount = lambda n, p: (n.cast("decimal(12,0)") * F.col(p) * million).cast(USD)
    base = amount(F.col("input_tokens") - F.col("cached_tokens"), "p_input") + amount(F.col("cached_tokens"), "p_cached")
    out = amount(F.col("output_tokens"), "p_output")
    cost = F.when(long, (base * 2 + out * F.lit("1.5").cast("decimal(2,1)")).cast(USD)).otherwise((base + out).cast(USD))
    return j.withColumn("limitation", why).withColumn("cost", F.when(F.col("limitation").isNull(), cost)).drop("p_input", "p_cached", "p_output")


def cost_group(costs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, known, subtotal, total (null if any call is unknown)."""
    g = costs.groupBy(*by).agg(F.count("*").alias("n"), F.count("cost").alias("known"), F.sum("cost").cast(USD).alias("subtotal"))
    return g.withColumn("total", F.when(F.col("n") == F.col("known"), F.col("subtotal")))


def combine_costs(costs: DataFrame, outer: str, inner: str) -> DataFrame:
    """Cost groups rolled up: cells, campaigns (null inner) and all (both null)."""
    g = costs.rollup(outer, inner).agg(F.count("*").alias("n"), F.count("cost").alias("known"), F.sum("cost").cast(USD).alias("subtotal"), F.grouping_id().cast("int").alias("level"))
    return g.withColumn("total", F.when(F.col("n") == F.col("known"), F.col("subtotal")))


def attempt_cost(attempts: DataFrame, costs: DataFrame) -> DataFrame:
    """attempt_id, n_runs, n, known, total: distinct runs of each attempt's history, every call of theirs priced once."""
    runs = attempts.select("attempt_id", F.explode(F.array_distinct("run_ids")).alias("run"))
    g = runs.join(costs, "run", "left").groupBy("attempt_id").agg(F.countDistinct("run").alias("n_runs"), F.count("call").alias("n"), F.count("cost").alias("known"), F.sum("cost").cast(USD).alias("subtotal"))
    return g.withColumn("total", F.when((F.col("n") > 0) & (F.col("n") == F.col("known")), F.col("subtotal"))).drop("subtotal")
