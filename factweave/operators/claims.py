"""Claims are accepted if the metrics they cite, or the report's own price and target, support every number they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calc, text

# Kinds of claims; others count as OUTLOOK.
CLAIM_TYPES = ("THESIS", "OUTLOOK", "VALUATION", "RISK", "PERFORMANCE", "COMPARISON")


def literals(claims: DataFrame) -> DataFrame:
    """(claim_id, n, literal): the numbers of each claim in order."""
    rows = claims.select("claim_id", F.posexplode(text.numbers_in(F.trim("text"))).alias("n", "literal"))
    return rows.withColumn("number", F.col("literal").try_cast("decimal(20,4)"))


def cited(claims: DataFrame, metrics: DataFrame) -> DataFrame:
    """(claim_id, ord, metric columns) of the ids that exist."""
    rows = claims.select("claim_id", F.posexplode("cited_metric_ids").alias("ord", "metric_id"))
    return rows.join(metrics, "metric_id")


def supported(numbers: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct (claim_id, n) that a cited value (1 %), growth or margin (2 %) supports.

    All joins are on the claim, with the tolerance as a residual condition.
    """
    near = lambda value, tolerance: calc.agrees(F.col(value), F.col("number"), tolerance)
    direct = numbers.join(facts, "claim_id").where(near("value", 0.01)).select("claim_id", "n")
    w = Window.partitionBy("claim_id", "taxonomy_key").orderBy("period_sort_key", "ord")
    grown = facts.withColumn("g", calc.growth(F.col("value"), F.lag("value").over(w))["value"]).where("g is not null").select("claim_id", "g")
    by_growth = numbers.join(grown, "claim_id").where(near("g", 0.02)).select("claim_id", "n")
    sales = facts.where("taxonomy_key = 'revenue'").groupBy("claim_id").agg(F.min(F.struct("ord", "value")).alias("r"))
    shares = facts.join(sales, "claim_id").where("ord != r.ord").withColumn("m", calc.margin(F.col("value"), F.col("r.value"))["value"]).where("m is not null").select("claim_id", "m")
    by_margin = numbers.join(shares, "claim_id").where(near("m", 0.02)).select("claim_id", "n")
    return direct.unionByName(by_growth).unionByName(by_margin).distinct()


def with_upside(numbers: DataFrame, valuations: DataFrame) -> DataFrame:
    """(claim_id, n) that the report's own implied upside supports (2 %)."""
    up = valuations.withColumn("u", calc.upside(F.col("base_target"), F.col("cmp"))["value"]).where("u is not null").select("claim_id", "u")
    return numbers.join(up, "claim_id").where(calc.agrees(F.col("u"), F.col("number"), 0.02)).select("claim_id", "n").distinct()


def prompt_rows(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` rows of each report in input order (60 facts and 8 risks, as the original asks the model)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("_r") <= most).drop("_r")


def claim_kind(kind: Column) -> Column:
    up = F.upper(kind)
    return F.when(up.isin(*CLAIM_TYPES), up).otherwise("OUTLOOK")


def verify(claims: DataFrame, metrics: DataFrame, valuations: DataFrame | None = None) -> DataFrame:
    """claim_id, claim_type, n_numbers, n_unsupported, accepted and the reason of a rejection; blank claims go.

    ``valuations`` (claim_id, base_target, cmp) are those of each claim's report.
    """
    claims = claims.where(F.trim("text") != "")
    numbers, facts = literals(claims), cited(claims, metrics)
    backed = supported(numbers, facts)
    backed = backed if valuations is None else backed.unionByName(with_upside(numbers, valuations))
    lost = numbers.join(backed, ["claim_id", "n"], "left_anti").groupBy("claim_id").agg(F.count("*").alias("n_unsupported"))
    counts = numbers.groupBy("claim_id").agg(F.count("*").alias("n_numbers"))
    valid = facts.groupBy("claim_id").agg(F.count("*").alias("n_cited"))
    rows = claims.join(counts, "claim_id", "left").join(lost, "claim_id", "left").join(valid, "claim_id", "left").fillna(0, ["n_numbers", "n_unsupported", "n_cited"])
    bad = F.col("n_unsupported") > 0
    reason = F.when(bad & (F.col("n_cited") == 0), "no valid citation").when(bad, "not supported by citations")
    return rows.select("claim_id", claim_kind(F.col("claim_type")).alias("claim_type"), "n_numbers", "n_unsupported", (~bad).alias("accepted"), reason.alias("reason"))
