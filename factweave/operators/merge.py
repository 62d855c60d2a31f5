"""Merging facts of several chunks: field fill, ordered metric fold, narrative dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calc, text, values


def normalise_metrics(facts: DataFrame, as_of_year: int) -> DataFrame:
    """Printed label, value and period become taxonomy key, decimal, currency, scale and canonical period."""
    # Exploded, so that each struct is computed once and not again for each of its fields.
    whole = F.struct(values.value_and_unit(F.col("raw_value")).alias("v"), values.parse_period(F.col("period"), as_of_year).alias("p"), values.taxonomy_key(F.col("label")).alias("k"))
    return (
        facts.withColumn("_x", F.explode(F.array(whole)))
        .select(
            *[c for c in facts.columns if c != "period"],
            F.col("_x.k").alias("taxonomy_key"),
            F.col("_x.v.value").alias("value"),
            F.col("_x.v.currency").alias("currency"),
            F.col("_x.v.scale").alias("scale"),
            F.coalesce(F.col("_x.p.label"), F.trim("period")).alias("period"),
            F.coalesce(F.col("_x.p.sort_key"), F.lit(0)).alias("period_sort_key"),
        )
    )


def fold_metrics(facts: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """One holder per key, by folding (chunk, item) in order; ``extra`` columns are the holder's, ``first`` is the place where the key was first seen.

    A later value that agrees with the holder is a duplicate, and takes its place on a better tier; one that
    disagrees is a conflict. The base of comparison moves with the holder, so the fold is
    order-dependent. It runs in one ordered array per key: the facts of one document and metric.
    """
    row = F.struct("chunk_idx", "item_idx", "value", "status", text.tier_rank(F.col("status")).alias("rank"), *(extra or []))
    # A window sorts the rows once and finds them dealt by a part of the keys; an aggregate of lists would sort them twice and each list again.
    same = Window.partitionBy(*keys).orderBy("_row")
    every = F.collect_list("_row").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    grouped = facts.select(*keys, row.alias("_row")).select(*keys, F.row_number().over(same).alias("_n"), every.alias("_rows")).where("_n = 1").drop("_n")
    one = grouped.schema["_rows"].dataType.elementType.simpleString()
    start = F.struct(F.get("_rows", F.lit(0)).alias("holder"), F.array().cast("array<decimal(20,4)>").alias("conflicts"), F.lit(0).alias("duplicates"))

    def step(acc: Column, r: Column) -> Column:
        def told(same: Column) -> Column:
            return F.struct(
                F.when(same & (r["rank"] > acc["holder"]["rank"]), r).otherwise(acc["holder"]).cast(one).alias("holder"),
                F.when(same, acc["conflicts"]).otherwise(F.concat(acc["conflicts"], F.array(r["value"]))).alias("conflicts"),
                (acc["duplicates"] + same.cast("int")).alias("duplicates"),
            )

        return values.let(calc.same_value(acc["holder"]["value"], r["value"]), told)

    rest = F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))
    folded = grouped.withColumn("_m", F.aggregate(rest, start, step))
    return folded.select(*keys, F.col("_m.holder.value").alias("value"), F.col("_m.holder.status").alias("status"), F.col("_m.conflicts").alias("conflicts"), F.size("_rows").alias("n_raw"), F.col("_m.duplicates").alias("n_duplicates"), F.size("_m.conflicts").alias("n_conflicts"), *([F.col("_rows")[0]["chunk_idx"].alias("first_chunk"), F.col("_rows")[0]["item_idx"].alias("first_item")] if extra else []), *(F.col(f"_m.holder.{c}").alias(c) for c in extra or []))


def conflict_issues(folded: DataFrame, keys: list[str]) -> DataFrame:
    """A BLOCKER for every value that the fold found in conflict with its holder; ``folded`` by ``keys``, taxonomy_key and period."""
    said = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("decimal(20,4)").cast("string"), "\\.?0+$", ""), F.lit("null"))
    rows = folded.withColumn("other", F.explode("conflicts"))
    mark = F.concat_ws(":", F.lit("conflict"), "taxonomy_key", F.coalesce("period", F.lit("null")), said("value"), said("other"))
    return rows.select(*keys, F.lit("CONTRADICTORY_METRIC_VALUE").alias("code"), F.lit("BLOCKER").alias("severity"), "taxonomy_key", "period", F.col("value").alias("kept"), "other", mark.alias("fingerprint"))


def fill_record(rows: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """First value by ``order`` that isn't blank, field by field."""
    full = lambda f: F.when(F.trim(f) != "", F.struct(order, F.col(f).alias("v")))
    return rows.groupBy(*keys).agg(*(F.min(full(f))["v"].alias(f) for f in fields))


def record_with_evidence(rows: DataFrame, keys: list[str], fields: list[str], order: str, status: str, evidence: list[str]) -> DataFrame:
    """As ``fill_record``, with ``status`` and ``evidence`` of the best evidenced among the rows that gave a field; ties go to the earliest."""
    full = lambda f: F.when(F.trim(f) != "", F.struct(F.col(order).alias("o"), F.col(f).alias("v")))
    told = F.struct(text.tier_rank(F.col(status)).alias("rank"), (-F.col(order)).alias("late"), F.col(order).alias("o"), status, *evidence)
    made = rows.groupBy(*keys).agg(*(F.min(full(f)).alias(f) for f in fields), F.collect_list(told).alias("_e"))
    gave = F.array(*(F.col(f)["o"] for f in fields))
    best = F.array_max(F.filter("_e", lambda e: F.array_contains(gave, e["o"])))
    return made.withColumn("_b", best).select(*keys, *(F.col(f)["v"].alias(f) for f in fields), F.col(f"_b.{status}").alias(status), *(F.col(f"_b.{c}").alias(c) for c in evidence))


def dedupe_narrative(rows: DataFrame, keys: list[str], title: str, body: str, status: str, order: str) -> DataFrame:
    """Best evidence per title and first 120 characters of the body; ``position`` is that of the first one seen."""
    same = [*keys, F.lower(F.trim(title)), F.left(F.lower(F.trim(body)), F.lit(120))]
    best = Window.partitionBy(*same).orderBy(text.tier_rank(F.col(status)).desc(), order)
    ranked = rows.withColumn("_r", F.row_number().over(best))  # first, so that both windows share one sort
    return ranked.withColumn("position", F.min(order).over(Window.partitionBy(*same))).where("_r = 1").drop("_r")


def first_evidence(rows: DataFrame, keys: list[str], page: str, quote: str, order: str) -> DataFrame:
    """First row per page and first 80 characters of the canonical quote; blank quotes go."""
    named = rows.withColumn("_q", F.left(text.canonical(F.col(quote), compose=False), F.lit(80))).where("_q != ''")
    return named.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, page, "_q").orderBy(order))).where("_r = 1").drop("_q", "_r")
