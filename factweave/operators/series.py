"""Period-continuous series: a missing value is a gap and never a zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values


def with_period(points: DataFrame, as_of_year: int) -> DataFrame:
    """Add ``p``, the period as a struct or null; the explode keeps it whole, so that its fields don't each compute it again."""
    return points.withColumn("p", F.explode(F.array(values.parse_period(F.col("period"), as_of_year))))


def parsed_points(points: DataFrame, as_of_year: int) -> DataFrame:
    """(series, ord, period, value, code) with the period read; points whose period can't be read go."""
    finite = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    rows = with_period(points, as_of_year).where("p is not null")
    return rows.select("series", "ord", "p.*", finite.alias("value"), F.coalesce("code", F.lit("U")).alias("code"), F.when(F.col("value").isNull(), "SYSTEM_GENERATED_MISSING").otherwise("REPORTED").alias("data_status"))


def densify(points: DataFrame) -> DataFrame:
    """Fill the periods between neighbours of one cadence with empty points; mixed or TTM series stay as they are."""
    w = Window.partitionBy("series").orderBy("sort_key", "ord")
    rows = points.withColumn("next", F.lead(F.struct("sort_key", "fiscal_year_end", "quarter")).over(w))
    kinds = Window.partitionBy("series")
    rows = rows.withColumn("one_kind", F.min("period_type").over(kinds) == F.max("period_type").over(kinds))
    # Quarters and years are numbered through, so that a gap is a run of whole numbers.
    index = lambda y, q: F.when(F.col("period_type") == "QUARTER", y * 4 + q - 1).otherwise(y)
    here, there = index(F.col("fiscal_year_end"), F.col("quarter")), index(F.col("next.fiscal_year_end"), F.col("next.quarter"))
    gap = F.col("one_kind") & (F.col("period_type") != "TTM") & (there > here + 1)
    missing = rows.where(gap).select("series", "period_type", F.explode(F.sequence(here + 1, there - 1)).alias("i"))
    quarterly = F.col("period_type") == "QUARTER"
    year, quarter = F.when(quarterly, F.expr("i div 4").cast("int")).otherwise(F.col("i")), F.when(quarterly, F.col("i") % 4 + 1)
    label = F.concat(F.when(quarterly, F.concat(F.lit("Q"), quarter.cast("string"))).otherwise(""), F.lit("FY"), F.right(year.cast("string"), F.lit(2)))
    filled = missing.select(
        "series",
        F.lit(None).cast("bigint").alias("ord"),
        label.alias("label"),
        "period_type",
        year.alias("fiscal_year_end"),
        quarter.alias("quarter"),
        (year * 10 + F.coalesce(quarter, F.lit(0))).alias("sort_key"),
        F.lit(None).cast("double").alias("value"),
        F.lit("U").alias("code"),
        F.lit("SYSTEM_GENERATED_MISSING").alias("data_status"),
    )
    return points.select(*filled.columns).unionByName(filled)


def series_issues(points: DataFrame, dense: DataFrame, as_of_year: int) -> DataFrame:
    """(series, code, n): unreadable and repeated periods, mixed cadence, actuals after a forecast."""
    unread = with_period(points, as_of_year).where("p is null").groupBy("series").agg(F.count("*").alias("n")).withColumn("issue", F.lit("CHART_UNPARSEABLE_PERIOD"))
    by = Window.partitionBy("series").orderBy("sort_key", "ord")
    own = F.col("ord").isNotNull()
    # A filled period lies between two others and never has the key of one, so equal keys are neighbours.
    marked = dense.select(
        "series",
        F.when(own, F.col("period_type")).alias("kind"),
        (own & (F.lag("sort_key").over(by) == F.col("sort_key"))).alias("again"),
        (F.max(values.is_forecast(F.col("code"))).over(by.rowsBetween(Window.unboundedPreceding, -1)) & values.is_actual(F.col("code"))).alias("late"),
    )
    counts = marked.groupBy("series").agg(F.count_if("again").alias("CHART_DUPLICATE_PERIOD"), F.size(F.collect_set("kind")).cast("bigint").alias("kinds"), F.count_if("late").alias("CHART_FORECAST_BEFORE_ACTUAL"))
    told = [F.struct(F.lit(issue).alias("issue"), n.alias("n")) for issue, n in (("CHART_DUPLICATE_PERIOD", F.col("CHART_DUPLICATE_PERIOD")), ("CHART_MIXED_PERIOD_TYPES", F.when(F.col("kinds") > 1, F.col("kinds"))), ("CHART_FORECAST_BEFORE_ACTUAL", F.col("CHART_FORECAST_BEFORE_ACTUAL")))]
    found = counts.where("`CHART_DUPLICATE_PERIOD` > 0 OR kinds > 1 OR `CHART_FORECAST_BEFORE_ACTUAL` > 0").select("series", F.explode(F.array(*told)).alias("i")).select("series", "i.issue", "i.n").where("n > 0")
    return unread.select("series", "issue", "n").unionByName(found)


# Metrics that get a chart.
CHARTED = ("revenue", "ebitda", "pat_reported")


def charted(metrics: DataFrame, key: str) -> DataFrame:
    """Points of the charts of each ``key`` (series is the metric), by period; currency and scale of the metric's first row. No point, no chart."""
    rows = metrics.where(F.col("taxonomy_key").isin(*CHARTED))
    same = Window.partitionBy(key, "taxonomy_key")
    shown = F.col("period") != ""
    w = Window.partitionBy(key, "taxonomy_key", shown).orderBy(F.coalesce("period_sort_key", F.lit(0)), "ord")
    points = rows.withColumn("m", F.min(F.struct("ord", "currency", "scale")).over(same)).withColumn("n", F.row_number().over(w) - 1).where(shown)
    return points.select(key, F.col("taxonomy_key").alias("series"), F.col("n").alias("ord"), "period", "value", F.col("classification_code").alias("code"), "m.currency", "m.scale")


def chart_issues(found: DataFrame, names: DataFrame, points: DataFrame, arrays: DataFrame) -> DataFrame:
    """``found`` (of ``series_issues``) with series in ``names`` that have no point, arrays of unequal length, severity and fingerprint."""
    one = F.lit(1).cast("bigint").alias("n")
    empty = names.select("series").distinct().join(points, "series", "left_anti").select("series", F.lit("CHART_EMPTY_SERIES").alias("issue"), one)
    uneven = arrays.where(F.size("labels") != F.size("data")).select("series", F.lit("CHART_LABEL_VALUE_MISMATCH").alias("issue"), one)
    rows = found.select("series", "issue", "n").unionByName(empty).unionByName(uneven)
    severity = F.when(F.col("issue") == "CHART_LABEL_VALUE_MISMATCH", "BLOCKER").otherwise("WARNING")
    return rows.select("series", F.col("issue").alias("code"), severity.alias("severity"), "n", F.concat_ws(":", F.lit("chart"), "series", "issue").alias("fingerprint"))


def legacy_arrays(dense: DataFrame) -> DataFrame:
    """Labels and values of each series as ordered arrays; nulls stay nulls."""
    ordered = F.array_sort(F.collect_list(F.struct("sort_key", F.coalesce("ord", F.lit(0)).alias("o"), "label", "value")))
    rows = dense.groupBy("series").agg(ordered.alias("p"))
    return rows.select("series", F.col("p.label").alias("labels"), F.col("p.value").alias("data"))


def from_legacy(arrays: DataFrame) -> DataFrame:
    """Arrays of labels and values to points; values that aren't finite are null."""
    rows = arrays.select("series", F.posexplode(F.arrays_zip("labels", "data")).alias("ord", "p"))
    v = F.col("p.data").cast("double")
    return rows.select("series", "ord", F.col("p.labels").alias("period"), F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("value"))


def forecast_boundary(dense: DataFrame) -> DataFrame:
    """Actual and forecast values in columns; the last actual before the first forecast is in both, so lines meet."""
    w = Window.partitionBy("series").orderBy("sort_key", "ord")
    forecast = values.is_forecast(F.col("code"))
    rows = dense.withColumn("i", F.row_number().over(w) - 1).withColumn("_f", forecast).withColumn("_next", F.lead(forecast).over(w))
    start = F.min(F.when(F.col("_f"), F.col("i"))).over(Window.partitionBy("series"))
    rows = rows.withColumn("start", F.coalesce(start, F.lit(-1)))
    joint = (F.col("i") == F.col("start") - 1) & F.col("_next")
    return rows.select("series", "label", "sort_key", F.when(~F.col("_f"), F.col("value")).alias("actual"), F.when(F.col("_f") | F.coalesce(joint, F.lit(False)), F.col("value")).alias("forecast"), F.col("start").alias("forecast_start"))


def growth_series(rows: DataFrame, keys: list[str], order: str, value: str, growth: Column) -> DataFrame:
    """Add ``prior`` (the value one period before) and the growth made of it."""
    return rows.withColumn("prior", F.lag(value).over(Window.partitionBy(*keys).orderBy(order))).withColumn("growth", growth)
