"""Robust statistics and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.functions.text import js_round, let


def nearest_rank(values: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {values})")


def mad_filtered(df: DataFrame, by: list[str], value: str, times: float = 3.5) -> DataFrame:
    """by, median, mad, robust_median: the median again without values further than `times` MAD from it."""
    m = df.groupBy(*by).agg(F.expr(f"percentile({value}, 0.5)").alias("median"))
    d = df.join(m, by).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    s = d.groupBy(*by).agg(F.expr("percentile(dev, 0.5)").alias("mad"))
    near = d.join(s, by).where((F.col("mad") == 0) | (F.col("dev") <= times * F.col("mad")))
    return near.groupBy(*by).agg(F.first("median").alias("median"), F.first("mad").alias("mad"), F.expr(f"percentile({value}, 0.5)").alias("robust_median"))


# Seconds to set up and for each page, seconds for each megabyte, weights and bounds.
SETUP, PAGE, MEGABYTE = (18, 40), (0.62, 7.5), (0.28, 0.75)
OWN_WEIGHT, HISTORY_WEIGHT, LEAST_SECONDS, MOST_SECONDS = 0.25, 0.75, 20, 14_400


def import_seconds(pages: Column, size: Column, ocr: Column, history_rate: Column) -> Column:
    """Estimated seconds to import a document; history_rate: median seconds a page of comparable earlier ones, or null."""
    pick = lambda pair: F.when(ocr, pair[1]).otherwise(pair[0])
    megabytes = F.coalesce(size, F.lit(0)) / (1024 * 1024)
    n = F.greatest(F.lit(1.0), js_round(F.coalesce(pages, js_round(F.coalesce(size, F.lit(0)) / (280 * 1024)))).cast("double"))
    extra = F.least(F.lit(180.0), megabytes * pick(MEGABYTE))
    own = pick(SETUP) + n * pick(PAGE) + extra
    blended = own * OWN_WEIGHT + (pick(SETUP) + history_rate * n + extra) * HISTORY_WEIGHT
    return F.greatest(F.lit(LEAST_SECONDS), F.least(F.lit(MOST_SECONDS), js_round(F.coalesce(blended, own))))


def interval_error(low: Column, high: Column, actual: Column) -> Column:
    """0 inside the interval, else the distance to it as a percentage of the actual value."""
    return F.when(actual.between(low, high), 0.0).when(actual < low, (low - actual) / actual * 100).otherwise((actual - high) / actual * 100)


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """cases (id, relevant, retrieved, forbidden: array<string>; claims: array<struct<text, citationIds, supported>>; relevance) -> one row of metrics each.

    Nothing retrieved has precision 0; nothing relevant, recall 1; no claims, faithfulness and traceability 1. A claim is faithful
    if it is supported and cites only what was retrieved, something at least. relevance lies between 0 and 1; null stays null.
    """
    e = F.array().cast("array<string>")
    rel, got, bad = [F.coalesce(c, e) for c in ("relevant", "retrieved", "forbidden")]
    hits = F.size(F.filter(got, lambda x: F.array_contains(rel, x)))
    first = F.array_position(F.transform(got, lambda x: F.array_contains(rel, x)), True)
    n = F.size("claims")
    cited = F.filter("claims", lambda c: (F.size(c["citationIds"]) > 0) & F.forall(c["citationIds"], lambda i: F.array_contains(got, i)))
    return cases.select(
        "id",
        F.when(F.size(got) > 0, hits / F.size(got)).otherwise(0.0).alias("precision"),
        F.when(F.size(rel) > 0, F.size(F.array_intersect(rel, got)) / F.size(F.array_distinct(rel))).otherwise(1.0).alias("recall"),
        F.when(first > 0, 1 / first).otherwise(0.0).alias("reciprocal_rank"),
        F.when(n > 0, F.size(F.filter(cited, lambda c: c["supported"])) / n).otherwise(1.0).alias("faithfulness"),
        F.when(n > 0, F.size(cited) / n).otherwise(1.0).alias("traceability"),
        (F.size(F.array_intersect(bad, got)) == 0).alias("privacy"),
        F.when(F.col("relevance").isNotNull() & ~F.isnan("relevance"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("relevance")))).alias("relevance"),
    )


def metrics_summary(metrics: DataFrame) -> DataFrame:
    """One row of the metrics' means over all cases (relevance: over those that have one) and the share of cases that keep privacy."""
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "reciprocal_rank", "faithfulness", "traceability", "relevance")]
    return metrics.agg(F.count("*").alias("cases"), *means, F.avg(F.col("privacy").cast("int")).alias("privacy_rate"))


# Points a day, bonus by length of the streak, most interest.
DAY_POINTS, STREAK_BONUS, MOST_INTEREST = 10, ((10, 0), (30, 2), (90, 5), (180, 10), (270, 15)), 5


def streak_points(days: Column) -> Column:
    bonus = F.lit(20)
    for most, points in reversed(STREAK_BONUS):
        bonus = F.when(days <= most, points).otherwise(bonus)
    return DAY_POINTS + bonus + F.least(F.floor(days / 10), F.lit(MOST_INTEREST))


def application_tier(score: Column, sources: Column) -> Column:
    return F.when((score >= 60) & (sources >= 2), "supported").otherwise("exploratory")


# Seconds to set up an analysis and for each character, weights of that and of what was observed, and the bounds.
ANALYSIS_SETUP, ANALYSIS_CHARACTER, ANALYSIS_OWN, ANALYSIS_SEEN, ANALYSIS_MOST = 45, 0.06, 0.30, 0.70, 1800


def analysis_seconds(characters: Column, seen_rate: Column) -> Column:
    """Estimated seconds to analyse a text; seen_rate: the median seconds a character of earlier ones, or null."""
    n = F.greatest(F.lit(1), characters)
    own = ANALYSIS_SETUP + n * ANALYSIS_CHARACTER
    both = own * ANALYSIS_OWN + (ANALYSIS_SETUP + seen_rate * n) * ANALYSIS_SEEN
    return F.greatest(F.lit(ANALYSIS_SETUP), F.least(F.lit(ANALYSIS_MOST), js_round(F.coalesce(both, own))))


def page_rate(history: DataFrame, by: list[str]) -> DataFrame:
    """history (by, order, seconds, pages, ocr, succeeded) -> by, ocr, rate: the median seconds a page of the last eight comparable imports."""
    good = history.where("succeeded and seconds > 0 and pages > 0")
    last = F.row_number().over(Window.partitionBy(*by, "ocr").orderBy(F.desc("order")))
    setup = F.when(F.col("ocr"), SETUP[1]).otherwise(SETUP[0])
    rate = F.greatest(F.lit(0.05), (F.col("seconds") - setup) / F.greatest(F.lit(1), F.col("pages")))
    recent = good.withColumn("_n", last).where("_n <= 8").withColumn("rate", rate)
    return recent.groupBy(*by, "ocr").agg(F.expr("percentile(rate, 0.5)").alias("rate"))


# What is added to a size before its scale, the power of that, and the bounds of a scale.
SCALE_ADD, SCALE_POWER, SCALE_BOUNDS = 400, 0.32, (0.65, 1.65)
# Share of the median for the lower end, most and part of the deviation for the upper, deviations of a sample at most, least ends.
LOWER, UPPER_MOST, UPPER_PART, DEVIATIONS, LEAST_ENDS = 0.72, 0.08, 0.25, 3.5, (5_000, 15_000)


def scaled_duration(duration: Column, size: Column, wanted: Column) -> Column:
    """A run's duration scaled to the size of another."""
    scale = F.pow((wanted + SCALE_ADD) / (size + SCALE_ADD), F.lit(SCALE_POWER))
    return duration * F.greatest(F.lit(SCALE_BOUNDS[0]), F.least(F.lit(SCALE_BOUNDS[1]), scale))


def run_interval(samples: Column) -> Column:
    """struct(min_ms, max_ms) from an array of a bounded number of durations: the median of those near the median, and a little beyond."""
    lower = lambda a: F.element_at(a, (F.floor((F.size(a) - 1) * 0.5) + 1).cast("int"))
    spread = lambda a, m: lower(F.array_sort(F.transform(a, lambda v: F.abs(v - m))))

    def ends(near):
        m = lower(near)
        high = m + F.least(m * UPPER_MOST, spread(near, m) * UPPER_PART)
        return F.struct(F.greatest(F.lit(LEAST_ENDS[0]), js_round(m * LOWER)).alias("min_ms"), F.greatest(F.lit(LEAST_ENDS[1]), js_round(high)).alias("max_ms"))

    def near(a):
        m = lower(a)
        return let(spread(a, m), lambda d: F.filter(a, lambda v: (d == 0) | (F.abs(v - m) <= d * DEVIATIONS)))

    return let(F.array_sort(samples), lambda a: let(near(a), ends))
