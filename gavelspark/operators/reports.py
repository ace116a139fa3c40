"""Reports on sales, runs and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up

c = F.col


def length_mismatch(parents: DataFrame, children: DataFrame, key: str, items: str) -> DataFrame:
    """Parents whose array has another length than they have children: key, listed, n."""
    counts = children.groupBy(key).agg(F.count("*").alias("n"))
    return parents.join(counts, key, "left").select(key, F.size(items).alias("listed"), F.coalesce("n", F.lit(0)).alias("n")).where("listed <> n")


def freshness(runs: DataFrame, success: str, now: str) -> DataFrame:
    """One row: last run and its status, last success, whole hours since, and a state: critical without one or beyond 72 hours, watch beyond 36."""
    g = runs.agg(F.max("ts").alias("last"), F.max(F.when(c("event_type") == success, c("ts"))).alias("ok"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(c("ok").cast("timestamp"))
    state = F.when(c("ok").isNull() | (seconds > 72 * 3600), "critical").when(seconds > 36 * 3600, "watch").otherwise("healthy")
    return g.select("last", "ok", "status", F.floor(seconds / 3600).cast("double").alias("hours"), state.alias("state"))


def source_missing(sales: DataFrame, k: int = 12) -> DataFrame:
    total = sales.agg(F.count("*").alias("_all"))
    missing = {"location": c("latitude").isNull() | c("longitude").isNull(), "surface": F.coalesce(c("surface_m2"), F.lit(0)) <= 0, "documents": F.coalesce(c("documents_count"), F.lit(0)) == 0, "description": F.coalesce(F.trim("description"), F.lit("")) == ""}
    g = sales.groupBy("source_name").agg(F.count("*").alias("n"), *(F.count_if(e).alias(f"missing_{n}") for n, e in missing.items()))
    return g.join(F.broadcast(total), F.lit(True)).withColumn("share_pct", round_half_up(c("n") / c("_all") * 100, 1)).drop("_all").orderBy(F.desc("n"), "source_name").limit(k)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Aggregates of one row each, side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), parts)


def runtime_health(runs: DataFrame, by: str, latency: Column, failed: Column, least: int, slow: float, errors_pct: float) -> DataFrame:
    """n, mean latency, share of errors, and signals: sample, latency, errors. The mean is that of exact sums (to 12 decimals, where values have them in reach), so that halves go up in whatever order rows come."""
    exact = latency.try_cast("decimal(26,12)")
    mean = F.when(F.count(exact) == F.count(latency), (F.sum(exact) / F.count(exact)).cast("double")).otherwise(F.avg(latency))
    g = runs.groupBy(by).agg(F.count("*").alias("n"), round_half_up(mean, 1).alias("latency"), round_half_up(F.count_if(failed) / F.count("*") * 100, 1).alias("error_pct"))
    return g.withColumn("signals", F.array_join(F.array_compact(F.array(F.when(c("n") < least, "sample"), F.when(c("latency") > slow, "latency"), F.when(c("error_pct") > errors_pct, "errors"))), ","))


def error_metrics(rows: DataFrame, by: str) -> DataFrame:
    """Errors of predicted against actual, in per cent, and how many actual values lie within low and high."""
    ape = F.abs(c("predicted") - c("actual")) / c("actual") * 100
    e = rows.select(by, ape.alias("ape"), c("actual").between(c("low"), c("high")).cast("int").alias("hit"))
    return e.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("ape"), 4).alias("mape"), F.round(F.percentile("ape", 0.5), 4).alias("median_ape"), F.round(F.percentile("ape", 0.75), 4).alias("p75_ape"), F.round(F.avg("hit") * 100, 4).alias("coverage"))


def month_profile(rows: DataFrame, date: str, value: Column) -> DataFrame:
    """By month of the year: years seen, mean of the values that are there, and how many there are a year."""
    years = F.count_distinct(F.year(date))
    return rows.groupBy(F.month(date).alias("month")).agg(years.alias("years"), F.round(F.avg(value), 4).alias("mean_value"), F.round(F.count(value) / years, 4).alias("per_year"))


def month_extremes(rows: DataFrame, by: str, date: str, value: Column) -> DataFrame:
    """The month of the greatest and of the least sum (the earlier of equal ones), and the sum of all."""
    m = rows.groupBy(by, F.month(date).alias("m")).agg(F.sum(value).alias("v"))
    return m.groupBy(by).agg(F.max_by("m", F.struct("v", -c("m"))).alias("top_month"), F.min_by("m", F.struct("v", "m")).alias("low_month"), F.sum("v").alias("total"))


def readiness(days: Column, blocked: Column, open_items: Column, progress: Column) -> Column:
    return F.when(days.isNull(), "missing_date").when(days < 0, "past").when(blocked > 0, "blocked").when((days <= 7) & (open_items > 0), "urgent").when(progress >= 80, "ready").otherwise("needs_work")


def audience_urgency(days: Column) -> Column:
    return F.when(days.isNull(), "unknown").when(days < 0, "past").when(days == 0, "today").when(days <= 7, "week").when(days <= 30, "month").otherwise("later")


def is_property_image(url: Column) -> Column:
    """An image by its ending, and no logo or icon."""
    return F.lower(url).rlike(r"\.(jpe?g|png|webp|gif|avif)(\?.*)?$") & ~F.lower(url).rlike("logo|icon|avatar|sprite")


def pressure(components: dict[str, tuple[Column, float]]) -> Column:
    """Mean of the scores that are there by their weights, which are taken relative to one another; null if there is none."""
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in components.values()), F.lit(0.0))
    return sum((F.coalesce(x * w, F.lit(0.0)) for x, w in components.values()), F.lit(0.0)) / F.nullif(weight, F.lit(0.0))


def audit_score(states: list[Column]) -> Column:
    """100 less 8 for each checkpoint to watch, 18 for a risk, 15 for a missing one."""
    return F.lit(100) - sum((F.when(s == "ok", 0).when(s == "watch", 8).when(s == "risk", 18).otherwise(15) for s in states), F.lit(0))


def report_lines(report: DataFrame, prefix: str, shares: list[str]) -> DataFrame:
    """metric and line for each column of a report of one row, as it is printed; shares get a percent sign, nulls are n/a."""
    long = report.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").cast("string").alias("value")) for n in report.columns))))
    sign = F.when(F.col("metric").isin(shares), "%").otherwise("")
    return long.select("metric", F.concat(F.lit(f"- {prefix}_"), "metric", F.lit(": "), F.coalesce("value", F.lit("n/a")), sign).alias("line"))
