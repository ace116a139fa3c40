"""Counts, distributions and summaries of sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hexagons import cell_of
from ..functions.numbers import round_half_up

c = F.col


def big(x: Column) -> Column:
    return x.cast("bigint")


def share_pct(condition: Column) -> Column:
    """Per cent of rows, one decimal; a null condition is false."""
    return F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("int")) * 100, 1)


def source_coverage(sales: DataFrame) -> DataFrame:
    return sales.groupBy("source_name", "department").agg(
        F.count("*").alias("sales"),
        F.count_if(c("status") == "upcoming").alias("upcoming"),
        F.count_if(c("latitude").isNotNull()).alias("geocoded"),
        F.count_if(c("starting_price_eur").isNull()).alias("without_price"),
    )


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: all rows, and for each column how many have none."""
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(c(x).isNull()).alias(f"missing_{x}") for x in columns))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n of each column's values: one pass, the columns unpivoted before a single shuffle."""
    pairs = F.array(*(F.struct(F.lit(x).alias("dimension"), c(x).cast("string").alias("value")) for x in columns))
    return rows.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def quality_report(sales: DataFrame, by: list[str]) -> DataFrame:
    checks = {
        "with_price": c("starting_price_eur") > 0,
        "with_surface": c("surface_m2") > 0,
        "with_tribunal": c("tribunal_code").isNotNull(),
        "geocoded": c("latitude").isNotNull() & c("longitude").isNotNull(),
        "with_documents": c("documents_count") > 0,
        "with_dpe": c("dpe_class").isNotNull(),
        "scored": c("investment_score").isNotNull(),
    }
    return sales.groupBy(*by).agg(F.count("*").alias("total"), *(share_pct(e).alias(k) for k, e in checks.items()))


def gap_report(sales: DataFrame, required: list[str]) -> DataFrame:
    """source_name, field, missing: land has no rooms to miss."""
    exempt = lambda f: (c("property_type").isin("land", "parking") & F.lit(f in ("rooms_count", "bedrooms_count"))) if f in ("rooms_count", "bedrooms_count") else F.lit(False)
    gaps = F.array_compact(F.array(*(F.when(c(f).isNull() & ~F.coalesce(exempt(f), F.lit(False)), f) for f in required)))
    return sales.select("source_name", F.explode(gaps).alias("field")).groupBy("source_name", "field").agg(F.count("*").alias("missing"))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def market_items(sales: DataFrame, now: str) -> DataFrame:
    """sales with price_m2 (of the adjudication, else the starting price), days_to_sale (positive, from created_at) and is_upcoming (after now, a date)."""
    price = F.coalesce(positive(c("adjudication_price_eur")), positive(c("starting_price_eur")))
    return sales.withColumns({
        "price_m2": round_half_up(price / positive(c("surface_m2")), 1),
        "days_to_sale": positive(F.datediff("sale_date", "created_at")),
        "is_upcoming": F.coalesce(c("sale_date") > F.lit(now).cast("date"), F.lit(False)),
    })


def quantile(x: Column, p: float) -> Column:
    """Of positive values, one decimal, half up."""
    return round_half_up(F.percentile(positive(x), p), 1)


def mean(x: Column) -> Column:
    return round_half_up(F.avg(positive(x)), 1)


def market_summary(items: DataFrame, by: list[str]) -> DataFrame:
    price = c("starting_price_eur")
    return items.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("is_upcoming").alias("upcoming"),
        F.count_if(~c("is_upcoming")).alias("past"),
        quantile(price, 0.25).alias("p25"),
        quantile(price, 0.5).alias("median"),
        quantile(price, 0.75).alias("p75"),
        quantile(c("price_m2"), 0.5).alias("median_m2"),
        mean(c("investment_score")).alias("mean_score"),
        mean(c("days_to_sale")).alias("mean_delay"),
    )


#: Bounds of the price buckets.
PRICE_BOUNDS = [None, 50_000, 100_000, 200_000, 400_000, None]


def histogram(sales: DataFrame, bounds: list[int | None] = PRICE_BOUNDS) -> DataFrame:
    """bucket, low, high, n, share_pct of positive prices in [low, high); empty buckets are there with 0. Counts of all buckets are one aggregate row, turned into rows."""
    price = c("starting_price_eur")
    pairs = list(zip(bounds, bounds[1:], strict=False))
    within = lambda lo, hi: (price > 0) & (F.lit(True) if lo is None else price >= lo) & (F.lit(True) if hi is None else price < hi)
    counts = [F.count_if(within(lo, hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(pairs)]
    one = sales.where(price > 0).agg(F.count("*").alias("all"), *counts)
    rows = F.array(*(F.struct(F.lit(i).cast("bigint").alias("bucket"), F.lit(lo).cast("bigint").alias("low"), F.lit(hi).cast("bigint").alias("high"), c(f"b{i}").alias("n")) for i, (lo, hi) in enumerate(pairs)))
    return one.select("all", F.inline(rows)).select("bucket", "low", "high", "n", round_half_up(F.when(c("all") > 0, c("n") * 100 / c("all")).otherwise(0.0), 1).alias("share_pct"))


def monthly(items: DataFrame) -> DataFrame:
    return items.where("sale_date IS NOT NULL").groupBy(F.date_format("sale_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), quantile(c("starting_price_eur"), 0.5).alias("median_price"), quantile(c("price_m2"), 0.5).alias("median_m2"), mean(c("days_to_sale")).alias("mean_delay"))


def top_segments(items: DataFrame, k: int) -> DataFrame:
    """By city where there is more than one, else by type: the k largest segments, ties by label. The number of cities (2 at most) is a one-row aggregate."""
    cities = items.where("city <> ''").select("city").distinct().limit(2).agg((F.count("*") > 1).alias("by_city"))
    label = F.when(c("by_city"), F.coalesce("city", F.lit("Ville non renseignée"))).otherwise(F.coalesce("property_type", F.lit("Type non renseigné")))
    grouped = items.join(F.broadcast(cities), F.lit(True)).groupBy(label.alias("label")).agg(F.count("*").alias("n"), quantile(c("starting_price_eur"), 0.5).alias("median_price"), quantile(c("price_m2"), 0.5).alias("median_m2"), mean(c("investment_score")).alias("mean_score"))
    return grouped.orderBy(F.desc("n"), "label").limit(k)


def rotation(items: DataFrame, by: str) -> DataFrame:
    """Sales a month, upcoming to past ones in per cent, and what these say of liquidity."""
    months = F.count_distinct(F.date_format("sale_date", "yyyy-MM"))
    g = items.groupBy(by).agg(F.count("*").alias("n"), months.alias("months"), F.count_if("is_upcoming").alias("upcoming"), F.count_if(~c("is_upcoming")).alias("past"), mean(c("days_to_sale")).alias("mean_delay"))
    g = g.withColumns({"per_month": round_half_up(c("n") / F.greatest(c("months"), F.lit(1)), 1), "pipeline_pct": round_half_up(F.when(c("past") > 0, c("upcoming") / c("past") * 100), 1)})
    delay = c("mean_delay")
    liquidity = F.when(c("past") == 0, "unknown").when((c("per_month") >= 6) & (delay.isNull() | (delay <= 45)), "active").when((c("per_month") >= 2) | (delay <= 75), "moderate").otherwise("low")
    pipeline = F.when((c("past") == 0) & (c("upcoming") > 0), "no history").when(c("pipeline_pct").isNull(), "unknown").when(c("pipeline_pct") >= 80, "full").when(c("pipeline_pct") >= 35, "balanced").otherwise("thin")
    return g.withColumns({"liquidity": liquidity, "pipeline": pipeline})


def trend(items: DataFrame, by: str, value: Column) -> DataFrame:
    """First against last month that has a value; a change below 5 per cent is stable; fewer than two months or no positive first value: missing."""
    periods = items.where("sale_date IS NOT NULL").groupBy(by, F.date_format("sale_date", "yyyy-MM").alias("period")).agg(value.alias("v")).where("v IS NOT NULL")
    ends = periods.groupBy(by).agg(F.count("*").alias("periods"), F.min("period").alias("period_from"), F.max("period").alias("period_to"), F.min_by("v", "period").alias("v0"), F.max_by("v", "period").alias("v1"))
    enough = c("periods") >= 2
    change = round_half_up(F.when(enough & (c("v0") > 0), (c("v1") - c("v0")) / c("v0") * 100), 1)
    out = ends.select(by, "period_from", "period_to", F.when(enough, round_half_up(c("v0").cast("double"), 1)).alias("start_value"), F.when(enough, round_half_up(c("v1").cast("double"), 1)).alias("end_value"), change.alias("change_pct"))
    return out.withColumn("direction", F.when(c("change_pct").isNull(), "missing").when(F.abs("change_pct") < 5, "stable").when(c("change_pct") > 0, "up").otherwise("down"))


def sales_stats(sales: DataFrame) -> DataFrame:
    classes = [F.count_if(c("dpe_class") == k).alias(f"dpe_{k.lower()}") for k in "ABCDEFG"]
    m2 = F.when(c("surface_m2") > 0, c("starting_price_eur") / c("surface_m2"))
    return sales.agg(F.count("*").alias("n"), F.round(F.median("starting_price_eur"), 2).alias("median_price"), F.round(F.avg("starting_price_eur"), 2).alias("mean_price"), F.round(F.median(m2), 2).alias("median_m2"), F.count_if(c("adjudication_price_eur").isNotNull()).alias("adjudicated"), *classes)


def stats_segments(sales: DataFrame, dimensions: list[str], k: int = 8) -> DataFrame:
    """The k most frequent values of each dimension, with their share of all rows. Values are counted before they are ranked, so a window holds a dimension's values, not its rows."""
    counts = value_counts(sales, dimensions).where("value IS NOT NULL")
    total = sales.agg(F.count("*").alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value")))
    return ranked.where(c("rank") <= k).join(F.broadcast(total), F.lit(True)).select("dimension", "value", "n", big(c("rank")).alias("rank"), F.round(c("n") * 100 / c("total"), 1).alias("share_pct"))


def history_summary(sales: DataFrame, by: str) -> DataFrame:
    delta = F.when((c("starting_price_eur") > 0) & c("adjudication_price_eur").isNotNull(), (c("adjudication_price_eur") - c("starting_price_eur")) * 100 / c("starting_price_eur"))
    return sales.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg("starting_price_eur"), 2).alias("mean_start"),
        F.round(F.median("starting_price_eur"), 2).alias("median_start"),
        F.round(F.avg(delta), 2).alias("mean_delta_pct"),
        F.min("sale_date").alias("earliest"),
        F.max("sale_date").alias("latest"),
        F.array_join(F.slice(F.array_sort(F.collect_set("city")), 1, 8), ",").alias("cities"),
    )


#: Per cent of sales from which a metric is watched, and from which it is healthy.
METRIC_LIMITS = {"ai_description": (95, 99), "location": (65, 85), "surface": (65, 85), "documents": (65, 85), "dpe": (65, 85), "source_traceability": (65, 85), "opportunity_report": (75, 90), "market_estimate": (70, 88), "dvf_detailed_comparables": (70, 88), "bid_ceiling": (80, 92), "smart_alerts": (80, 94), "investor_api_feed": (80, 94)}


def metric_monitor(sales: DataFrame) -> DataFrame:
    """metric, covered, total, pct, state of fields and of what is built on them: healthy, watch or critical by the limits of each."""
    there = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    location, surface, price, dated = c("latitude").isNotNull() & c("longitude").isNotNull(), c("surface_m2") > 0, c("starting_price_eur") > 0, c("sale_date").isNotNull()
    source, place, kind = c("source_url").isNotNull() | c("source_name").isNotNull(), there("department") | there("city"), there("property_type")
    checks = {
        "ai_description": there("description"), "location": location, "surface": surface, "documents": c("documents_count") > 0, "dpe": c("dpe_class").isNotNull(), "source_traceability": source,
        "opportunity_report": price & dated & surface & location & source, "market_estimate": location & surface, "dvf_detailed_comparables": location & surface & place & kind,
        "bid_ceiling": price & surface, "smart_alerts": price & dated & place & kind, "investor_api_feed": source & price & dated & c("tribunal_code").isNotNull(),
    }
    one = sales.agg(F.count("*").alias("total"), *(F.count_if(e).alias(k) for k, e in checks.items()))
    limits = METRIC_LIMITS
    rows = one.select("total", F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), c(k).alias("covered"), F.lit(limits[k][0]).alias("watch"), F.lit(limits[k][1]).alias("healthy")) for k in checks))))
    pct = round_half_up(F.when(c("total") > 0, c("covered") / c("total") * 100).otherwise(0.0), 1)
    return rows.withColumn("pct", pct).select("metric", "covered", "total", "pct", F.when(c("pct") >= c("healthy"), "healthy").when(c("pct") >= c("watch"), "watch").otherwise("critical").alias("state"))


def canonical_mutations(lines: DataFrame) -> DataFrame:
    """One row a mutation of register lines: more than one date, or more than one built signature, rejects it; land is the sum over parcels of the largest surface; two levels, so that a mutation's parcels are pre-aggregated."""
    parcels = lines.groupBy("mutation_id", "parcel_id").agg(
        F.max("land_m2").alias("land"), F.min("line_date").alias("d0"), F.max("line_date").alias("d1"), F.min("price_eur").alias("p0"), F.max("price_eur").alias("p1"),
        F.max("lots_count").alias("lots"), F.collect_set(F.when(c("built_m2") > 0, F.struct("type_code", "built_m2"))).alias("built"), F.count("*").alias("lines"), F.collect_set(F.struct("latitude", "longitude")).alias("points"),
    )
    whole = parcels.groupBy("mutation_id").agg(
        F.sum("land").alias("land_m2"), F.min("d0").alias("d0"), F.max("d1").alias("d1"), F.min("p0").alias("price_eur"), F.max("p1").alias("p1"), F.max("lots").alias("lots_count"), F.sum("lines").alias("lines"),
        F.array_distinct(F.flatten(F.collect_list("built"))).alias("built"), F.array_distinct(F.flatten(F.collect_list("points"))).alias("points"), F.array_join(F.sort_array(F.collect_set("parcel_id")), ",").alias("parcels"),
    )
    one = (c("d0") == c("d1")) & (c("price_eur") == c("p1")) & (F.size("built") <= 1)
    mean = lambda f: F.aggregate(F.transform("points", lambda p: p[f]), F.lit(0.0), lambda a, v: a + v) / F.size("points")
    return whole.where(one).select("mutation_id", c("d0").alias("sale_date"), "price_eur", big(F.get("built", F.lit(0))["built_m2"]).alias("built_m2"), big(c("land_m2")).alias("land_m2"), "lots_count", "lines", "parcels", F.round(mean("latitude"), 6).alias("latitude"), F.round(mean("longitude"), 6).alias("longitude"))


def cell_log_stats(rows: DataFrame, lat: Column, lng: Column, price: Column, size: float) -> DataFrame:
    """Number, sum and spread of log prices in each hexagonal cell of an edge of `size` metres; sums add up to those of coarser cells."""
    cell = cell_of(lat, lng, size)
    return rows.where((price > 0) & cell.isNotNull()).groupBy(cell["q"].alias("q"), cell["r"].alias("r")).agg(F.count("*").alias("n"), F.round(F.sum(F.ln(price)), 6).alias("sum_log"), F.round(F.stddev_samp(F.ln(price)), 6).alias("std_log"))


def leave_one_out(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's mean over the others of its key, from pre-aggregated sums rather than a window over a key's rows; null if alone."""
    sums = rows.groupBy(key).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return rows.join(sums, key).withColumn("loo_mean", F.round(F.when(c("n") > 1, (c("s") - c(value)) / (c("n") - 1)), 4)).drop("s", "n")


def weighted_average(rows: DataFrame, by: str, value: Column, weight: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.round(F.sum(value * weight) / F.sum(weight), 4).alias("weighted"), F.round(F.pow(F.sum(weight), 2) / F.sum(weight * weight), 4).alias("effective_n"))


def weighted_quantile(rows: DataFrame, by: str, value: str, weight: str, p: float, width: float = 1000.0) -> DataFrame:
    """The least value whose cumulative weight reaches p of the total. Equal values are summed first; a running sum over buckets of values finds the bucket in which it lies, one over that bucket's values the value: no window holds all values of a group."""
    steps = rows.groupBy(by, c(value).alias("v")).agg(F.sum(weight).alias("w")).withColumn("bucket", F.floor(c("v") / width))
    group = Window.partitionBy(by)
    buckets = steps.groupBy(by, "bucket").agg(F.sum("w").alias("bw"))
    upto = F.sum("bw").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    run = buckets.select(by, "bucket", (upto - c("bw")).alias("before"), upto.alias("upto"), F.sum("bw").over(group).alias("total"))
    at = run.where(c("upto") >= c("total") * p).groupBy(by).agg(F.min(F.struct("bucket", "before", "total")).alias("b")).select(by, "b.*")
    inside = steps.join(at, [by, "bucket"])
    reached = c("before") + F.sum("w").over(group.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) >= c("total") * p
    return inside.select(by, "v", reached.alias("reached")).where("reached").groupBy(by).agg(F.min("v").alias("quantile"))


def market_trend(rows: DataFrame, by: str, price: Column, months_old: Column, distance_m: Column) -> DataFrame:
    """Yearly change of the price: exp of the weighted slope of the logarithm, held within its 10th and 90th percentile, less 1; shrunk by n / (n + 12), .8 at most, within 12 %. 0 for fewer than 6 rows, less than 12 months, or no spread."""
    r = rows.select(by, F.ln(price).alias("y"), (-months_old / 12).alias("x"), months_old.alias("m"), F.exp(-distance_m / 1500).alias("w"))
    limits = r.groupBy(by).agg(F.count("*").alias("n"), F.max("m").alias("span"), F.percentile("y", 0.1).alias("lo"), F.percentile("y", 0.9).alias("hi"))
    r = r.join(limits, by).withColumn("y", F.greatest("lo", F.least("hi", "y")))
    s = lambda e: F.sum(e)
    w, x, y = c("w"), c("x"), c("y")
    g = r.groupBy(by).agg(F.max("n").alias("n"), F.max("span").alias("span"), s(w).alias("sw"), s(w * x).alias("wx"), s(w * y).alias("wy"), s(w * x * y).alias("wxy"), s(w * x * x).alias("wxx"))
    variance = c("wxx") - c("wx") * c("wx") / c("sw")
    slope = (c("wxy") - c("wx") * c("wy") / c("sw")) / F.nullif(variance, F.lit(0.0))
    shrunk = (F.exp(slope) - 1) * F.least(F.lit(0.8), c("n") / (c("n") + 12))
    out = F.when((c("n") < 6) | (c("span") < 12) | (variance <= 1e-9), 0.0).otherwise(F.greatest(F.lit(-0.12), F.least(F.lit(0.12), shrunk)))
    return g.select(by, "n", F.round(out, 6).alias("trend"))


def iqr_filtered(rows: DataFrame, by: str, value: str, least_n: int = 7, keep: int = 4) -> DataFrame:
    """Rows within the fences of their group (1.5 spreads beyond the quartiles) if it has least_n rows and a spread, and keep rows would stay. Fences are an aggregate joined back."""
    fences = rows.groupBy(by).agg(F.count("*").alias("n"), F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    spread = c("q3") - c("q1")
    inside = c(value).between(c("q1") - 1.5 * spread, c("q3") + 1.5 * spread)
    marked = rows.join(fences, by).withColumn("inside", F.when((c("n") >= least_n) & (spread > 0), inside).otherwise(F.lit(True)))
    stays = marked.groupBy(by).agg(F.count_if("inside").alias("stay"))
    return marked.join(stays, by).where(c("inside") | (c("stay") < keep)).drop("n", "q1", "q3", "inside", "stay")


def cohort_stats(sales: DataFrame, by: list[str]) -> DataFrame:
    ratio = F.when(c("starting_price_eur") > 0, c("adjudication_price_eur") / c("starting_price_eur"))
    q = lambda p: F.round(F.percentile(ratio, p), 4)
    return sales.groupBy(*by).agg(F.count("*").alias("sample_size"), F.round(F.avg((c("status") == "adjudicated").cast("int")), 4).alias("p_adjudicated"), F.round(F.avg((c("status") == "unknown").cast("int")), 4).alias("p_unknown"), q(0.1).alias("ratio_p10"), q(0.5).alias("ratio_p50"), q(0.9).alias("ratio_p90"), F.min("sale_date").alias("period_start"), F.max("sale_date").alias("period_end"))


def promotion_gate(metrics: DataFrame) -> DataFrame:
    """metrics: rows, median_ape, mape, coverage, width. Failures, comma-joined."""
    checks = [F.when(c("rows") < 50, "rows"), F.when(c("median_ape") > 30, "median_ape"), F.when(c("mape") > 40, "mape"), F.when(c("coverage") < 72, "coverage"), F.when(c("width") > 110, "width")]
    return metrics.withColumn("failures", F.array_join(F.array_compact(F.array(*checks)), ",")).withColumn("promoted", c("failures") == "")


def json_object(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """by, entries: key=value sorted by key."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: F.concat_ws("=", s[key], s[value].cast("string"))), ";").alias("entries"))


def sum_of_max(rows: DataFrame, by: str, part: str, value: str) -> DataFrame:
    """The sum over parts of the largest value of each; two levels, so parts are pre-aggregated."""
    return rows.groupBy(by, part).agg(F.max(value).alias(value)).groupBy(by).agg(F.sum(value).alias(value))


def distinct_centroid(rows: DataFrame, by: str) -> DataFrame:
    """The mean of distinct places."""
    return rows.select(by, "latitude", "longitude").distinct().groupBy(by).agg(F.round(F.avg("latitude"), 6).alias("latitude"), F.round(F.avg("longitude"), 6).alias("longitude"))


def running_weight(rows: DataFrame, by: str, value: str, weight: str, width: float = 10.0) -> DataFrame:
    """For each distinct value of a group the weight of all up to it: that of the buckets (of `width`) below, and that of its bucket's values up to it. A window spans a group's buckets, or a bucket's values."""
    steps = rows.groupBy(by, c(value).alias("v")).agg(F.sum(weight).alias("w")).withColumn("_bucket", F.floor(c("v") / width))
    upto = lambda w, last: w.rowsBetween(Window.unboundedPreceding, last)
    buckets = steps.groupBy(by, "_bucket").agg(F.sum("w").alias("_w"))
    below = buckets.select(by, "_bucket", F.coalesce(F.sum("_w").over(upto(Window.partitionBy(by).orderBy("_bucket"), -1)), F.lit(0)).alias("_below"))
    inside = F.sum("w").over(upto(Window.partitionBy(by, "_bucket").orderBy("v"), 0))
    return steps.join(below, [by, "_bucket"]).select(by, "v", (c("_below") + inside).alias("upto"))


def mutation_kinds(lines: DataFrame) -> DataFrame:
    """mutation_id, price_eur, built_m2, kind: home (one built unit, a dwelling), building (two dwellings or more and no shop), land (nothing built), other."""
    built = F.coalesce(c("built_m2") > 0, F.lit(False))
    g = lines.groupBy("mutation_id").agg(F.count_if(built).alias("units"), F.count_if(built & c("type_code").isin(1, 2)).alias("homes"), F.count_if(built & (c("type_code") == 4)).alias("shops"), F.max("price_eur").alias("price_eur"), F.sum("built_m2").alias("built_m2"))
    kind = F.when((c("units") == 1) & (c("homes") == 1), "home").when((c("homes") >= 2) & (c("shops") == 0), "building").when(c("units") == 0, "land").otherwise("other")
    return g.select("mutation_id", "price_eur", "built_m2", kind.alias("kind"))


def parking_estimates(rows: DataFrame, by: str, price: Column, least: int = 8) -> DataFrame:
    """low, mid, high (to 500) and quality of parking places by group: prices outside 1.5 spreads of the logarithm's quartiles go where there are `least`; groups of fewer have no estimate."""
    p = rows.where(price > 0).select(by, F.ln(price).alias("l"))
    q = p.groupBy(by).agg(F.count("*").alias("n"), F.percentile("l", 0.25).alias("a"), F.percentile("l", 0.75).alias("b"))
    spread = c("b") - c("a")
    kept = p.join(q, by).where((c("n") < least) | (spread <= 0) | c("l").between(c("a") - 1.5 * spread, c("b") + 1.5 * spread)).select(by, F.exp("l").alias("v"))
    g = kept.groupBy(by).agg(F.count("*").alias("n"), *(F.percentile("v", x).alias(k) for x, k in ((0.1, "p10"), (0.5, "m"), (0.9, "p90")))).where(c("n") >= least)
    to500 = lambda e: round_half_up(e / 500) * 500
    return g.select(by, "n", to500(F.greatest(F.lit(1000.0), F.least("p10", 0.5 * c("m")))).alias("low"), to500(c("m")).alias("mid"), to500(F.greatest(c("p90"), 1.8 * c("m"))).alias("high"), F.greatest(F.lit(28.0), F.least(F.lit(64.0), round_half_up(32 + 18 * F.log10(c("n") + 1)))).alias("quality"))


def first_scope(rows: DataFrame, row_id: str, scopes: list[tuple[str, list[str], int]]) -> DataFrame:
    """Each row's first scope, narrow to wide, that has the least number of rows, and how many it has; all rows if none has."""
    out = rows
    for i, (_, keys, _) in enumerate(scopes):
        counts = rows.groupBy(*keys).agg(F.count("*").alias(f"_n{i}"))
        out = out.join(counts, keys, "left")
    whole = rows.agg(F.count("*").alias("_all"))
    out = out.join(F.broadcast(whole), F.lit(True))
    pick = lambda e: F.coalesce(*(F.when(c(f"_n{i}") >= least, e(i, name)) for i, (name, _, least) in enumerate(scopes)))
    return out.select(row_id, F.coalesce(pick(lambda i, name: F.lit(name)), F.lit("all")).alias("scope"), F.coalesce(pick(lambda i, name: c(f"_n{i}")), c("_all")).alias("n"))
