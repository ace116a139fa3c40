"""Queries of further filters, reports and aggregates, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text
from ..operators import aggregates as agg
from ..operators import reports, search, states
from ..sources.adapters import MUTATIONS_CTE, SALES_CTE, TRIBUNALS_CTE, mutations, read, sales, tribunals
from .queries import CHECKS, COLUMNS, FOLDED, NOW, SHOWN, half_up
from .registry import query
from .scalars import over_sales

c = F.col
S = f"WITH {SALES_CTE} "

# filters


@query("flt_authenticated", S + f"SELECT {COLUMNS} FROM sales WHERE department IN ('03', '04', '05', '06') AND city ILIKE '%a%' AND starting_price_eur >= 20000 AND starting_price_eur <= 250000 AND created_at >= DATE '{NOW}' - 700 AND ((title ILIKE '%maison%' OR address ILIKE '%maison%') OR (title ILIKE '%marche%' OR address ILIKE '%march%'))")
def authenticated(spark, d):
    terms = [("%maison%", "%maison%"), ("%marche%", "%march%")]
    some = search.any_of([c("title").ilike(t) | c("address").ilike(a) for t, a in terms])
    return sales(spark, d).where(c("department").isin("03", "04", "05", "06") & c("city").ilike("%a%") & c("starting_price_eur").between(20_000, 250_000) & (c("created_at") >= F.date_sub(F.lit(NOW).cast("date"), 700)) & some).select(*SHOWN)


@query("flt_accent_tolerant", S + f"SELECT sale_id FROM sales WHERE contains({FOLDED.format('address')}, 'republique')")
def accent_tolerant(spark, d):
    return sales(spark, d).where(search.accent_tolerant(c("address"), "republique")).select("sale_id")


@query("flt_scope_intersect", S + "SELECT sale_id FROM sales WHERE department IN ('05', '07')")
def scope_intersect(spark, d):
    return sales(spark, d).where(c("department").isin(search.intersect_scopes(["03", "05", "07"], ["07", "05", "20"]))).select("sale_id")


@query("flt_text_all_terms", S + f"SELECT sale_id FROM sales WHERE contains({FOLDED.format('concat_ws(chr(32), title, city, address)')}, 'maison') AND contains({FOLDED.format('concat_ws(chr(32), title, city, address)')}, 'nation_7')")
def all_terms(spark, d):
    return sales(spark, d).where(search.all_terms(F.concat_ws(" ", "title", "city", "address"), "Maison NATION_7")).select("sale_id")


@query("flt_map_pins", S + "SELECT sale_id, latitude, longitude, coalesce(status, 'unknown') AS status FROM sales WHERE coalesce(status, 'unknown') IN ('upcoming', 'unknown') AND latitude IS NOT NULL AND longitude IS NOT NULL")
def map_pins(spark, d):
    status = F.coalesce("status", F.lit("unknown"))
    return sales(spark, d).where(status.isin("upcoming", "unknown") & c("latitude").isNotNull() & c("longitude").isNotNull()).select("sale_id", "latitude", "longitude", status.alias("status"))


@query("flt_public_projection", S + "SELECT sale_id, source_name, department, city, title, property_type, surface_m2, starting_price_eur, sale_date, status FROM sales")
def public_projection(spark, d):
    return sales(spark, d).select("sale_id", "source_name", "department", "city", "title", "property_type", "surface_m2", "starting_price_eur", "sale_date", "status")


@query("flt_zone_match", S + "SELECT sale_id FROM sales WHERE department = '07' AND starts_with(postal_code, '070') AND latitude IS NOT NULL AND 2 * 6371e0 * asin(sqrt(least(1e0, pow(sin(radians(latitude - 46e0) / 2), 2) + cos(radians(46e0)) * cos(radians(latitude)) * pow(sin(radians(longitude - 3e0) / 2), 2)))) <= 150")
def zone_match(spark, d):
    return sales(spark, d).where(search.in_zone(department="07", postal_prefix="070", centre=(46.0, 3.0), radius_km=150.0)).select("sale_id")


@query("flt_market_nature", f"WITH {MUTATIONS_CTE} SELECT mutation_id, line_no, parcel_id FROM mutations WHERE lower(trim(nature)) = 'vente'")
def market_nature(spark, d):
    return mutations(spark, d).where(F.lower(F.trim("nature")) == "vente").select("mutation_id", "line_no", "parcel_id")


@query("flt_department_scope", S + "SELECT source_name, sale_id FROM sales WHERE source_name <> 'automobile' OR department IN ('03', '05')")
def department_scope(spark, d):
    return sales(spark, d).where((c("source_name") != "automobile") | c("department").isin("03", "05")).select("source_name", "sale_id")


@query("flt_sale_changed", S + "SELECT sale_id FROM sales WHERE sale_id % 3 = 0")
def sale_changed(spark, d):
    now = sales(spark, d).select("source_url", "sale_id", F.sha2(F.to_json(F.struct("status", "starting_price_eur", "sale_id")), 256).alias("h"))
    published = now.select("source_url", F.when(c("sale_id") % 3 == 0, "old").otherwise(c("h")).alias("h"))
    return now.join(published, ["source_url", "h"], "left_anti").select("sale_id")


@query("flt_tracked_only", "SELECT event_id FROM events WHERE user_id IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def tracked_only(spark, d):
    tracked = read(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("user_id"))
    return read(spark, d, "events").join(tracked, "user_id", "left_semi").select("event_id")


@query("flt_minimised_projection", "SELECT doc_id, source, n_chars, sha256(text) AS text_sha256 FROM documents")
def minimised(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("flt_source_policy", "WITH p AS (SELECT DISTINCT source, length(source) % 2 = 0 AS active FROM documents) SELECT doc_id FROM documents JOIN p USING (source) WHERE active")
def source_policy(spark, d):
    docs = read(spark, d, "documents")
    policy = docs.select("source").distinct().withColumn("active", F.char_length("source") % 2 == 0)
    return docs.join(policy.where("active"), "source").select("doc_id")


@query("flt_geo_resolve", "WITH q AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'ville de ' || lower(n_name) WHEN 1 THEN lpad(CAST(c_custkey % 99999 AS VARCHAR), 5, '0') WHEN 2 THEN lower(r_name) ELSE 'inconnu' END AS t FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT id, CASE id % 4 WHEN 0 THEN 'department' WHEN 1 THEN 'postal' WHEN 2 THEN 'region' ELSE 'text' END AS kind FROM q")
def geo_resolve(spark, d):
    places = read(spark, d, "customer").join(read(spark, d, "nation"), c("c_nationkey") == c("n_nationkey")).join(read(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    asked = places.select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 4 == 0, F.concat(F.lit("Ville de "), "n_name")).when(c("c_custkey") % 4 == 1, F.lpad((c("c_custkey") % 99999).cast("string"), 5, "0")).when(c("c_custkey") % 4 == 2, c("r_name")).otherwise("inconnu").alias("q"))
    known = read(spark, d, "nation").select(text.search_norm(c("n_name")).alias("name"), F.lit("department").alias("level")).unionByName(read(spark, d, "region").select(text.search_norm(c("r_name")).alias("name"), F.lit("region").alias("level")))
    return search.resolve_places(asked, known).select("id", "kind")


# reports


@query("agg_json_len_vs_count", "SELECT o_orderkey AS sale_id, o_orderkey % 7 AS listed, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING listed <> n")
def len_vs_count(spark, d):
    parents = read(spark, d, "orders").select(c("o_orderkey").alias("sale_id"), F.slice(F.sequence(F.lit(1), F.lit(7)), 1, (c("o_orderkey") % 7).cast("int")).alias("listed"))
    children = read(spark, d, "lineitem").select(c("l_orderkey").alias("sale_id"))
    return reports.length_mismatch(parents, children, "sale_id", "listed").withColumn("listed", c("listed").cast("bigint"))


@query("agg_dpe_summary", S + "SELECT coalesce(dpe_class, 'none') AS dpe, count(*) AS n, count(*) FILTER (source_name = 'automobile') AS from_automobile, count(*) FILTER (source_name <> 'automobile') AS from_others FROM sales GROUP BY dpe")
def dpe_summary(spark, d):
    return sales(spark, d).groupBy(F.coalesce("dpe_class", F.lit("none")).alias("dpe")).agg(F.count("*").alias("n"), F.count_if(c("source_name") == "automobile").alias("from_automobile"), F.count_if(c("source_name") != "automobile").alias("from_others"))


@query("agg_freshness", "WITH r AS (SELECT max(ts) AS last, max(ts) FILTER (event_type = 'purchase') AS ok, arg_max(event_type, (ts, event_id)) AS status FROM events) SELECT last, ok, status, floor(date_diff('second', ok, TIMESTAMP '2024-02-02 00:00:00') / 3600) AS hours, CASE WHEN ok IS NULL OR date_diff('second', ok, TIMESTAMP '2024-02-02 00:00:00') > 72 * 3600 THEN 'critical' WHEN date_diff('second', ok, TIMESTAMP '2024-02-02 00:00:00') > 36 * 3600 THEN 'watch' ELSE 'healthy' END AS state FROM r")
def freshness(spark, d):
    return reports.freshness(read(spark, d, "events"), "purchase", "2024-02-02 00:00:00")


@query("agg_source_missing", S + f"SELECT source_name, count(*) AS n, {half_up('count(*) / (SELECT count(*) FROM sales) * 100')} AS share_pct, count(*) FILTER (latitude IS NULL OR longitude IS NULL) AS missing_location, count(*) FILTER (coalesce(surface_m2, 0) <= 0) AS missing_surface, count(*) FILTER (documents_count = 0) AS missing_documents, count(*) FILTER (coalesce(trim(description), '') = '') AS missing_description FROM sales GROUP BY source_name ORDER BY n DESC, source_name LIMIT 12")
def source_missing(spark, d):
    return reports.source_missing(sales(spark, d))


@query("agg_health", "SELECT (SELECT count(*) FROM orders) AS sales, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_runs, (SELECT max(ts) FROM events) AS last_run, (SELECT count(*) FROM documents WHERE n_chars = 0) AS empty_documents, (SELECT max(o_orderdate) FROM orders) AS last_sale")
def health(spark, d):
    t = lambda n: read(spark, d, n)
    return reports.one_row([t("orders").agg(F.count("*").alias("sales"), F.max("o_orderdate").alias("last_sale")), t("events").agg(F.count_if(c("event_type") == "error").alias("failed_runs"), F.max("ts").alias("last_run")), t("documents").agg(F.count_if(c("n_chars") == 0).alias("empty_documents"))])


@query("agg_period_bounds", f"WITH {MUTATIONS_CTE} SELECT nature, min(sale_date) AS period_start, max(sale_date) AS period_end FROM mutations GROUP BY nature")
def period_bounds(spark, d):
    return mutations(spark, d).groupBy("nature").agg(F.min("sale_date").alias("period_start"), F.max("sale_date").alias("period_end"))


@query("agg_runtime_health", f"WITH g AS (SELECT user_id, count(*) AS n, {half_up('avg(value)')} AS latency, {half_up('count(*) FILTER (event_type = \'error\') / count(*) * 100')} AS error_pct FROM events GROUP BY user_id) SELECT *, concat_ws(',', CASE WHEN n < 50 THEN 'sample' END, CASE WHEN latency > 50 THEN 'latency' END, CASE WHEN error_pct > 20 THEN 'errors' END) AS signals FROM g")
def runtime_health(spark, d):
    return reports.runtime_health(read(spark, d, "events"), "user_id", c("value"), c("event_type") == "error", 50, 50.0, 20.0)


@query("agg_training_metrics", S + f", p AS (SELECT city, starting_price_eur AS actual, investment_score * 2000e0 AS predicted FROM sales WHERE starting_price_eur > 0 AND investment_score IS NOT NULL), a AS (SELECT city, abs(predicted - actual) / actual * 100 AS ape, actual BETWEEN predicted * 0.5e0 AND predicted * 1.5e0 AS hit FROM p) SELECT city, count(*) AS n, round(avg(ape), 4) AS mape, round(quantile_cont(ape, 0.5), 4) AS median_ape, round(quantile_cont(ape, 0.75), 4) AS p75_ape, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END) * 100, 4) AS coverage FROM a GROUP BY city")
def training_metrics(spark, d):
    p = c("investment_score") * 2000.0
    rows = sales(spark, d).where("starting_price_eur > 0 AND investment_score IS NOT NULL").select("city", c("starting_price_eur").alias("actual"), p.alias("predicted"), (p * 0.5).alias("low"), (p * 1.5).alias("high"))
    return reports.error_metrics(rows, "city")


@query("agg_promotion_gate", S + ", m AS (SELECT sale_id, sale_id % 90 AS rows, sale_id % 45 AS median_ape, sale_id % 60 AS mape, sale_id % 101 AS coverage, sale_id % 140 AS width FROM sales), f AS (SELECT sale_id, concat_ws(',', CASE WHEN rows < 50 THEN 'rows' END, CASE WHEN median_ape > 30 THEN 'median_ape' END, CASE WHEN mape > 40 THEN 'mape' END, CASE WHEN coverage < 72 THEN 'coverage' END, CASE WHEN width > 110 THEN 'width' END) AS failures FROM m) SELECT *, failures = '' AS promoted FROM f")
def promotion_gate(spark, d):
    m = sales(spark, d).selectExpr("sale_id", "sale_id % 90 AS rows", "sale_id % 45 AS median_ape", "sale_id % 60 AS mape", "sale_id % 101 AS coverage", "sale_id % 140 AS width")
    return agg.promotion_gate(m).select("sale_id", "failures", "promoted")


@query("agg_ai_coverage", S + f"SELECT status, count(*) AS n, count(*) FILTER (trim(description) <> '') AS described, {half_up('count(*) FILTER (trim(description) <> chr(32) AND description IS NOT NULL) / count(*) * 100')} AS pct FROM sales GROUP BY status")
def ai_coverage(spark, d):
    has = F.coalesce(F.trim("description") != "", F.lit(False))
    return sales(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(has).alias("described"), num.round_half_up(F.count_if(has) / F.count("*") * 100, 1).alias("pct"))


@query("agg_placement_metrics", "SELECT user_id, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0), 6) AS rate FROM events GROUP BY user_id")
def placement(spark, d):
    views, clicks = F.count_if(c("event_type") == "view"), F.count_if(c("event_type") == "click")
    return read(spark, d, "events").groupBy("user_id").agg(views.alias("impressions"), clicks.alias("clicks"), F.round(clicks / F.nullif(views, F.lit(0)), 6).alias("rate"))


@query("agg_weather_monthly", S + "SELECT CAST(month(sale_date) AS INTEGER) AS month, count(DISTINCT year(sale_date)) AS years, round(avg(surface_m2), 4) AS mean_value, round(count(surface_m2) / count(DISTINCT year(sale_date)), 4) AS per_year FROM sales GROUP BY ALL")
def weather_monthly(spark, d):
    return reports.month_profile(sales(spark, d), "sale_date", c("surface_m2"))


@query("agg_weather_extremes", S + ", m AS (SELECT region, month(sale_date) AS m, sum(documents_count) AS v FROM sales GROUP BY ALL) SELECT region, CAST(arg_max(m, (v, -m)) AS INTEGER) AS top_month, CAST(arg_min(m, (v, m)) AS INTEGER) AS low_month, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY region")
def weather_extremes(spark, d):
    return reports.month_extremes(sales(spark, d), "region", "sale_date", c("documents_count"))


@query("agg_distinct_filtered_array", S + "SELECT city, coalesce(array_to_string(list_sort(list(DISTINCT dpe_class) FILTER (dpe_class IS NOT NULL AND property_type = 'house')), ','), '') AS classes FROM sales GROUP BY city")
def distinct_array(spark, d):
    return sales(spark, d).groupBy("city").agg(F.array_join(F.array_sort(F.collect_set(F.when(c("property_type") == "house", c("dpe_class")))), ",").alias("classes"))


@query("agg_risk_best", "SELECT user_id, event_type AS label, count(*) AS occurrences, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY ALL")
def risk_best(spark, d):
    return read(spark, d, "events").groupBy("user_id", c("event_type").alias("label")).agg(F.count("*").alias("occurrences"), F.max_by("event_id", F.struct("value", -c("event_id"))).alias("best"))


@query("agg_audience_summary", S + f"SELECT region, count(*) AS workspaces, count(*) FILTER (sale_date >= DATE '{NOW}') AS upcoming, count(*) FILTER (sale_date < DATE '{NOW}') AS past, min(sale_date) FILTER (sale_date >= DATE '{NOW}') AS next_audience, CAST(sum(documents_count) AS BIGINT) AS documents FROM sales GROUP BY region")
def audience_summary(spark, d):
    ahead = c("sale_date") >= F.lit(NOW).cast("date")
    return sales(spark, d).groupBy("region").agg(F.count("*").alias("workspaces"), F.count_if(ahead).alias("upcoming"), F.count_if(~ahead).alias("past"), F.min(F.when(ahead, c("sale_date"))).alias("next_audience"), F.sum("documents_count").alias("documents"))


@query("sc_quantile", S + "SELECT city, round(quantile_cont(starting_price_eur, 0.1), 4) AS p10, round(quantile_cont(starting_price_eur, 0.8), 4) AS p80 FROM sales GROUP BY city")
def quantiles(spark, d):
    return sales(spark, d).groupBy("city").agg(F.round(F.percentile("starting_price_eur", 0.1), 4).alias("p10"), F.round(F.percentile("starting_price_eur", 0.8), 4).alias("p80"))


over_sales("agg_checklist", {"done": (lambda: F.size(F.filter(F.array(*(c("sale_id") % k == 0 for k in (2, 3, 5, 7))), lambda x: x)).cast("bigint"), " + ".join(f"CASE WHEN sale_id % {k} = 0 THEN 1 ELSE 0 END" for k in (2, 3, 5, 7))), "progress_pct": (lambda: num.progress_pct(F.size(F.filter(F.array(*(c("sale_id") % k == 0 for k in (2, 3, 5, 7))), lambda x: x)), F.lit(4)), "floor((" + " + ".join(f"CASE WHEN sale_id % {k} = 0 THEN 1 ELSE 0 END" for k in (2, 3, 5, 7)) + ") / 4 * 100 + 5e-1)")})
over_sales("sc_readiness", {"readiness": (lambda: reports.readiness(c("days"), c("blocked"), c("open_items"), c("progress")), "CASE WHEN days IS NULL THEN 'missing_date' WHEN days < 0 THEN 'past' WHEN blocked > 0 THEN 'blocked' WHEN days <= 7 AND open_items > 0 THEN 'urgent' WHEN progress >= 80 THEN 'ready' ELSE 'needs_work' END"), "urgency": (lambda: reports.audience_urgency(c("days")), "CASE WHEN days IS NULL THEN 'unknown' WHEN days < 0 THEN 'past' WHEN days = 0 THEN 'today' WHEN days <= 7 THEN 'week' WHEN days <= 30 THEN 'month' ELSE 'later' END")}, days="CASE WHEN sale_id % 13 > 0 THEN sale_id % 90 - 20 END", blocked="CASE WHEN sale_id % 6 = 0 THEN 1 ELSE 0 END", open_items="sale_id % 3", progress="sale_id % 101")
over_sales("sc_doc_signature", {"signature": (lambda: F.array_join(F.array_sort(F.array_distinct(F.array("source_name", "city", "status"))), "|"), "array_to_string(list_sort(list_distinct([source_name, city, status])), '|')")})
over_sales("sc_media_filter", {"images": (lambda: F.array_join(F.filter(F.array(F.concat("source_url", F.lit(".jpg")), F.concat("source_url", F.lit(".PDF")), F.concat("source_url", F.lit("/logo.png")), F.concat("source_url", F.lit(".webp?x=1"))), reports.is_property_image), ";"), "source_url || '.jpg;' || source_url || '.webp?x=1'")})
over_sales("sc_audit", {"audit": (lambda: reports.audit_score([c("s1"), c("s2"), c("s3")]), "100 - (" + " + ".join(f"CASE s{i} WHEN 'ok' THEN 0 WHEN 'watch' THEN 8 WHEN 'risk' THEN 18 ELSE 15 END" for i in (1, 2, 3)) + ")")}, s1="CASE sale_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'watch' ELSE 'risk' END", s2="CASE sale_id % 5 WHEN 0 THEN 'risk' WHEN 1 THEN 'ok' END", s3="CASE sale_id % 2 WHEN 0 THEN 'ok' ELSE 'watch' END")


SHARES = ["with_price", "with_surface", "with_tribunal", "geocoded", "with_documents", "with_dpe", "scored"]


@query("snk_report", S + f", q AS (SELECT count(*) AS total, {CHECKS} FROM sales) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, '- quality_{n}: ' || CAST({n} AS VARCHAR) || '{'%' if n in SHARES else ''}' AS line FROM q" for n in ["total", *SHARES]))
def quality_lines(spark, d):
    return reports.report_lines(agg.quality_report(sales(spark, d), []), "quality", SHARES)
