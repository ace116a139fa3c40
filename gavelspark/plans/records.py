"""Queries of joins, windows, sets and entity resolution, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import text
from ..operators import aggregates as agg
from ..operators import entities as ent
from ..operators import joins, windows
from ..sources.adapters import MUTATIONS_CTE, SALES_CTE, TRIBUNALS_CTE, line_parts, mutations, read, sales, tribunals
from ..storage import hold
from .queries import NOW, STREET_SQL, half_up
from .registry import query

c = F.col
S = f"WITH {SALES_CTE} "

# entity resolution

RICH = ["address", "postal_code", "tribunal_code", "property_type", "surface_m2", "land_surface_m2", "rooms_count", "bedrooms_count", "occupancy_status", "latitude", "longitude", "investment_score"]
FIELDS = ["title", "surface_m2", "rooms_count", "bedrooms_count", "occupancy_status", "dpe_class"]
RICHNESS = " + ".join(f"CASE WHEN {x} IS NOT NULL{f' AND trim(CAST({x} AS VARCHAR)) <> ' + chr(39) * 2} THEN 1 ELSE 0 END" for x in RICH) + " + least(documents_count, 3)"
RANKED = S + f", r AS (SELECT *, {RICHNESS} AS richness, CASE source_name WHEN 'automobile' THEN 1 WHEN 'building' THEN 2 WHEN 'furniture' THEN 3 WHEN 'household' THEN 4 WHEN 'machinery' THEN 5 ELSE 99 END AS prio FROM sales)"
FILL = lambda f, order: f"coalesce({', '.join(f'first({f} ORDER BY {order}) FILTER ({f} IS NOT NULL AND trim(CAST({f} AS VARCHAR)) <> {chr(39) * 2})' for _ in (0,))}) AS {f}"


def seen(spark, d):
    rows = sales(spark, d)
    return rows.withColumn("richness", ent.richness(rows, RICH, {"documents": c("documents_count")}))


@query("set_richness_pick", RANKED + " SELECT city, address, sale_id, richness FROM (SELECT *, row_number() OVER (PARTITION BY city, address ORDER BY richness DESC, prio, sale_id) AS k FROM r) WHERE k = 1")
def richness_pick(spark, d):
    return ent.pick_richest(seen(spark, d).select("city", "address", "sale_id", "richness", "source_name"), ["city", "address"]).select("city", "address", "sale_id", "richness")


@query("dd_by_url", RANKED + f", b AS (SELECT source_url, arg_min(sale_id, (-richness, sale_id)) AS first_id FROM r GROUP BY source_url) SELECT source_url, min(sale_id) AS sale_id, {', '.join(FILL(f, 'sale_id') for f in FIELDS)}, count(*) AS n FROM r JOIN b USING (source_url) WHERE sale_id >= first_id GROUP BY source_url")
def by_url(spark, d):
    return ent.by_url(seen(spark, d), FIELDS)


HASH = "sha256(lower(concat_ws('|', coalesce(trim(regexp_replace(address, '\\s+', ' ', 'g')), ''), coalesce(city, ''), coalesce(CAST(sale_date AS VARCHAR), ''), coalesce(CAST(starting_price_eur AS VARCHAR), ''))))"
STRONG = "(CASE WHEN address <> '' THEN 1 ELSE 0 END + CASE WHEN city <> '' THEN 1 ELSE 0 END + CASE WHEN postal_code <> '' THEN 1 ELSE 0 END + CASE WHEN sale_date IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(starting_price_eur, 0) <> 0 THEN 1 ELSE 0 END) >= 3"
#: Two sources tell of each sale: the second without address and city for some, and without rooms.
TOLD = "t AS (SELECT * FROM sales UNION ALL SELECT * REPLACE (sale_id + 10000000 AS sale_id, 'machinery' AS source_name, NULL AS rooms_count, CASE WHEN sale_id % 5 = 0 THEN NULL ELSE address END AS address, CASE WHEN sale_id % 10 = 0 THEN NULL ELSE city END AS city, CASE WHEN sale_id % 20 = 0 THEN NULL ELSE postal_code END AS postal_code) FROM sales)"
TOLD_RANKED = S + f", {TOLD}, r AS (SELECT *, {RICHNESS} AS richness, CASE source_name WHEN 'automobile' THEN 1 WHEN 'building' THEN 2 WHEN 'furniture' THEN 3 WHEN 'household' THEN 4 WHEN 'machinery' THEN 5 ELSE 99 END AS prio FROM t)"


def told(spark, d):
    rows = sales(spark, d)
    blank = lambda n, m: F.when(c("sale_id") % m != 0, c(n)).alias(n)
    changed = {"sale_id": (c("sale_id") + 10_000_000).alias("sale_id"), "source_name": F.lit("machinery").alias("source_name"), "rooms_count": F.lit(None).cast(dict(rows.dtypes)["rooms_count"]).alias("rooms_count"), "address": blank("address", 5), "city": blank("city", 10), "postal_code": blank("postal_code", 20)}
    both = rows.unionByName(rows.select(*(changed.get(x, c(x)) for x in rows.columns)))
    return both.withColumn("richness", ent.richness(both, RICH, {"documents": c("documents_count")}))


BY_HASH = f", h AS (SELECT *, {HASH} AS content_hash, CASE WHEN {STRONG} THEN 'content_hash' ELSE 'source_url_only' END AS how FROM r), g AS (SELECT content_hash, how, CASE WHEN how = 'content_hash' THEN 0 ELSE sale_id END AS k, first(sale_id ORDER BY -richness, prio, sale_id) AS sale_id, {', '.join(FILL(f, '-richness, prio, sale_id') for f in FIELDS)}, count(*) AS n FROM h GROUP BY ALL)"


@query("dd_by_hash", TOLD_RANKED + BY_HASH + f" SELECT content_hash, how, sale_id, {', '.join(FIELDS)}, n FROM g")
def by_hash(spark, d):
    return ent.by_hash(told(spark, d), FIELDS)


@query("dd_reconcile", TOLD_RANKED + BY_HASH + " SELECT sale_id FROM r WHERE sale_id NOT IN (SELECT sale_id FROM g)")
def reconcile(spark, d):
    rows = told(spark, d)
    return ent.secondaries(rows, ent.by_hash(rows, FIELDS)).select("sale_id")


@query("dd_merge_fields", RANKED + f", m AS (SELECT city, address, {', '.join(FILL(f, '-richness, prio, sale_id') for f in FIELDS)}, count(*) AS n, string_agg(DISTINCT source_url, ';' ORDER BY source_url) AS source_urls FROM r GROUP BY city, address) SELECT * FROM m")
def merge_fields(spark, d):
    rows = seen(spark, d).withColumn("source_urls", F.array("source_url"))
    return ent.merged(rows, ["city", "address"], ent.preference(), FIELDS, ["source_urls"]).withColumn("source_urls", F.array_join("source_urls", ";"))


@query("dd_by_address")
def by_address(spark, d):
    return ent.by_address(sales(spark, d), hold)


@query("dd_semantic_adjudication", f"WITH {MUTATIONS_CTE} SELECT sale_date, price_eur, parcel_id, min(mutation_id) AS mutation_id, count(*) AS n FROM mutations GROUP BY ALL")
def semantic(spark, d):
    return ent.first_of(mutations(spark, d).select("sale_date", "price_eur", "parcel_id", "mutation_id"), ["sale_date", "price_eur", "parcel_id"], "mutation_id")


@query("set_doc_dedupe", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY content_hash")
def doc_dedupe(spark, d):
    return ent.first_of(read(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id"), ["content_hash"], "doc_id")


@query("set_union_all", S + "SELECT sale_id, 'rooms' AS missing FROM sales WHERE rooms_count IS NULL UNION ALL SELECT sale_id, 'surface' FROM sales WHERE surface_m2 IS NULL")
def union_all(spark, d):
    rows = sales(spark, d)
    return rows.where("rooms_count IS NULL").select("sale_id", F.lit("rooms").alias("missing")).unionByName(rows.where("surface_m2 IS NULL").select("sale_id", F.lit("surface").alias("missing")))


@query("set_unique_ordered", S + ", l AS (SELECT sale_id, list_filter([city, region, status, city, source_name, region], lambda x: x <> '') AS l FROM sales) SELECT sale_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS vals FROM l")
def unique_ordered(spark, d):
    values = F.array_distinct(F.filter(F.concat(F.array("city", "region", "status"), F.array("city", "source_name", "region")), lambda x: x != ""))
    return sales(spark, d).select("sale_id", F.array_join(values, ",").alias("vals"))


# joins

LOTS = S + f", {MUTATIONS_CTE}, cand AS (SELECT mutation_id AS candidate_id, min(sale_date) AS c_date, list(DISTINCT parcel_id) AS c_parcels FROM mutations GROUP BY mutation_id)"


def candidate_pairs(spark, d):
    """Register mutations beside lots (sales): the lot of the same number has its parcels (but for some) and a date that is off by some days."""
    cand = mutations(spark, d).groupBy("mutation_id").agg(F.min("sale_date").alias("c_date"), F.collect_set("parcel_id").alias("c_parcels"))
    lots = sales(spark, d, deal=True)
    pairs = cand.join(lots, cand["mutation_id"] == lots["sale_id"])
    other = F.when(c("sale_id") % 4 > 0, c("c_parcels")).otherwise(F.array(F.lit("x")))
    return pairs.select("sale_id", "c_date", "c_parcels", other.alias("l_parcels"), F.date_add("c_date", (c("sale_id") % 45).cast("int")).alias("l_date"), c("address").alias("c_address"), F.when(c("sale_id") % 3 > 0, c("address")).alias("l_address"), c("department").alias("c_insee"), F.when(c("sale_id") % 2 == 0, c("department")).alias("l_insee"), c("postal_code").alias("c_postal"), c("postal_code").alias("l_postal"), c("city").alias("c_city"), c("city").alias("l_city"))


PARCEL, DAYS, ADDRESS, INSEE = "(sale_id % 4 > 0)", "(sale_id % 45)", "(sale_id % 3 > 0)", "(sale_id % 2 = 0)"
POINTS = f"(CASE WHEN {PARCEL} THEN 6500 ELSE 0 END + CASE WHEN {DAYS} = 0 THEN 2000 WHEN {DAYS} <= 30 THEN 1200 ELSE 500 END + CASE WHEN {ADDRESS} THEN 1000 ELSE 0 END + CASE WHEN {INSEE} THEN 500 ELSE 300 END)"


@query("set_match_dvf", LOTS + f", m AS (SELECT sale_id, least(CASE WHEN {PARCEL} THEN {POINTS} ELSE least({POINTS}, 4900) END, 10000) AS pts FROM sales JOIN cand ON candidate_id = sale_id) SELECT sale_id, CAST(pts / 10000 AS DECIMAL(5,4)) AS match_score, CASE WHEN {PARCEL} AND {DAYS} <= 30 AND pts >= 7500 THEN 'parcel_and_date' WHEN {PARCEL} THEN 'parcel' WHEN {ADDRESS} AND {DAYS} <= 30 THEN 'address_and_date' ELSE 'insufficient_signals' END AS match_method, CASE WHEN {PARCEL} AND {DAYS} <= 30 AND pts >= 7500 THEN 'strong_candidate' WHEN {PARCEL} OR ({ADDRESS} AND {DAYS} <= 30) THEN 'review_required' ELSE 'weak_candidate' END AS match_status FROM m")
def match_dvf(spark, d):
    return ent.register_match(candidate_pairs(spark, d)).select("sale_id", "match_score", "match_method", "match_status")


@query("join_match_context", S + f", {MUTATIONS_CTE}, c AS (SELECT DISTINCT mutation_id AS candidate_id, parcel_id, sale_date AS cd, mutation_id % 997 AS ak, lpad(CAST(mutation_id % 5003 AS VARCHAR), 5, '0') AS pc, lpad(CAST(mutation_id % 6007 AS VARCHAR), 5, '0') AS ic, 'ville ' || (mutation_id % 7001) AS ct FROM mutations), l AS (SELECT sale_id AS lot_id, lpad(CAST(sale_id % 4000 AS VARCHAR), 14, '0') AS parcel_id, sale_date AS ld, sale_id % 997 AS ak, lpad(CAST(sale_id % 5003 AS VARCHAR), 5, '0') AS pc, lpad(CAST(sale_id % 6007 AS VARCHAR), 5, '0') AS ic, 'VILLE ' || (sale_id % 7001) AS ct FROM sales) SELECT DISTINCT candidate_id, lot_id FROM c JOIN l USING (parcel_id) UNION SELECT DISTINCT candidate_id, lot_id FROM c JOIN l ON c.ak = l.ak AND abs(date_diff('day', cd, ld)) <= 30 UNION SELECT DISTINCT candidate_id, lot_id FROM c JOIN l ON c.pc = l.pc AND abs(date_diff('day', cd, ld)) <= 30 UNION SELECT DISTINCT candidate_id, lot_id FROM c JOIN l ON c.ic = l.ic AND abs(date_diff('day', cd, ld)) <= 30 UNION SELECT DISTINCT candidate_id, lot_id FROM c JOIN l ON lower(c.ct) = lower(l.ct) AND abs(date_diff('day', cd, ld)) <= 30")
def match_context(spark, d):
    pc = lambda x: F.lpad((c(x) % 5003).cast("string"), 5, "0").alias("postal_code")
    ic = lambda x: F.lpad((c(x) % 6007).cast("string"), 5, "0").alias("insee_code")
    city = lambda x, name: F.concat(F.lit(name), (c(x) % 7001).cast("string")).alias("city")
    cand = mutations(spark, d).select(c("mutation_id").alias("candidate_id"), "parcel_id", c("sale_date").alias("candidate_date"), (c("mutation_id") % 997).alias("address_key"), pc("mutation_id"), ic("mutation_id"), city("mutation_id", "ville "))
    lots = sales(spark, d).select(c("sale_id").alias("lot_id"), F.lpad((c("sale_id") % 4000).cast("string"), 14, "0").alias("parcel_id"), c("sale_date").alias("lot_date"), (c("sale_id") % 997).alias("address_key"), pc("sale_id"), ic("sale_id"), city("sale_id", "VILLE "))
    return joins.match_contexts(cand, lots)


@query("join_interval_date", S + f", {MUTATIONS_CTE} SELECT DISTINCT mutation_id, sale_id, CAST(abs(date_diff('day', line_date, s.sale_date)) AS INTEGER) AS days FROM mutations m JOIN sales s ON m.mutation_id = s.sale_id WHERE abs(date_diff('day', line_date, s.sale_date)) <= 30")
def interval_date(spark, d):
    m, s = mutations(spark, d).select("mutation_id", "line_date"), sales(spark, d, deal=True).select("sale_id", "sale_date")
    days = F.abs(F.datediff("line_date", "sale_date"))
    return m.join(s, (c("mutation_id") == c("sale_id")) & (days <= 30)).select("mutation_id", "sale_id", days.alias("days")).distinct()


@query("join_nearest_round", "WITH r AS (SELECT l_orderkey AS case_id, CAST(o_orderdate AS DATE) AS lot_date, CAST(l_shipdate AS DATE) AS round_date, l_linenumber AS seq, l_partkey AS round_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT case_id, arg_min(round_id, (abs(date_diff('day', lot_date, round_date)), -seq, round_id)) AS round_id, arg_min(round_date, (abs(date_diff('day', lot_date, round_date)), -seq, round_id)) AS round_date FROM r GROUP BY case_id")
def nearest_round(spark, d):
    lots = read(spark, d, "orders").select(c("o_orderkey").alias("case_id"), c("o_orderkey").alias("lot_id"), F.to_date("o_orderdate").alias("lot_date"))
    rounds = read(spark, d, "lineitem").select(c("l_orderkey").alias("case_id"), c("l_partkey").alias("round_id"), c("l_linenumber").alias("sequence"), F.to_date("l_shipdate").alias("round_date"))
    return joins.nearest_round(lots, rounds, "case_id").select("case_id", "round_id", "round_date")


LOOSE = f"concat_ws('|', {STREET_SQL}, city, CAST(year(sale_date) AS VARCHAR))"


@query("join_source_compare", S + f", k AS (SELECT *, sha256(lower(concat_ws('|', coalesce(address, ''), coalesce(city, ''), coalesce(CAST(sale_date AS VARCHAR), '')))) AS ek, {LOOSE} AS lk FROM sales), l AS (SELECT * FROM k WHERE source_name = 'automobile'), r AS (SELECT * FROM k WHERE source_name = 'building'), e AS (SELECT a.id AS sale_id, b.id AS other_id FROM (SELECT ek, min(sale_id) AS id FROM l GROUP BY ek) a JOIN (SELECT ek, min(sale_id) AS id FROM r GROUP BY ek) b USING (ek)), l2 AS (SELECT * FROM l WHERE sale_id NOT IN (SELECT sale_id FROM e)), r2 AS (SELECT * FROM r WHERE sale_id NOT IN (SELECT other_id FROM e)), o AS (SELECT a.id AS sale_id, b.id AS other_id FROM (SELECT lk, min(sale_id) AS id FROM l2 GROUP BY lk) a JOIN (SELECT lk, min(sale_id) AS id FROM r2 GROUP BY lk) b USING (lk)) SELECT sale_id, other_id, 'exact' AS how FROM e UNION ALL SELECT sale_id, other_id, 'loose' FROM o UNION ALL SELECT sale_id, NULL, 'left_only' FROM l2 WHERE sale_id NOT IN (SELECT sale_id FROM o) UNION ALL SELECT NULL, sale_id, 'right_only' FROM r2 WHERE sale_id NOT IN (SELECT other_id FROM o)")
def source_compare(spark, d):
    rows = sales(spark, d)
    return joins.source_compare(rows.where("source_name = 'automobile'"), rows.where("source_name = 'building'"), joins.exact_key(), joins.loose_key())


STATS = ", stats AS (SELECT {0} AS k, count(*) AS n, round(median(starting_price_eur), 2) AS m FROM sales WHERE starting_price_eur > 0 AND property_type = 'house' GROUP BY k)"


@query("join_geo_fallback", S + ", p AS (SELECT * FROM sales WHERE starting_price_eur > 0), a AS (SELECT postal_code AS k, count(*) AS n, round(median(starting_price_eur), 2) AS m FROM p GROUP BY k), b AS (SELECT department AS k, count(*) AS n, round(median(starting_price_eur), 2) AS m FROM p GROUP BY k), e AS (SELECT region AS k, count(*) AS n, round(median(starting_price_eur), 2) AS m FROM p GROUP BY k), j AS (SELECT sale_id, a.n AS an, a.m AS am, b.n AS bn, b.m AS bm, e.n AS en, e.m AS em FROM sales LEFT JOIN a ON postal_code = a.k LEFT JOIN b ON department = b.k LEFT JOIN e ON region = e.k), s AS (SELECT *, CASE WHEN an >= 50 THEN 'postal' WHEN bn >= 560 THEN 'department' WHEN en >= 3000 THEN 'region' WHEN coalesce(an, 0) = greatest(coalesce(an, 0), coalesce(bn, 0), coalesce(en, 0)) AND an > 0 THEN 'postal' WHEN coalesce(bn, 0) = greatest(coalesce(an, 0), coalesce(bn, 0), coalesce(en, 0)) AND bn > 0 THEN 'department' WHEN en > 0 THEN 'region' END AS scope FROM j) SELECT sale_id, scope, CASE scope WHEN 'postal' THEN am WHEN 'department' THEN bm WHEN 'region' THEN em END AS value FROM s")
def geo_fallback(spark, d):
    rows = sales(spark, d)
    stats = lambda key: rows.where("starting_price_eur > 0").groupBy(key).agg(F.count("*").alias("n"), F.round(F.median("starting_price_eur"), 2).alias("median_price"))
    levels = [("postal", stats("postal_code"), "postal_code", 50), ("department", stats("department"), "department", 560), ("region", stats("region"), "region", 3000)]
    return joins.geo_fallback(rows.select("sale_id", "postal_code", "department", "region"), levels).select("sale_id", "scope", "value")


@query("join_semi_exists", "WITH n AS (SELECT max(ts) AS now FROM events) SELECT DISTINCT user_id FROM events, n WHERE event_type = 'purchase' AND ts >= now - INTERVAL 48 HOUR")
def semi_exists(spark, d):
    events = read(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    sources = events.select(c("user_id").alias("source")).distinct().join(F.broadcast(now), F.lit(True))
    jobs = events.where("event_type = 'purchase'").select(c("user_id").alias("source"), c("ts").alias("finished_at"))
    return joins.recent_success(jobs, sources, 48).select(c("source").alias("user_id"))


@query("join_lawyer_directory", f"WITH {SALES_CTE}, {TRIBUNALS_CTE}, r AS (SELECT DISTINCT tribunal_code AS code FROM sales WHERE tribunal_code IS NOT NULL AND region = 'EUROPE') SELECT code, 'referenced' AS origin FROM r UNION ALL SELECT code, 'open data' FROM tribunals WHERE code NOT IN (SELECT code FROM r)")
def lawyer_directory(spark, d):
    referenced = sales(spark, d).where("tribunal_code IS NOT NULL AND region = 'EUROPE'").select(c("tribunal_code").alias("code")).distinct().withColumn("origin", F.lit("referenced"))
    return joins.directory_union(referenced, tribunals(spark, d).select("code", F.lit("open data").alias("origin")), "code")


@query("join_cross_unnest", "WITH e AS (SELECT event_id, split(regexp_replace(props, '[^0-9,]', '', 'g') || ',' || event_type, ',') AS l FROM events) SELECT event_id, unnest(l) AS item FROM e")
def cross_unnest(spark, d):
    items = F.split(F.concat_ws(",", F.regexp_replace("props", "[^0-9,]", ""), "event_type"), ",")
    return read(spark, d, "events").select("event_id", F.explode_outer(items).alias("item"))


@query("join_hash_map", S + "SELECT e.user_id, e.event_id, s.sale_id, s.city FROM events e JOIN sales s ON s.sale_id = e.event_id WHERE e.event_type = 'click'")
def hash_map(spark, d):
    marks = read(spark, d, "events").where("event_type = 'click'").select("user_id", "event_id", c("event_id").alias("sale_id"))
    return marks.join(sales(spark, d).select("sale_id", "city"), "sale_id")


@query("join_unique_ref", f"WITH {SALES_CTE}, {TRIBUNALS_CTE} SELECT count(*) AS n, count(code) AS matched, count(*) - count(code) AS unmatched, (SELECT count(*) - count(DISTINCT code) FROM tribunals) AS repeated_keys FROM sales LEFT JOIN tribunals ON tribunal_code = code")
def unique_ref(spark, d):
    return joins.matched_counts(sales(spark, d), tribunals(spark, d), "tribunal_code", "code")


@query("join_values_inline", "WITH v(event_type, max_minutes) AS (VALUES ('click', 45), ('view', 120), ('purchase', 1500)), n AS (SELECT max(ts) AS now FROM events) SELECT v.event_type, max_minutes, coalesce(date_diff('second', max(e.ts), max(now)) > max_minutes * 60, TRUE) AS late FROM v LEFT JOIN events e USING (event_type), n GROUP BY v.event_type, max_minutes")
def values_inline(spark, d):
    events = read(spark, d, "events")
    expected = spark.createDataFrame([("click", 45), ("view", 120), ("purchase", 1500)], "event_type string, max_minutes int")
    return joins.late_jobs(expected, events.select("event_type", "ts"), events.agg(F.max("ts").alias("now")))


@query("join_parcel_self", f"WITH {MUTATIONS_CTE}, m AS (SELECT DISTINCT mutation_id, parcel_id, sale_date, price_eur FROM mutations) SELECT a.mutation_id, a.parcel_id, count(*) AS earlier, max(b.sale_date) AS last_sale FROM m a JOIN m b ON a.parcel_id = b.parcel_id AND b.sale_date < a.sale_date GROUP BY ALL")
def parcel_self(spark, d):
    m = mutations(spark, d).select("mutation_id", "parcel_id", "sale_date").distinct()
    return joins.earlier_rows(m, "parcel_id", "mutation_id", "sale_date", line_parts(spark, d))


@query("join_watch_union", S + "SELECT user_id, sale_id, string_agg(DISTINCT kind, '+' ORDER BY kind) AS kinds FROM (SELECT user_id, event_id AS sale_id, 'favourite' AS kind FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 'alert' FROM events WHERE value > 50 UNION ALL SELECT user_id, event_id, 'workspace' FROM events WHERE event_type = 'view') JOIN sales USING (sale_id) GROUP BY ALL")
def watch_union(spark, d):
    e = read(spark, d, "events").select("user_id", c("event_id").alias("sale_id"), "event_type", "value")
    kinds = {"favourite": "event_type = 'click'", "alert": "value > 50", "workspace": "event_type = 'view'"}
    return joins.watches({k: e.where(w).select("user_id", "sale_id") for k, w in kinds.items()}, sales(spark, d).select("sale_id"))


@query("join_sync_deactivate", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'delete' WHEN vec_id % 2 = 0 THEN 'update' ELSE 'insert' END AS action FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 0 OR vec_id % 3 <> 0")
def sync_deactivate(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id")
    return joins.sync_actions(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 3 <> 0"), "vec_id")


@query("join_alerts_zones", S + ", z AS (SELECT n_nationkey AS zone_id, n_name AS city, 44e0 + n_nationkey / 10e0 AS lat, 1e0 + n_nationkey / 10e0 AS lng, 20e0 AS km FROM nation) SELECT zone_id, sale_id FROM z JOIN sales s ON s.city = z.city WHERE latitude IS NOT NULL AND 2 * 6371e0 * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lng) / 2), 2))) <= km * 5")
def alerts_zones(spark, d):
    zones = read(spark, d, "nation").selectExpr("n_nationkey AS zone_id", "n_name AS zone_city", "44e0 + n_nationkey / 10e0 AS lat", "1e0 + n_nationkey / 10e0 AS lng", "100e0 AS km")
    return joins.zones_of(zones, sales(spark, d)).select("zone_id", "sale_id")


# windows


@query("win_latest_per_parcel", f"WITH {MUTATIONS_CTE} SELECT parcel_id, arg_max(mutation_id, (sale_date, mutation_id)) AS mutation_id, max(sale_date) AS sale_date FROM mutations GROUP BY parcel_id")
def latest_per_parcel(spark, d):
    return windows.latest_by(mutations(spark, d).select("parcel_id", "mutation_id", "sale_date"), "parcel_id", c("sale_date"), c("mutation_id"))


@query("win_nearest_per_mutation", f"WITH {MUTATIONS_CTE}, m AS (SELECT mutation_id, line_no, parcel_id, round({{}}, 3) AS metres FROM mutations) SELECT mutation_id, min(metres) AS metres, arg_min(parcel_id, (metres, line_no, parcel_id)) AS parcel_id FROM m GROUP BY mutation_id".format("2 * 6371000e0 * asin(sqrt(pow(sin(radians(44.2e0 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(44.2e0)) * pow(sin(radians(7e-1 - longitude) / 2), 2)))"))
def nearest_per_mutation(spark, d):
    m = mutations(spark, d).withColumn("metres", F.round(num.haversine_m(c("latitude"), c("longitude"), F.lit(44.2), F.lit(0.7)), 3))
    near = m.groupBy("mutation_id").agg(F.min_by(F.struct("metres", "parcel_id"), F.struct("metres", "line_no", "parcel_id")).alias("b"))
    return near.select("mutation_id", "b.metres", "b.parcel_id")


@query("win_distinct_on", S + "SELECT DISTINCT ON (source_url) source_url, sale_id, source_name FROM sales ORDER BY source_url, investment_score DESC NULLS LAST, sale_id")
def distinct_on(spark, d):
    rows = sales(spark, d).select("source_url", "sale_id", "source_name", "investment_score")
    return windows.latest_by(rows, "source_url", F.coalesce("investment_score", F.lit(-1)), -c("sale_id")).select("source_url", "sale_id", "source_name")


ISLANDS = "WITH e AS (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS b FROM events), f AS (SELECT *, CASE WHEN b IS DISTINCT FROM event_type OR b IS NULL THEN 1 ELSE 0 END AS st FROM e), g AS (SELECT *, sum(st) OVER (ORDER BY event_id) AS k FROM f)"


@query("win_contiguous_group", ISLANDS + " SELECT event_id, min(event_id) OVER (PARTITION BY k) AS island FROM g")
def contiguous_group(spark, d):
    return windows.islands(read(spark, d, "events").select("event_id", "event_type"), "event_id", c("event_type")).select("event_id", "island")


@query("win_occurrence_no", ISLANDS + " SELECT event_id, CAST(sum(st) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS occurrence FROM g")
def occurrence_no(spark, d):
    return windows.islands(read(spark, d, "events").select("event_id", "event_type"), "event_id", c("event_type")).select("event_id", "occurrence")


@query("win_singleton", f"WITH {MUTATIONS_CTE} SELECT mutation_id, any_value(parcel_id) AS parcel_id FROM mutations GROUP BY mutation_id HAVING count(*) = 1")
def singleton(spark, d):
    return windows.singletons(mutations(spark, d).select("mutation_id", "parcel_id"), "mutation_id")


@query("win_chrono_split", S + ", r AS (SELECT sale_id, row_number() OVER (ORDER BY sale_date, sale_id) - 1 AS p, count(*) OVER () AS n FROM sales), e AS (SELECT *, greatest(1, floor(n * 0.7e0)) AS t FROM r) SELECT sale_id, CASE WHEN p < t THEN 'train' WHEN p < least(greatest(t + 1, floor(n * (0.7e0 + 0.15e0))), n - 1) THEN 'calibration' ELSE 'test' END AS part FROM e")
def chrono_split(spark, d):
    return windows.chronological_split(sales(spark, d).select("sale_id", "sale_date"), "sale_date", "sale_id").select("sale_id", "part")


CHANGED = "WITH e AS (SELECT *, lag(event_type) OVER w AS bt, lag(round(value)) OVER w AS bv, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT event_id, concat_ws(',', CASE WHEN event_type IS DISTINCT FROM bt THEN 'event_type' END, CASE WHEN round(value) IS DISTINCT FROM bv THEN 'level' END) AS changed FROM e WHERE k > 1)"


@query("win_change_previous", CHANGED + " SELECT * FROM f WHERE changed <> ''")
def change_previous(spark, d):
    e = read(spark, d, "events").withColumn("level", F.round("value"))
    return windows.changes(e, "user_id", ["ts", "event_id"], ["event_type", "level"]).select("event_id", "changed")


@query("win_history_log", "WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_row, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT event_id, user_id, old_row, event_type AS new_row FROM e WHERE k > 1 AND old_row IS DISTINCT FROM event_type")
def history_log(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.changes(e, "user_id", ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", c("before_event_type").alias("old_row"), c("event_type").alias("new_row"))
