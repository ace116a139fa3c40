"""Joins of the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import haversine_m
from ..functions.text import content_hash, street_key

c = F.col


def with_tribunal(sales: DataFrame, tribunals: DataFrame) -> DataFrame:
    """Left equi-join; Spark broadcasts the dimension by its measured size."""
    return sales.join(tribunals.withColumnRenamed("code", "tribunal_code"), "tribunal_code", "left")


def with_children(parents: DataFrame, children: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """Left join of children gathered (sorted) by key beforehand; an empty array where there are none."""
    gathered = children.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))
    return parents.join(gathered, key, "left").withColumn(name, F.coalesce(name, F.array().cast(gathered.schema[name].dataType)))


def source_compare(left: DataFrame, right: DataFrame, exact: Column, loose: Column) -> DataFrame:
    """sale_id, other_id, how: exact, then loose matches of what is left, then left-only and right-only. The first id of a key counts on either side."""
    first = lambda d, k: d.withColumn("k", k).groupBy("k").agg(F.min("sale_id").alias("id"))
    le, re_ = first(left, exact), first(right, exact)
    hit = le.withColumnRenamed("id", "sale_id").join(re_.withColumnRenamed("id", "other_id"), "k").select("sale_id", "other_id", F.lit("exact").alias("how"))
    l2 = left.join(hit.select("sale_id"), "sale_id", "left_anti")
    r2 = right.join(hit.select(c("other_id").alias("sale_id")), "sale_id", "left_anti")
    loosely = first(l2, loose).withColumnRenamed("id", "sale_id").join(first(r2, loose).withColumnRenamed("id", "other_id"), "k").select("sale_id", "other_id", F.lit("loose").alias("how"))
    none = F.lit(None).cast("bigint")
    only_l = l2.join(loosely.select("sale_id"), "sale_id", "left_anti").select("sale_id", none.alias("other_id"), F.lit("left_only").alias("how"))
    only_r = r2.join(loosely.select(c("other_id").alias("sale_id")), "sale_id", "left_anti").select(none.alias("sale_id"), c("sale_id").alias("other_id"), F.lit("right_only").alias("how"))
    return hit.unionByName(loosely).unionByName(only_l).unionByName(only_r)


def exact_key() -> Column:
    return content_hash(c("address"), c("city"), c("sale_date"))


def loose_key() -> Column:
    return F.concat_ws("|", street_key(c("address")), c("city"), F.year("sale_date").cast("string"))


def within_radius(subjects: DataFrame, points: DataFrame, radius_m: float, residual: Column | None = None, on: list[str] | None = None, widen_points: bool = False, parts: int | None = None) -> DataFrame:
    """Pairs at most radius_m apart. Both have id, latitude, longitude (points: point_ before these), and may share further key columns (on), such as a type. Cells are as wide as the radius in latitude; their width in longitude is that of the radius at the far edge of their band of latitude, so a subject's own and the eight around it (in the bands above and below by these bands' widths) hold all points: an equi-join, with the true distance as residual (asked only where the latitudes allow it). With widen_points it is each point that goes to its nine cells: for points that are fewer than the subjects. parts: over how many partitions cells are dealt, where what is made of the pairs outweighs what is read."""
    step = radius_m / 111_000
    band = lambda lat: F.floor(lat / step)
    widest = lambda y: F.greatest(F.abs(y), F.abs(y + 1)) * step
    width = lambda y: F.lit(step * 1.01) / F.greatest(F.cos(F.radians(F.least(widest(y) + step, F.lit(89.9)))), F.lit(1e-3))
    own = lambda p: F.struct(band(c(f"{p}latitude")).alias("cy"), F.floor(c(f"{p}longitude") / width(band(c(f"{p}latitude")))).alias("cx"))
    around = lambda p: [F.struct((band(c(f"{p}latitude")) + i).alias("cy"), (F.floor(c(f"{p}longitude") / width(band(c(f"{p}latitude")) + i)) + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    celled = lambda rows, p, widen: rows.where(f"{p}latitude IS NOT NULL AND {p}longitude IS NOT NULL").select("*", F.inline(F.array(*(around(p) if widen else [own(p)]))))
    dealt = lambda rows: rows.repartition(parts, "cy", "cx") if parts else rows
    left, right = dealt(celled(subjects, "", not widen_points)), dealt(celled(points, "point_", widen_points))
    d = haversine_m(c("latitude"), c("longitude"), c("point_latitude"), c("point_longitude"))
    pairs = left.join(right, ["cy", "cx", *(on or [])]).where(F.abs(c("latitude") - c("point_latitude")) <= step).withColumn("distance_m", d).where(c("distance_m") <= radius_m)
    return (pairs if residual is None else pairs.where(residual)).drop("cy", "cx")


#: Ids that one row of a place holds at about most.
CHUNK = 1000


def gathered(rows: DataFrame, at: list[str], key: str, item: Column | str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of a place (at) as an array of what item says of each; in chunks, told apart by a hash of key, where they are many."""
    crowded = rows.groupBy(*at).agg(F.ceil(F.count("*") / chunk).alias("_chunks")).where("_chunks > 1")
    part = F.coalesce(F.pmod(F.xxhash64(key), c("_chunks")), F.lit(0))
    return rows.join(crowded, at, "left").groupBy(*at, part.alias("_chunk")).agg(F.collect_list(item).alias(name)).drop("_chunk")


def neighbours(rows: DataFrame, radius_m: float, parts: int, chunk: int = CHUNK) -> DataFrame:
    """sale_id, point_id, distance_m: all pairs of different sales at most radius_m apart, with the distance to two decimals. Places are paired, not rows: a distance is asked once for two places, whose ids are then spelt out against each other. Ids of a place lie in chunks, told apart by a hash where they are many."""
    placed = rows.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("sale_id", "latitude", "longitude")
    places = gathered(placed, ["latitude", "longitude"], "sale_id", "sale_id", "ids", chunk)
    near = within_radius(places, places.toDF("point_latitude", "point_longitude", "point_ids"), radius_m, parts=parts)
    one = near.select(F.explode("ids").alias("sale_id"), "point_ids", F.round("distance_m", 2).alias("distance_m"))
    return one.select("sale_id", F.explode("point_ids").alias("point_id"), "distance_m").where("sale_id <> point_id")


def as_of(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, value: str) -> DataFrame:
    """left beside the value of right's last row of its key strictly before its own date.

    The running last value goes over the distinct (key, date) pairs of both sides, which days bound, not over rows; it is joined back by key and date, which Spark can split where a key is hot.
    """
    latest = right.groupBy(key, c(right_date).alias("_d")).agg(F.max(value).alias("_v"))
    asked = left.select(key, c(left_date).alias("_d")).distinct().withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    days = asked.unionByName(latest).withColumn("_n", F.unix_date("_d"))
    w = Window.partitionBy(key).orderBy("_n").rangeBetween(Window.unboundedPreceding, -1)
    found = days.withColumn("as_of_value", F.last("_v", ignorenulls=True).over(w)).groupBy(key, "_d").agg(F.max("as_of_value").alias("as_of_value"))
    return left.withColumn("_d", c(left_date)).join(found, [key, "_d"], "left").drop("_d")


def nearest_round(lots: DataFrame, rounds: DataFrame, key: str) -> DataFrame:
    """The round with the least distance in days, then the highest sequence."""
    pairs = lots.join(rounds, key)
    best = F.min_by(F.struct("round_id", "round_date"), F.struct(F.abs(F.datediff("lot_date", "round_date")), -c("sequence"), c("round_id")))
    return pairs.groupBy(key, "lot_id").agg(best.alias("b")).select(key, "lot_id", "b.round_id", "b.round_date")


#: Columns that a candidate and a lot may agree in, near in time; how many days near is, and how many a span of the join holds.
CONTEXTS, NEAR, SPAN = ["address_key", "insee_code", "postal_code", "city"], 30, 90


def match_contexts(candidates: DataFrame, lots: DataFrame) -> DataFrame:
    """Pairs that agree in parcel, or lie within NEAR days and agree in address, commune (insee_code), postal code or city (whatever its case), each pair once. Of CONTEXTS those are compared that both sides have.

    Each id is one row with its parcels and contexts in arrays; an equi-join for each way to agree (an OR in a join would compare all pairs), with spans of days in the key. A pair is kept where the first of all ways in which it agrees is met, which its two rows tell by themselves: pairs are never gathered to be told apart.
    """
    keys = [k for k in CONTEXTS if k in candidates.columns and k in lots.columns]

    def own(rows: DataFrame, p: str) -> DataFrame:
        told = lambda k: (F.lower(k) if k == "city" else c(k)).alias(k)
        return rows.groupBy(f"{p}_id").agg(F.sort_array(F.collect_set("parcel_id")).alias(f"{p}_parcels"), F.sort_array(F.collect_set(F.struct(c(f"{p}_date").alias("date"), *(told(k) for k in keys)))).alias(f"{p}_contexts"))

    left, right = own(candidates, "candidate"), own(lots, "lot")
    near = lambda x, y: F.abs(F.datediff(x["date"], y["date"])) <= NEAR
    one = lambda p: F.get(f"{p}_contexts", F.lit(0))
    plain = (F.size("candidate_contexts") == 1) & (F.size("lot_contexts") == 1)

    def agree(k: str) -> Column:
        """Whether a pair agrees in k at all: of two ids with one context each without a look at arrays."""
        same = lambda x, y: F.coalesce(near(x, y) & (x[k] == y[k]), F.lit(False))
        several = F.exists("candidate_contexts", lambda x: F.exists("lot_contexts", lambda y: same(x, y)))
        return F.when(plain, same(one("candidate"), one("lot"))).otherwise(several)

    def told_to(rows: DataFrame, p: str, upto: int) -> DataFrame:
        """Rows whose contexts have the keys that a join asks for: dates and the first of them."""
        return rows.select(f"{p}_id", F.array_distinct(F.transform(f"{p}_contexts", lambda x: F.struct(x["date"].alias("date"), *(x[k].alias(k) for k in keys[:upto])))).alias(f"{p}_contexts"))

    out = None
    for i, k in enumerate(keys):
        day = lambda x: F.unix_date(x["date"])
        spans = lambda x: F.transform(F.sequence(F.floor((day(x) - NEAR) / SPAN), F.floor((day(x) + NEAR) / SPAN)), lambda s: F.struct(x[k].alias("_key"), s.alias("span")))  # noqa: B023, E731
        there = lambda x: x[k].isNotNull() & x["date"].isNotNull()  # noqa: B023, E731
        some = told_to(left, "candidate", i + 1).select("*", F.inline(F.array_distinct(F.flatten(F.transform(F.filter("candidate_contexts", there), spans)))))
        others = told_to(right, "lot", i + 1).select("*", F.inline(F.array_distinct(F.transform(F.filter("lot_contexts", there), lambda y: F.struct(y[k].alias("_key"), F.floor(day(y) / SPAN).alias("span"))))))  # noqa: B023
        # the first key and span of a pair with several contexts: the least at which both meet near in time
        met = lambda x, y: F.when(near(x, y) & (x[k] == y[k]), F.struct(x[k].alias("_key"), F.floor(day(y) / SPAN).alias("span")))  # noqa: B023, E731
        first = F.array_min(F.flatten(F.transform("candidate_contexts", lambda x: F.transform("lot_contexts", lambda y: met(x, y)))))  # noqa: B023
        here = F.when(plain, near(one("candidate"), one("lot"))).otherwise((first["_key"] == c("_key")) & (first["span"] == c("span")))
        found = some.join(others, ["_key", "span"]).where(here)
        for before in keys[:i]:
            found = found.where(~agree(before))
        found = found.select("candidate_id", "lot_id")
        out = found if out is None else out.union(found)
    several = lambda p: F.when(F.size(f"{p}_parcels") > 1, c(f"{p}_parcels")).alias(f"{p}_parcels")
    each = lambda rows, p: rows.select(f"{p}_id", f"{p}_contexts", several(p), F.explode(f"{p}_parcels").alias("parcel_id"))
    first = F.array_min(F.array_intersect("candidate_parcels", "lot_parcels"))  # null where one of both has a single parcel
    found = each(left, "candidate").join(each(right, "lot"), "parcel_id").where(F.coalesce(c("parcel_id") == first, F.lit(True)))
    for k in keys:
        found = found.where(~agree(k))
    found = found.select("candidate_id", "lot_id")
    return found if out is None else out.union(found)


def match_score(pairs: DataFrame) -> DataFrame:
    """Weights of a register match; without the parcel .49 at most; strong: parcel, 30 days and .75."""
    days = F.abs(F.datediff("candidate_date", "lot_date"))
    parcel = c("candidate_parcel") == c("lot_parcel")
    score = (
        F.when(parcel, 65).otherwise(0)
        + F.when(days == 0, 20).when(days <= 30, 12).when(days <= 180, 5).otherwise(0)
        + F.when(c("candidate_address") == c("lot_address"), 10).otherwise(0)
        + F.when(c("candidate_postal") == c("lot_postal"), 3).otherwise(0)
    )
    capped = F.when(F.coalesce(parcel, F.lit(False)), score).otherwise(F.least(score, F.lit(49)))
    status = F.when(F.coalesce(parcel, F.lit(False)) & (days <= 30) & (c("score") >= 75), "strong").when(c("score") >= 49, "possible").otherwise("weak")
    return pairs.withColumn("score", capped.cast("bigint")).withColumn("match_status", status)


def orphans(children: dict[str, tuple[DataFrame, str]], parents: DataFrame, key: str) -> DataFrame:
    """check, n: rows of each child without a parent."""
    out = None
    for name, (child, child_key) in children.items():
        lost = child.join(parents.select(c(key).alias(child_key)).distinct(), child_key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = lost if out is None else out.unionByName(lost)
    return out


def current_rows(versions: DataFrame) -> DataFrame:
    """Rows that no other supersedes."""
    return versions.join(versions.select(c("supersedes_id").alias("version_id")).where("version_id IS NOT NULL").distinct(), "version_id", "left_anti")


def geo_fallback(subjects: DataFrame, levels: list[tuple[str, DataFrame, str, int]]) -> DataFrame:
    """levels, fine to coarse: name, statistics (key, n, median_price), key, least sample. The first level with enough, else the largest sample."""
    out = subjects
    for name, stats, key, _ in levels:
        out = out.join(stats.select(c(key), c("n").alias(f"n_{name}"), c("median_price").alias(f"m_{name}")), key, "left")
    pick = F.coalesce(*(F.when(c(f"n_{n}") >= least, n) for n, _, _, least in levels))
    largest = F.lit(None).cast("string")
    most = F.greatest(*(F.coalesce(c(f"n_{n}"), F.lit(0)) for n, _, _, _ in levels), F.lit(0))
    for n, _, _, _ in reversed(levels):
        largest = F.when((c(f"n_{n}") == most) & (most > 0), n).otherwise(largest)
    value = F.coalesce(*(F.when(c("scope") == n, c(f"m_{n}")) for n, _, _, _ in levels))
    return out.withColumn("scope", F.coalesce(pick, largest)).withColumn("value", value).drop(*(f"{p}_{n}" for n, _, _, _ in levels for p in "nm"))


def directory_union(referenced: DataFrame, open_data: DataFrame, key: str) -> DataFrame:
    """Referenced rows, and the open-data rows whose identity is not among them."""
    return referenced.unionByName(open_data.join(referenced.select(key), key, "left_anti"))


def recent_success(jobs: DataFrame, sources: DataFrame, hours: int) -> DataFrame:
    """Sources with a success in the last hours before now (a column of sources)."""
    j = jobs.select(c("source").alias("js"), "finished_at")
    fresh = (c("js") == c("source")) & (c("finished_at") >= c("now") - F.expr(f"INTERVAL {hours} HOURS")) & (c("finished_at") <= c("now"))
    return sources.join(j, fresh, "left_semi")


def matched_counts(rows: DataFrame, reference: DataFrame, key: str, ref_key: str) -> DataFrame:
    """One row: rows, how many have a match, how many none, and how many keys of the reference are repeated (it should be none, as rows would be)."""
    keys = reference.groupBy(c(ref_key).alias(key)).agg(F.count("*").alias("_n"))
    repeated = keys.agg(F.coalesce(F.sum(c("_n") - 1), F.lit(0)).alias("repeated_keys"))
    counts = rows.join(keys, key, "left").agg(F.count("*").alias("n"), F.count("_n").alias("matched"), F.count_if(c("_n").isNull()).alias("unmatched"))
    return counts.join(F.broadcast(repeated), F.lit(True))


def late_jobs(expected: DataFrame, runs: DataFrame, now: DataFrame) -> DataFrame:
    """expected: event_type, max_minutes; late: whether its last run is longer ago than that, or there is none. now: one row."""
    last = runs.groupBy("event_type").agg(F.max("ts").alias("last"))
    seconds = F.unix_timestamp(c("now").cast("timestamp")) - F.unix_timestamp(c("last").cast("timestamp"))
    return expected.join(last, "event_type", "left").join(F.broadcast(now), F.lit(True)).select("event_type", "max_minutes", F.coalesce(seconds > c("max_minutes") * 60, F.lit(True)).alias("late"))


def earlier_rows(rows: DataFrame, key: str, row_id: str, date: str, parts: int | None = None) -> DataFrame:
    """For each row with earlier ones of its key: how many, and the date of the last. Counts a day, summed over days, stand in for pairs of rows, so a hot key makes no pairs. parts: over how many partitions rows and days are dealt, if not the session's number; rows are then dealt once for both uses."""
    deal = lambda some, *by: some.repartition(parts, *by) if parts else some
    rows = deal(rows.select(row_id, key, date), key, date)
    days = deal(rows.groupBy(key, date).agg(F.count("*").alias("_n")), key)
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    found = days.select(key, date, F.sum("_n").over(w).alias("earlier"), F.max(date).over(w).alias("last_sale")).where("earlier > 0")
    return rows.join(deal(found, key, date), [key, date]).select(row_id, key, "earlier", "last_sale")


def watches(kinds: dict[str, DataFrame], sales: DataFrame) -> DataFrame:
    """user_id, sale_id, kinds (joined by +) of all watches on sales that there are."""
    out = None
    for name, rows in kinds.items():
        marked = rows.withColumn("kind", F.lit(name))
        out = marked if out is None else out.unionByName(marked)
    return out.distinct().join(sales, "sale_id").groupBy("user_id", "sale_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"))


def sync_actions(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """What makes stored rows those of a fresh import: insert, update, delete."""
    s, f = stored.select(key, F.lit(True).alias("_s")), fresh.select(key, F.lit(True).alias("_f"))
    action = F.when(c("_f").isNull(), "delete").when(c("_s").isNull(), "insert").otherwise("update")
    return s.join(f, key, "full").select(key, action.alias("action"))


def zones_of(zones: DataFrame, sales: DataFrame) -> DataFrame:
    """Pairs of zones (zone_id, zone_city, lat, lng, km) and sales of their city within their radius."""
    pairs = zones.join(sales, c("zone_city") == c("city"))
    return pairs.where(haversine_m(c("lat"), c("lng"), c("latitude"), c("longitude")) <= c("km") * 1000)
