"""Deduplication and entity resolution of sales seen by several sources."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, content_hash, street_key

c = F.col

#: Sources by how far their rows are preferred, the first most; others come after these.
SOURCE_PRIORITY = ["automobile", "building", "furniture", "household", "machinery"]


def there(x: Column, kind: str) -> Column:
    return F.coalesce(F.trim(x) != "", F.lit(False)) if kind == "string" else x.isNotNull()


def richness(rows: DataFrame, fields: list[str], lists: dict[str, Column], raw_text: Column | None = None) -> Column:
    """Number of fields that are there, and of list items (by their counts), 3 a list at most; a point for each 250 characters of raw text, 4 at most."""
    kinds = dict(rows.dtypes)
    score = sum((there(c(f), kinds[f]).cast("int") for f in fields), F.lit(0))
    score = sum((F.least(F.coalesce(n, F.lit(0)), F.lit(3)) for n in lists.values()), score)
    return (score if raw_text is None else score + F.least(F.floor(F.coalesce(F.char_length(raw_text), F.lit(0)) / 250), F.lit(4))).cast("bigint")


def priority(source: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.lit(SOURCE_PRIORITY), source), F.lit(0)).cast("int"), F.lit(99))


def preference(score: str = "richness", source: str = "source_name", ordinal: str = "sale_id") -> Column:
    """A key whose least value is the row to keep: the richest, then of the preferred source, then the first."""
    return F.struct((-c(score)).alias("r"), priority(c(source)).alias("p"), c(ordinal).alias("o"))


def pick_richest(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row of each group, by preference()."""
    others = [x for x in rows.columns if x not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), preference()).alias("b")).select(*by, "b.*")


def merged(rows: DataFrame, by: list[str], order: Column, fields: list[str], lists: list[str] = []) -> DataFrame:  # noqa: B006
    """One row a group: the first row by order, its empty fields filled from the next rows that have them, lists (arrays) joined without repeats, and n, the number of rows. Everything is an aggregate that combines before the shuffle; lists are first reduced to distinct items."""
    kinds = dict(rows.dtypes)
    rows = rows.withColumn("_o", order)
    filled = [F.min_by(f, F.when(there(c(f), kinds[f]), c("_o"))).alias(f) for f in fields]
    out = rows.groupBy(*by).agg(*filled, F.count("*").alias("n"))
    for name in lists:
        items = rows.select(*by, F.explode(name).alias("x")).distinct().groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias(name))
        out = out.join(items, by, "left")
    return out


def by_url(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Stage 1: of rows with one source_url the first of the richest stays; rows that come after it fill its empty fields, rows before it are replaced. Richness is that of rows as they are read, not of what they have become by filling."""
    best = rows.groupBy("source_url").agg(F.min(F.struct((-c("richness")).alias("r"), c("sale_id").alias("o"))).alias("b")).select("source_url", c("b.o").alias("_first"))
    return merged(rows.join(best, "source_url").where(c("sale_id") >= c("_first")), ["source_url"], c("sale_id"), ["sale_id", *fields])


def strong_signals() -> Column:
    """Of address, city, date, price and postal code three at least."""
    return sum(there(c(x), "string").cast("int") for x in ("address", "city", "postal_code")) + c("sale_date").isNotNull().cast("int") + (F.coalesce(c("starting_price_eur"), F.lit(0)) != 0).cast("int") >= 3


def sale_hash() -> Column:
    return content_hash(clean_text(c("address")), clean_text(c("city")), c("sale_date"), c("starting_price_eur"))


def by_hash(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Stage 2: rows of strong signals with the same content hash become the preferred one, its empty fields filled from the others; rows without strong signals stay (how: content_hash or source_url_only)."""
    marked = rows.withColumn("how", F.when(strong_signals(), "content_hash").otherwise("source_url_only"))
    strong = merged(marked.where("how = 'content_hash'").withColumn("content_hash", sale_hash()), ["content_hash", "how"], preference(), ["sale_id", *fields])
    weak = marked.where("how <> 'content_hash'").select(sale_hash().alias("content_hash"), "how", "sale_id", *fields, F.lit(1).cast("bigint").alias("n"))
    return strong.unionByName(weak)


def address_key() -> Column:
    """Street (which must hold a number, and six characters) and postal code, else city; null if it is not precise."""
    street = street_key(clean_text(c("address")))
    place = F.coalesce(F.lower(clean_text(c("postal_code"))), street_key(c("city")))
    return F.when(street.rlike(r"\d") & (F.char_length(street) >= 6), F.concat_ws("|", street, place))


#: By how much of the greater one prices of one property may differ; a width of their logarithms beyond which they differ by more; rows of an address that a round reads in order.
CLOSE, LOG_WIDTH, PREFIX = 0.02, 0.0203, 1000


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and sale_id those that are not the same property as a first row before them. Properties are the same unless date and price (not 0) are known on both sides and both differ, the price by more than CLOSE or not above 0."""
    key, dates, prices, all_in = None, set(), [], False
    for batch in batches:
        found = []
        for i, (k, date, price) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("key", "sale_date", "starting_price_eur")), strict=True)):
            if fresh := k != key:
                key, dates, prices, all_in = k, set(), [], False
            if date is None or not price:
                all_in = all_in or fresh  # the first row of all: any row is the same as it
                if fresh:
                    found.append(i)
                continue
            at = bisect_left(prices, price) if price > 0 else 0
            near = price > 0 and any(abs(price - p) <= CLOSE * max(price, p) for p in prices[max(0, at - 1) : at + 1])
            if all_in or date in dates or near:
                continue
            found.append(i)
            dates.add(date)
            if price > 0:
                prices.insert(at, price)
        yield batch.take(pa.array(found, pa.int32()))


def _taken_in(left: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows with group_id: the first of the firsts of their key that is the same property; null if none is. By equi-joins, each with one row a key: on address, address and date, address and bucket of price."""
    price = c("starting_price_eur")
    known = c("sale_date").isNotNull() & (F.coalesce(price, F.lit(0)) != 0)
    bucket = F.when(known & (price > 0), F.floor(F.ln(price.cast("double")) / LOG_WIDTH))
    any_one = firsts.groupBy("key").agg(F.min("sale_id").alias("_any"), F.min(F.when(~known, c("sale_id"))).alias("_unknown"))
    by_date = firsts.where(known).groupBy("key", "sale_date").agg(F.min("sale_id").alias("_dated"))
    around = firsts.where(bucket.isNotNull()).select("key", "sale_id", price.alias("p"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"))
    by_price = around.groupBy("key", "_bucket").agg(F.collect_list(F.struct("p", c("sale_id").alias("id"))).alias("_near"))
    close = F.filter("_near", lambda x: F.abs(price - x["p"]) <= CLOSE * F.greatest(price, x["p"]))
    priced = F.array_min(F.transform(close, lambda x: x["id"]))
    group = F.when(known, F.least("_unknown", "_dated", priced)).otherwise(c("_any"))
    joined = left.withColumn("_bucket", bucket).join(by_price, ["key", "_bucket"], "left").join(by_date, ["key", "sale_date"], "left").join(any_one, "key", "left")
    return joined.select(*left.columns, group.alias("group_id"))


def by_address(rows: DataFrame, hold, prefix: int = PREFIX) -> DataFrame:
    """Stage 3: sale_id, group_id: rows of one precise address and one property are a group, named by its first row; rows without a precise address are alone.

    Greedy by order of sale_id, as a list would be worked through: the first row left of every address takes in all rows that are the same property as it. A round finds the firsts among the first `prefix` rows left of each address, and all rows left join the first of them that is the same; what is left over is the next round's. So a round ends all but a few rows of an address, however many it has. hold(DataFrame, name) writes a round's rest to the shared folder, so that plans do not grow. A row is compared with a group's first row, not with what that has become by merging.
    """
    at = ["address", "postal_code", "city"]
    # a key takes long to make out: once for each address as it is written
    keys = rows.select(*at).distinct().select(*(c(x).alias(f"_{x}") for x in at), address_key().alias("key"))
    asked = rows.select("sale_id", "sale_date", "starting_price_eur", *at)
    alike = [c(x).eqNullSafe(c(f"_{x}")) for x in at]
    keyed = hold(asked.join(keys, alike).select("sale_id", "sale_date", "starting_price_eur", "key"), "left")
    done = keyed.where("key IS NULL").select("sale_id", c("sale_id").alias("group_id"))
    left = keyed.where("key IS NOT NULL")
    w = Window.partitionBy("key").orderBy("sale_id")
    while not left.isEmpty():
        some = left.withColumn("_n", F.row_number().over(w)).where(c("_n") <= prefix).drop("_n").sortWithinPartitions("key", "sale_id")
        firsts = hold(some.mapInArrow(_firsts, some.schema), "firsts")
        joined = hold(_taken_in(left, firsts), "round")
        done = done.union(joined.where("group_id IS NOT NULL").select("sale_id", "group_id"))
        left = joined.where("group_id IS NULL").drop("group_id")
    return done


def secondaries(rows: DataFrame, survivors: DataFrame) -> DataFrame:
    """Rows that deduplication gave up: what is to be deleted."""
    return rows.join(survivors.select("sale_id"), "sale_id", "left_anti")


def first_of(rows: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Repeats by a semantic key go, the first by ordinal stays; n is how many there were."""
    others = [x for x in rows.columns if x not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*others), ordinal).alias("b"), F.count("*").alias("n")).select(*by, "b.*", "n")


def register_match(pairs: DataFrame) -> DataFrame:
    """Score, method and status of register candidates against lots: parcel .65; same day .20, 30 days .12, 180 days .05; address .10; commune .05, else postal code and city .03. Without a common parcel .49 at most. Price is never used.

    pairs: c_ and l_ before parcels (array), date, address (normalised), insee, postal, city.
    """
    parcel = F.coalesce(F.arrays_overlap("c_parcels", "l_parcels"), F.lit(False))
    days = F.abs(F.datediff("c_date", "l_date"))
    same = lambda x: F.coalesce((c(f"c_{x}") == c(f"l_{x}")) & (c(f"c_{x}") != ""), F.lit(False))
    part = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0))
    points = part(parcel, 6500) + F.when(days == 0, 2000).when(days <= 30, 1200).when(days <= 180, 500).otherwise(0) + part(same("address"), 1000) + F.when(same("insee"), 500).when(same("postal") & same("city"), 300).otherwise(0)
    held = F.least(F.when(parcel, points).otherwise(F.least(points, F.lit(4900))), F.lit(10_000))
    near = F.coalesce(days <= 30, F.lit(False))
    strong = parcel & near & (held >= 7500)
    how = F.when(strong, "parcel_and_date").when(parcel, "parcel").when(same("address") & near, "address_and_date").otherwise("insufficient_signals")
    state = F.when(strong, "strong_candidate").when(parcel | (same("address") & near), "review_required").otherwise("weak_candidate")
    return pairs.withColumns({"match_score": (held / 10_000).cast("decimal(5,4)"), "match_method": how, "match_status": state})
