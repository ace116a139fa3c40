"""The test tables in the shapes of the domain: sales, register mutations, tribunals.

The expressions are plain SQL, so that the same text serves selectExpr and the checking SQL (a CTE); what is checked is what operators do with these shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SALES = {
    "sale_id": "o_orderkey",
    "source_name": "lower(c_mktsegment)",
    "source_url": "'https://' || lower(c_mktsegment) || '.example/' || CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey % 3 AS STRING)",
    "department": "lpad(CAST(n_nationkey + 1 AS STRING), 2, '0')",
    "city": "n_name",
    "region": "r_name",
    "tribunal_code": "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 'T' || CAST(c_nationkey AS STRING) END",
    "title": "CASE o_orderkey % 4 WHEN 0 THEN 'Maison avec jardin à ' || n_name WHEN 1 THEN 'Appartement T' || CAST(o_orderkey % 5 + 1 AS STRING) || ', ' || n_name WHEN 2 THEN '  Immeuble   de rapport ' ELSE NULL END",
    "address": "CAST(o_custkey % 40 + 1 AS STRING) || CASE o_custkey % 3 WHEN 0 THEN ' Avenue de la République' WHEN 1 THEN ' bd du Marché' ELSE ' Rue Saint-Étienne' END",
    "postal_code": "lpad(CAST((n_nationkey + 1) * 1000 + o_custkey % 10 AS STRING), 5, '0')",
    "property_type": "CASE o_orderkey % 7 WHEN 0 THEN 'apartment' WHEN 1 THEN 'house' WHEN 2 THEN 'building' WHEN 3 THEN 'land' WHEN 4 THEN 'parking' WHEN 5 THEN 'commercial' END",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'upcoming' WHEN 'F' THEN 'adjudicated' ELSE 'unknown' END",
    "starting_price_eur": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END",
    "adjudication_price_eur": "CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) + (o_custkey % 50) * 1000 END",
    "sale_date": "CAST(o_orderdate AS DATE)",
    "surface_m2": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 180 + 10 END",
    "land_surface_m2": "CASE WHEN o_orderkey % 7 IN (1, 3) THEN (o_orderkey % 50) * 20 END",
    "rooms_count": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 6 + 1 END",
    "bedrooms_count": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 4 END",
    "latitude": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 44e0 + (o_custkey % 1000) / 250e0 END",
    "longitude": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 5e-1 + (o_orderkey % 1000) / 200e0 END",
    "investment_score": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 101 END",
    "occupancy_status": "CASE o_orderkey % 6 WHEN 0 THEN 'vacant' WHEN 1 THEN 'rented' WHEN 2 THEN 'occupied' WHEN 3 THEN 'owner_occupied' WHEN 4 THEN 'squatted' END",
    "dpe_class": "CASE WHEN o_custkey % 8 < 7 THEN substring('ABCDEFG', CAST(o_custkey % 8 AS INT) + 1, 1) END",
    "documents_count": "o_orderkey % 4",
    "created_at": "CAST(o_orderdate AS DATE) - CAST(o_orderkey % 120 AS INT)",
    "has_garden": "CASE o_orderkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END",
    "quality_flags": "CASE o_orderkey % 9 WHEN 1 THEN 'ambiguous_surface' WHEN 2 THEN 'missing_gps,low_confidence_extraction' ELSE '' END",
    "description": "CASE WHEN o_orderkey % 20 > 0 THEN 'Lot de vente a ' || n_name END",
}
SALES_FROM = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

#: Register lines: several a mutation, some of which have two dates.
MUTATIONS = {
    "mutation_id": "l_orderkey",
    "line_no": "l_linenumber",
    "sale_date": "CAST(o_orderdate AS DATE)",
    "line_date": "CAST(l_shipdate AS DATE)",
    "nature": "CASE l_returnflag WHEN 'A' THEN 'Adjudication' ELSE 'Vente' END",
    "price_eur": "CAST(floor(o_totalprice) AS BIGINT)",
    "type_code": "CAST(l_partkey % 4 + 1 AS INT)",
    "built_m2": "CASE WHEN l_linestatus = 'O' THEN CAST(floor(l_quantity) AS BIGINT) * 3 END",
    "land_m2": "CASE WHEN l_partkey % 3 = 0 THEN CAST(floor(l_quantity) AS BIGINT) * 20 END",
    "parcel_id": "lpad(CAST(l_partkey AS STRING), 14, '0')",
    "lots_count": "CAST(l_suppkey % 3 AS INT)",
    "latitude": "44e0 + (l_suppkey % 50) / 100e0",
    "longitude": "5e-1 + (l_partkey % 50) / 100e0",
}
MUTATIONS_FROM = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _columns(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def cte(name: str, columns: dict[str, str], source: str) -> str:
    """The shape as a CTE for the checking engine."""
    text = f"{name} AS (SELECT {', '.join(_columns(columns))} FROM {source})"
    return text.replace("AS STRING)", "AS VARCHAR)")


SALES_CTE = cte("sales", SALES, SALES_FROM)
MUTATIONS_CTE = cte("mutations", MUTATIONS, MUTATIONS_FROM)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition that tables are dealt to by key, at about most; of how few partitions the session's own number does.
ROWS, FEW = 400_000, 8


def parts_for(rows: DataFrame, times: int = 1) -> int | None:
    """Over how many partitions times as many rows as these (a table's: counting reads no column) are dealt, so that a task's memory does not grow with the table; None for the session's own number, which does for few."""
    n = -(-rows.count() * times // ROWS)
    return n if n > FEW else None


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows


def line_parts(spark: SparkSession, sf_dir: str) -> int | None:
    return parts_for(read(spark, sf_dir, "lineitem"))


def sales(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """One row a sale. The two dimensions are the driver's 25 nations and 5 regions; Spark sees their size and broadcasts them. Customers too, while they are few. deal: else they are dealt over partitions by the number of orders, which follow them, for sales that go on to as many partitions as register lines have: of those that Spark joins together by size a task had seven million orders to hold."""
    t = lambda n: read(spark, sf_dir, n)
    nation, region = t("nation"), t("region")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    orders, customer = t("orders"), t("customer")
    if deal:
        customer = dealt(customer, parts_for(orders), "c_custkey")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(places, customer["c_nationkey"] == places["n_nationkey"])
    return joined.selectExpr(*_columns(SALES))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a register line. Both sides are dealt by mutation, over partitions by the number of lines: what is grouped by mutation stays where it is."""
    parts = line_parts(spark, sf_dir)
    lines, orders = dealt(read(spark, sf_dir, "lineitem"), parts, "l_orderkey"), dealt(read(spark, sf_dir, "orders"), parts, "o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).selectExpr(*_columns(MUTATIONS))


def tribunals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tribunal dimension: code, name, region_key; one a nation, without the last."""
    return read(spark, sf_dir, "nation").where("n_nationkey < 24").selectExpr("'T' || CAST(n_nationkey AS STRING) AS code", "'Tribunal judiciaire de ' || n_name AS name", "n_regionkey AS region_key")


TRIBUNALS_CTE = "tribunals AS (SELECT 'T' || CAST(n_nationkey AS VARCHAR) AS code, 'Tribunal judiciaire de ' || n_name AS name, n_regionkey AS region_key FROM nation WHERE n_nationkey < 24)"
