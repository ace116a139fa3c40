"""Queries of sources, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files
from ..sources.adapters import SALES_CTE, read, sales
from .registry import query

c = F.col
S = f"WITH {SALES_CTE} "


@query("src_table", S + "SELECT sale_id, city, sale_date, starting_price_eur FROM sales WHERE department = '07' AND property_type IS NULL ORDER BY sale_date DESC, sale_id LIMIT 50 OFFSET 20")
def table_page(spark, d):
    return files.page_of(sales(spark, d), ["sale_id", "city", "sale_date", "starting_price_eur"], {"department": "07", "property_type": None}, [c("sale_date").desc(), c("sale_id")], 20, 50)


#: Answers of a parcel service: a parcel, the same one again, one without an id, another; and answers that are none.
FEATURE = """'{{"properties":{{"id":"' || {id} || '","section":"{section}","area":' || CAST(s_suppkey % 900 AS STRING) || '}},"geometry":{{"type":"Point","coordinates":[1,' || CAST(s_nationkey AS STRING) || ']}}}}'"""
ANSWER = "CASE WHEN s_suppkey % 10 = 0 THEN 'no answer' WHEN s_suppkey % 10 = 1 THEN '{\"features\":[]}' ELSE '{\"features\":[' || " + " || ',' || ".join([FEATURE.format(id="CAST(s_suppkey AS STRING)", section="A"), FEATURE.format(id="CAST(s_suppkey AS STRING)", section="B"), "'{\"properties\":{\"section\":\"C\"}}'", FEATURE.format(id="'x' || CAST(s_suppkey AS STRING)", section="D")]) + " || ']}' END AS answer"
ANSWER_SQL = ANSWER.replace("AS STRING", "AS VARCHAR")


@query(
    "src_geojson",
    f"WITH a AS (SELECT s_suppkey, {ANSWER_SQL} FROM supplier), f AS (SELECT s_suppkey, unnest(json_extract(answer, '$.features[*]')) AS f, generate_subscripts(json_extract(answer, '$.features[*]'), 1) AS nth FROM a WHERE json_valid(answer)), p AS (SELECT s_suppkey, f ->> '$.properties.id' AS id, f ->> '$.properties.section' AS section, CAST(f ->> '$.properties.area' AS BIGINT) AS area, CAST(f -> '$.geometry' AS VARCHAR) AS geometry, row_number() OVER (PARTITION BY s_suppkey, f ->> '$.properties.id' ORDER BY nth) AS r FROM f) SELECT s_suppkey, id, section, area, geometry, FALSE AS capped FROM p WHERE id IS NOT NULL AND r = 1",
)
def geojson_rows(spark, d):
    answers = read(spark, d, "supplier").selectExpr("s_suppkey", ANSWER)
    return files.features(answers, "answer", ["s_suppkey"], "id string, section string, area bigint", "id")
