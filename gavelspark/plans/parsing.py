"""Queries of text that is read, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import listings
from ..sources.adapters import SALES_CTE, sales
from .queries import FOLDED
from .registry import query
from .scalars import over_sales

c = F.col
S = f"WITH {SALES_CTE} "

MONTH_NAMES = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
MONTH_TEXT = "CASE CAST(month(sale_date) AS INT) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MONTH_NAMES, 1)) + " END"
DAY, YEAR = "CAST(day(sale_date) AS STRING)", "CAST(year(sale_date) AS STRING)"
MOMENT = f"CASE sale_id % 6 WHEN 0 THEN 'Le ' || CAST(sale_date AS STRING) || ' 14:30, salle B' WHEN 1 THEN 'Jeudi ' || {DAY} || ' ' || {MONTH_TEXT} || ' ' || {YEAR} || ' à 14h30' WHEN 2 THEN {DAY} || '/' || CAST(month(sale_date) AS STRING) || '/' || {YEAR} || ' 9h' WHEN 3 THEN 'mardi ' || {DAY} || ' ' || {MONTH_TEXT} || ' ' || {YEAR} WHEN 4 THEN 'vente le 32 mai 1998' ELSE 'date a fixer' END"
over_sales(
    "sc_french_datetime",
    {"moment": (lambda: F.date_format(parsing.french_datetime(c("t")), "yyyy-MM-dd HH:mm"), "strftime(CASE sale_id % 6 WHEN 0 THEN sale_date + INTERVAL 870 MINUTE WHEN 1 THEN sale_date + INTERVAL 870 MINUTE WHEN 2 THEN sale_date + INTERVAL 540 MINUTE WHEN 3 THEN sale_date + INTERVAL 0 MINUTE END, '%Y-%m-%d %H:%M')")},
    t=MOMENT,
)

P = "starting_price_eur"
PRICED = f"CASE sale_id % 5 WHEN 0 THEN 'Mise à prix initiale : ' || CAST({P} AS STRING) || ' euros' WHEN 1 THEN 'Type de bien, date de vente. Prix de vente : ' || CAST({P} AS STRING) WHEN 2 THEN 'Prix de vente : ' || CAST({P} AS STRING) || ' EUR' WHEN 3 THEN 'Première offre possible ' || CAST({P} AS STRING) ELSE 'sur demande' END"
FIELD = f"CASE sale_id % 7 WHEN 0 THEN {P} * 10e0 WHEN 1 THEN {P} + 1e7 WHEN 2 THEN {P} + 5e0 END"
SAID = f"CASE WHEN sale_id % 5 IN (0, 2, 3) THEN {P} END"
over_sales(
    "sc_starting_price",
    {"price": (lambda: parsing.starting_price(c("field"), c("t")), f"CASE WHEN field = ({SAID}) * 10 OR (field > 1000000 AND ({SAID}) < field) THEN ({SAID}) ELSE coalesce(field, ({SAID})) END")},
    t=PRICED,
    field=FIELD,
)

LAND = "CASE sale_id % 4 WHEN 0 THEN CAST(sale_id % 9 AS STRING) || ' ha ' || CAST(sale_id % 70 AS STRING) || 'a ' || CAST(sale_id % 90 AS STRING) || ' ca' WHEN 1 THEN 'parcelle de ' || CAST(sale_id % 70 AS STRING) || ' a' WHEN 2 THEN CAST(sale_id % 90 AS STRING) || 'CA' ELSE 'jardin' END"
over_sales("sc_surface_extract", {"land_m2": (lambda: parsing.land_m2(c("t")), "nullif(CASE sale_id % 4 WHEN 0 THEN 10000 * (sale_id % 9) + 100 * (sale_id % 70) + sale_id % 90 WHEN 1 THEN 100 * (sale_id % 70) WHEN 2 THEN sale_id % 90 END, 0)")}, t=LAND)

over_sales("sc_tribunal", {"court": (lambda: parsing.explicit_court(c("t")), "CASE sale_id % 3 WHEN 0 THEN 'TJ ' || town WHEN 1 THEN 'TJ ' || town END")}, t="CASE sale_id % 3 WHEN 0 THEN 'Vente au  Tribunal judiciaire de ' || replace(city, '_', ' ') || ' (33), salle 2' WHEN 1 THEN 'devant le TJ ' || replace(city, '_', ' ') || ', a 9h' ELSE 'vente notariale' END", town="trim(regexp_replace(replace(city, '_', ' '), '[0-9]+', ''))")

#: Three texts a sale: the listing, its second sentence, a page of a file.
PIECES = ["Zone inondable, PLU en vigueur", "Servitude de passage, accès par l''indivision", "Lot de copropriété : charges et syndic", "Usage d''habitation", "Plan cadastral et registre", "Permis de construire,   à régulariser : régularisation", "Maison"]
TEXT = "CASE (sale_id * 3 + k * (k - 1)) % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PIECES)) + " END"
PROVENANCE = [
    "CASE WHEN k > 1 THEN 'pdf' ELSE 'sale_text' END AS source_kind",
    "CASE k WHEN 0 THEN 5e-1 WHEN 1 THEN 55e-2 ELSE CASE sale_id % 3 WHEN 0 THEN 9e-1 WHEN 1 THEN 0e0 END END AS confidence",
    "CASE k WHEN 0 THEN 'Titre annonce' WHEN 1 THEN 'Description annonce' END AS source_name",
    "CASE WHEN k > 1 THEN 'https://f.example/' || CAST(sale_id % 3 AS STRING) END AS document_url",
    "CASE WHEN k > 1 THEN CAST(sale_id % 4 AS INT) END AS page_number",
]
TEXTS = f", texts AS (SELECT sale_id, k AS ordinal, {', '.join(PROVENANCE).replace('AS STRING', 'AS VARCHAR')}, {TEXT} AS text FROM sales CROSS JOIN (VALUES (0), (1), (2)) v(k))"
NORM = "translate(" + FOLDED + ", '''’', '  ')"
DEFS = ", ".join(f"('{k}', '{p}', {conf}, '{'|'.join(pats)}')" for k, (p, conf, pats) in parsing.PLANNING.items())
SAID = "coalesce(nullif(confidence, 0), base)"
KEY = "concat_ws('|', CAST(sale_id AS VARCHAR), kind, source_kind, coalesce(source_name, ''), coalesce(document_url, ''), coalesce(CAST(nullif(page_number, 0) AS VARCHAR), ''), left(" + NORM.format("excerpt") + ", 240))"
SIGNALS = S + TEXTS + f", defs(kind, priority, base, pattern) AS (VALUES {DEFS}), f AS (SELECT texts.* EXCLUDE (confidence), kind, priority, source_kind = 'pdf' AS documented, CASE WHEN source_kind = 'pdf' THEN greatest({SAID}, 0.72) ELSE {SAID} END AS confidence, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS excerpt FROM texts JOIN defs ON regexp_matches({NORM.format('text')}, pattern)), g AS (SELECT *, row_number() OVER (PARTITION BY sale_id, kind, left({NORM.format('excerpt')}, 220), document_url, page_number ORDER BY ordinal) AS r FROM f), signals AS (SELECT *, kind || '_' || left(sha1({KEY}), 20) AS signal_key FROM g WHERE r = 1)"


def _texts(spark, d):
    return sales(spark, d).select("sale_id", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("k")).selectExpr("sale_id", "k AS ordinal", *PROVENANCE, TEXT.replace("''", "\\'") + " AS text")


@query("sc_planning_extract", SIGNALS + " SELECT sale_id, ordinal, kind, documented, CAST(confidence AS DOUBLE) AS confidence, excerpt, signal_key FROM signals")
def planning_extract(spark, d):
    return listings.planning_signals(_texts(spark, d)).select("sale_id", "ordinal", "kind", "documented", "confidence", "excerpt", "signal_key")


@query("topk_signals", SIGNALS + " SELECT sale_id, signal_key, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY sale_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, NOT documented, confidence DESC, signal_key) AS place FROM (SELECT *, row_number() OVER (PARTITION BY sale_id, kind ORDER BY ordinal) AS k FROM signals) WHERE k <= 1) WHERE place <= 3")
def signals(spark, d):
    return listings.top_signals(listings.planning_signals(_texts(spark, d)), by_kind=1, by_sale=3).select("sale_id", "signal_key", "place")


WRAPPED = "CASE sale_id % 6 WHEN 0 THEN '```json {\"id\": ' || CAST(sale_id AS STRING) || '} ```' WHEN 1 THEN 'Voici : {\"id\": ' || CAST(sale_id AS STRING) || '} merci' WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'rien' WHEN 4 THEN '{\"id\":' || CAST(sale_id AS STRING) || '}' END"
over_sales("sc_llm_json", {"object": (lambda: parsing.json_object(c("t")), "CASE WHEN sale_id % 6 IN (0, 1, 4) THEN '{\"id\":' || CAST(sale_id AS VARCHAR) || '}' END")}, t=WRAPPED)

BLOCKS = "CASE sale_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN '[{\"a\":' || CAST(sale_id AS STRING) || '},[true,null]]' ELSE '{\"bien\":{\"ville\":\"' || city || '\",\"lots\":[1,{\"no\":\"' || CAST(sale_id % 9 AS STRING) || '\"}]},\"prix\":' || CAST(sale_id AS STRING) || ',\"vide\":{}}' END AS t"


@query("sc_flatten_kv", S + f", b AS (SELECT sale_id, {BLOCKS.replace('AS STRING', 'AS VARCHAR')} FROM sales), o AS (SELECT * FROM b WHERE sale_id % 5 > 2), a AS (SELECT * FROM b WHERE sale_id % 5 = 2) SELECT sale_id, 'bien.ville' AS path, t ->> '$.bien.ville' AS value FROM o UNION ALL SELECT sale_id, 'bien.lots[0]', t ->> '$.bien.lots[0]' FROM o UNION ALL SELECT sale_id, 'bien.lots[1].no', t ->> '$.bien.lots[1].no' FROM o UNION ALL SELECT sale_id, 'prix', t ->> '$.prix' FROM o UNION ALL SELECT sale_id, '[0].a', t ->> '$[0].a' FROM a UNION ALL SELECT sale_id, '[1][0]', t ->> '$[1][0]' FROM a UNION ALL SELECT sale_id, '[1][1]', t ->> '$[1][1]' FROM a")
def flatten_kv(spark, d):
    return sales(spark, d).selectExpr("sale_id", BLOCKS).transform(parsing.key_values, "t")


COUNTED = "CASE sale_id % 8 WHEN 0 THEN 'Appartement de ' || CAST(sale_id % 5 + 2 AS STRING) || ' pièces avec deux chambres' WHEN 1 THEN 'Studio au 2e' WHEN 2 THEN 'Maison T' || CAST(sale_id % 5 + 1 AS STRING) WHEN 3 THEN 'chambre 1, chambre 2, chambre 3' WHEN 4 THEN 'Nb de pièces : 4, date de vente 1998' WHEN 5 THEN 'pièce principale et chambre' WHEN 6 THEN 'annexe de 3 pièces' END"
over_sales(
    "sc_count_words",
    {
        "rooms": (lambda: parsing.dwelling_counts(c("t"))[0], "CAST(CASE sale_id % 8 WHEN 0 THEN sale_id % 5 + 2 WHEN 1 THEN 1 WHEN 2 THEN sale_id % 5 + 1 WHEN 5 THEN 1 END AS INTEGER)"),
        "bedrooms": (lambda: parsing.dwelling_counts(c("t"))[1], "CAST(CASE sale_id % 8 WHEN 0 THEN 2 WHEN 3 THEN 3 END AS INTEGER)"),
    },
    t=COUNTED,
)

HAS = "CASE sale_id % 6 WHEN 0 THEN 'Villa avec ' || CAST(sale_id % 9 + 1 AS STRING) || ' salles de bains et deux parkings' WHEN 1 THEN '1 salle d’eau, ' || CAST(sale_id % 4 + 2 AS STRING) || ' places de stationnement' WHEN 2 THEN 'Salle de bains : 3. Garage attenant' WHEN 3 THEN 'trois garages' WHEN 4 THEN 'salle à manger' END"
over_sales(
    "sc_count_amenities",
    {
        "bathrooms": (lambda: parsing.amenity_counts(c("t"))[0], "CAST(CASE sale_id % 6 WHEN 0 THEN sale_id % 9 + 1 WHEN 1 THEN 1 WHEN 2 THEN 3 END AS INTEGER)"),
        "parking": (lambda: parsing.amenity_counts(c("t"))[1], "CAST(CASE sale_id % 6 WHEN 0 THEN 2 WHEN 1 THEN sale_id % 4 + 2 WHEN 2 THEN 1 WHEN 3 THEN 3 END AS INTEGER)"),
    },
    t=HAS,
)
