"""Queries of scalar functions: each over all sales, beside the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import hexagons
from ..functions import numbers as num
from ..functions import text
from ..operators import aggregates as agg
from ..operators import search
from ..sources.adapters import MUTATIONS_CTE, SALES_CTE, mutations, sales
from .queries import FOLDED, NOW, RENT, half_up
from .registry import query

c = F.col
S = f"WITH {SALES_CTE} "


def over_sales(name: str, columns: dict[str, tuple[Callable[[], Column], str]], **inputs: str) -> None:
    """Registers a query: sale_id and, for each column, what makes its expression (columns need a session, which importing this must not) and its SQL. inputs: further columns to read, as SQL that both engines take."""
    more = "".join(f", {e} AS {n}" for n, e in inputs.items())
    sql = S + f", rows AS (SELECT *{more.replace('AS STRING', 'AS VARCHAR')} FROM sales) SELECT sale_id, {', '.join(f'{q} AS {n}' for n, (_, q) in columns.items())} FROM rows"

    @query(name, sql)
    def run(spark, d):
        return sales(spark, d).selectExpr("*", *(f"{e} AS {n}" for n, e in inputs.items())).select("sale_id", *(e().alias(n) for n, (e, _) in columns.items()))


P, SURF = "starting_price_eur", "surface_m2"
THOUSANDS = f"CAST(CAST(floor({P} / 1000) AS BIGINT) AS STRING)"
REST = f"lpad(CAST({P} % 1000 AS STRING), 3, '0')"
PRICE_TEXT = f"CASE sale_id % 6 WHEN 0 THEN 'Mise a prix : ' || CAST({P} AS STRING) || ',50 EUR' WHEN 1 THEN {THOUSANDS} || ' ' || {REST} || ',25' WHEN 2 THEN {THOUSANDS} || '.' || {REST} WHEN 3 THEN CAST({P} AS STRING) || '.5' WHEN 4 THEN 'sans prix' ELSE {THOUSANDS} || '.' || {REST} || ',75 euros' END"
TOKEN = "replace(regexp_extract(trim(regexp_replace(t, '\\s+', ' ', 'g')), '([0-9][0-9\\s.,]*)', 1), ' ', '')"
over_sales("sc_parse_price", {"price": (lambda: num.parse_price(c("t")), f"TRY_CAST(CASE WHEN contains({TOKEN}, ',') THEN replace(replace({TOKEN}, '.', ''), ',', '.') WHEN regexp_full_match({TOKEN}, '\\d{{1,3}}(\\.\\d{{3}})+') THEN replace({TOKEN}, '.', '') ELSE {TOKEN} END AS DOUBLE)")}, t=PRICE_TEXT)
over_sales("sc_decimal_fr", {"value": (lambda: num.decimal_fr(c("t")).cast("double"), "CAST(TRY_CAST(replace(replace(t, ' ', ''), ',', '.') AS DECIMAL(18,2)) AS DOUBLE)"), "positive": (lambda: F.when(num.decimal_fr(c("t")) > 0, num.decimal_fr(c("t"))).cast("double"), "CAST(CASE WHEN TRY_CAST(replace(replace(t, ' ', ''), ',', '.') AS DECIMAL(18,2)) > 0 THEN TRY_CAST(replace(replace(t, ' ', ''), ',', '.') AS DECIMAL(18,2)) END AS DOUBLE)")}, t=f"CASE sale_id % 4 WHEN 0 THEN CAST({P} AS STRING) || ',5' WHEN 1 THEN {THOUSANDS} || ' ' || {REST} WHEN 2 THEN '-' || CAST({P} AS STRING) ELSE 'n.c.' END")
over_sales("sc_confidence", {"confidence": (lambda: num.confidence(c("x")), "CASE WHEN x < 0 THEN 0e0 WHEN x <= 1 THEN x WHEN x <= 100 THEN x / 100 WHEN x > 100 THEN 1e0 END")}, x="CASE WHEN sale_id % 5 > 0 THEN (sale_id % 300 - 20) / CASE sale_id % 2 WHEN 0 THEN 1e0 ELSE 1e2 END END")
over_sales("sc_round_js", {"whole": (lambda: num.round_half_up(c("x")), "floor(x + 5e-1)"), "two": (lambda: num.round_half_up(c("x"), 2), half_up("x", 2))}, x="(sale_id % 1000 - 500) / 8e0")
over_sales("sc_price_m2", {"price_m2": (lambda: F.round(num.price_m2(c(P), c(SURF)), 4), f"round(CASE WHEN {SURF} > 0 THEN {P} / {SURF} END, 4)")})
YIELD = f"CASE WHEN {P} > 0 AND {SURF} > 0 THEN {SURF} * {RENT.format('department')} * 12 / ({P} * 1.1e0) * 100 END"
over_sales("sc_yield", {"gross_yield_pct": (lambda: F.round(num.gross_yield_pct(c(P), c(SURF), num.rent_m2(c("department"))), 4), f"round({YIELD}, 4)"), "rent_m2": (lambda: num.rent_m2(c("department")), RENT.format("department"))})
EMOLUMENTS = "(least(p, 6500) * 0.07e0 + greatest(least(p, 17000) - 6500, 0) * 0.0385e0 + greatest(least(p, 30000) - 17000, 0) * 0.0275e0 + greatest(p - 30000, 0) * 0.015e0)"
over_sales("sc_emoluments", {"emoluments": (lambda: F.round(num.emoluments(c("p")), 4), f"round({EMOLUMENTS}, 4)")}, p=f"coalesce({P}, 0)")
over_sales("sc_acq_cost", {"total_cost": (lambda: F.round(num.acquisition_cost(c("p"), c("works")), 4), f"round(p + {EMOLUMENTS} * 1.2e0 + p * 0.058e0 + 3000 + works, 4)")}, p=f"coalesce({P}, 0)", works="sale_id % 7 * 1000")
#: The cost is linear between these bids, so the bid for a cost is that of the piece the cost lies in.
KNOTS = [(0, 3000.0), (6500, 6500 * 1.058 + 455 * 1.2 + 3000), (17000, 17000 * 1.058 + 859.25 * 1.2 + 3000), (30000, 30000 * 1.058 + 1216.75 * 1.2 + 3000)]
SLOPES = [1.058 + r * 1.2 for r in (0.07, 0.0385, 0.0275, 0.015)]
BID = "CASE " + " ".join(f"WHEN total > {cost!r} THEN {bid} + (total - {cost!r}) / {slope!r}" for (bid, cost), slope in reversed(list(zip(KNOTS, SLOPES, strict=True)))) + " ELSE 0e0 END"
over_sales("sc_max_bid", {"max_bid": (lambda: num.max_bid(c("total")), f"floor(greatest(({BID}), 0e0) / 100) * 100")}, total=f"CAST(coalesce({P}, 0) AS DOUBLE)")
over_sales("sc_works_budget", {k: (lambda v=v: num.round_half_up(F.coalesce(c(SURF), F.lit(0)) * v), f"floor(coalesce({SURF}, 0) * {v} + 5e-1)") for k, v in num.WORKS_M2.items()})
CUTS = "({0} IS NULL)"
over_sales("sc_segment", {"segment": (lambda: num.segment(c("k")), "CASE WHEN k LIKE '%terrain%' OR regexp_matches(k, '\\bland\\b') OR k LIKE '%parcelle%' THEN 'land' WHEN regexp_matches(k, 'appartement|apartment|studio|\\bapt\\b|\\bt[1-9]\\b') THEN 'apartment' WHEN regexp_matches(k, 'maison|house|villa|pavillon') THEN 'house' WHEN regexp_matches(k, 'immeuble|building') THEN 'building' WHEN regexp_matches(k, 'commerce|commercial|local professionnel|bureau|retail') THEN 'commercial' WHEN regexp_matches(k, '\\b(mixed|mixte)\\b') THEN 'building' ELSE 'unsupported' END")}, k="CASE sale_id % 3 WHEN 0 THEN lower(title) WHEN 1 THEN property_type ELSE coalesce(property_type, 'mixte') || ' t3' END")
over_sales("sc_type_code", {"code": (lambda: num.type_code(c("code_in"), c("kind"), c(SURF), c("land_surface_m2")), f"CASE WHEN code_in IN ('111','121','112','122','123','141','142','151','152') THEN code_in WHEN code_in = '1' OR regexp_matches(coalesce(kind, ''), 'maison|villa|pavillon|house') THEN CASE WHEN {SURF} IS NOT NULL THEN '111' END WHEN code_in = '2' OR regexp_matches(coalesce(kind, ''), 'appartement|studio|apartment') THEN CASE WHEN {SURF} IS NOT NULL THEN '121' END WHEN code_in = '4' OR regexp_matches(coalesce(kind, ''), 'local industriel|local commercial|commerce|bureau') THEN CASE WHEN {SURF} IS NOT NULL THEN '141' END WHEN code_in IS NULL AND kind IS NULL AND {SURF} IS NULL AND land_surface_m2 > 0 THEN '211' END")}, code_in="CASE sale_id % 8 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '4' WHEN 3 THEN '122' WHEN 4 THEN '9' END", kind="CASE sale_id % 3 WHEN 0 THEN property_type WHEN 1 THEN 'studio' END")
# dates
over_sales("sc_parse_date", {"parsed": (lambda: num.first_date(c("t")), "CAST(coalesce(CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(t, '%Y-%m-%d') END, CASE WHEN regexp_full_match(t, '\\d{2}/\\d{2}/\\d{4}') THEN try_strptime(t, '%d/%m/%Y') END, CASE WHEN regexp_full_match(t, '\\d{4}/\\d{2}/\\d{2}') THEN try_strptime(t, '%Y/%m/%d') END) AS DATE)")}, t="CASE sale_id % 5 WHEN 0 THEN CAST(sale_date AS STRING) WHEN 1 THEN lpad(CAST(day(sale_date) AS STRING), 2, '0') || '/' || lpad(CAST(month(sale_date) AS STRING), 2, '0') || '/' || CAST(year(sale_date) AS STRING) WHEN 2 THEN replace(CAST(sale_date AS STRING), '-', '/') WHEN 3 THEN '31/02/2020' ELSE 'demain' END")
over_sales("sc_month_distance", {"months": (lambda: F.round(num.month_distance(F.lit("2001-09-01").cast("date"), c("sale_date")), 6), "round(date_diff('day', sale_date, DATE '2001-09-01') / 30.4375e0, 6)")})
over_sales("sc_days_until", {"days": (lambda: F.datediff("sale_date", F.lit(NOW)), f"CAST(date_diff('day', DATE '{NOW}', sale_date) AS INTEGER)"), "urgency": (lambda: num.urgency(F.datediff("sale_date", F.lit(NOW))), f"CASE WHEN sale_date < DATE '{NOW}' THEN 'past' WHEN date_diff('day', DATE '{NOW}', sale_date) < 7 THEN 'week' WHEN date_diff('day', DATE '{NOW}', sale_date) < 30 THEN 'month' ELSE 'later' END")})
over_sales("sc_add_months", {"moved": (lambda: num.add_months_overflow(c("sale_date"), 1), "CAST(date_trunc('month', sale_date) + INTERVAL 1 MONTH AS DATE) + CAST(day(sale_date) - 1 AS INTEGER)")})
over_sales("sc_schedule", {"daily": (lambda: num.next_dispatch(c("sale_date"), False).cast("string"), "strftime(sale_date + INTERVAL 31 HOUR, '%Y-%m-%d %H:%M:%S')"), "weekly": (lambda: num.next_dispatch(c("sale_date"), True).cast("string"), "strftime(sale_date + to_days(CAST(8 - isodow(sale_date) AS INTEGER)) + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S')")})
over_sales("sc_month_cyclic", {"month_sin": (lambda: F.round(F.sin(2 * num.PI * (F.month("sale_date") - 1) / 12), 9), "round(sin(2 * pi() * (month(sale_date) - 1) / 12), 9)"), "month_cos": (lambda: F.round(F.cos(2 * num.PI * (F.month("sale_date") - 1) / 12), 9), "round(cos(2 * pi() * (month(sale_date) - 1) / 12), 9)"), "sale_year": (lambda: F.year("sale_date"), "CAST(year(sale_date) AS INTEGER)")})
over_sales("sc_lifecycle_past", {"status_now": (lambda: F.when((c("sale_date") < F.lit(NOW).cast("date")) & (c("status") != "adjudicated"), "past").otherwise(c("status")), f"CASE WHEN sale_date < DATE '{NOW}' AND status <> 'adjudicated' THEN 'past' ELSE status END")})
# places
HAVERSINE = "2 * {r}e0 * asin(sqrt(least(1e0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({y} - {x}) / 2), 2))))"
over_sales("sc_haversine", {"metres": (lambda: F.round(num.haversine_m(c("latitude"), c("longitude"), F.lit(48.8566), F.lit(2.3522)), 3), f"CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN round({HAVERSINE.format(r=6371000, a='latitude', b='48.8566e0', x='longitude', y='2.3522e0')}, 3) END")})


def hexagon(lat: str, lng: str, size: float) -> tuple[str, str]:
    """SQL of a hexagonal cell's q and r."""
    x, y = f"(radians({lng}) * cos(radians(46.5e0)) * 6371000)", f"(radians({lat}) * 6371000)"
    q, r = f"(({x} * sqrt(3e0) / 3 - {y} / 3) / {size}e0)", f"({y} * 2 / 3 / {size}e0)"
    s = f"(-{q} - {r})"
    a, b, d = (f"floor({v} + 5e-1)" for v in (q, r, s))
    dq, dr, ds = (f"abs({n} - {v})" for n, v in ((a, q), (b, r), (d, s)))
    return f"CAST(CASE WHEN {dq} > {dr} AND {dq} > {ds} THEN -{b} - {d} ELSE {a} END AS BIGINT)", f"CAST(CASE WHEN NOT ({dq} > {dr} AND {dq} > {ds}) AND {dr} > {ds} THEN -{a} - {d} ELSE {b} END AS BIGINT)"


HOUSE, LAND = hexagons.EDGES["house"], hexagons.EDGES["land"]
HEX_Q, HEX_R = hexagon("latitude", "longitude", HOUSE)
MID_Q, MID_R = hexagon("46e0", "2e0", HOUSE)
AWAY = f"(abs({HEX_Q} - {MID_Q}) + abs({HEX_R} - {MID_R}) + abs({HEX_Q} - {MID_Q} + {HEX_R} - {MID_R})) // 2"
over_sales(
    "sc_cell",
    {
        "q": (lambda: hexagons.cell_of(c("latitude"), c("longitude"), HOUSE)["q"], HEX_Q),
        "r": (lambda: hexagons.cell_of(c("latitude"), c("longitude"), HOUSE)["r"], HEX_R),
        "steps": (lambda: hexagons.steps_between(hexagons.cell_of(c("latitude"), c("longitude"), HOUSE), hexagons.cell_of(F.lit(46.0), F.lit(2.0), HOUSE)), f"CAST({AWAY} AS INTEGER)"),
        "likeness": (lambda: num.ring_similarity(c("ring")), "CASE ring WHEN 0 THEN 1e0 WHEN 1 THEN 0.82e0 WHEN 2 THEN 0.58e0 WHEN 3 THEN 0.38e0 ELSE 0.2e0 END"),
    },
    ring="sale_id % 6",
)
over_sales("sc_tiles", {"tile_x": (lambda: num.tile(c("latitude"), c("longitude"), 12)[0], "CAST(floor((longitude + 180) / 360 * 4096) AS BIGINT)"), "tile_y": (lambda: num.tile(c("latitude"), c("longitude"), 12)[1], "CAST(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 4096) AS BIGINT)")})
RING = [(0, 0), (4, 1), (6, 5), (1, 7), (0, 0)]


def ring() -> Column:
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in RING))


CROSSED = " + ".join(f"CASE WHEN (({ay} > y) <> ({by} > y)) AND x < ({bx} - {ax}) * (y - {ay}) / {by - ay}e0 + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(RING, RING[1:], strict=False) if by != ay)
over_sales("join_point_in_polygon", {"inside": (lambda: num.point_in_ring(c("x"), c("y"), ring()), f"({CROSSED}) % 2 = 1")}, x="sale_id % 80 / 10e0", y="sale_id % 90 / 10e0")
over_sales("sc_centroid", {"cx": (lambda: F.round(num.centroid(F.array(F.struct(c("x").alias("x"), c("y").alias("y")), F.struct((c("x") + 2).alias("x"), (c("y") + 3).alias("y")), F.struct((c("x") - 1).alias("x"), c("y").alias("y"))))["x"], 6), "round((x + x + 2 + x - 1) / 3, 6)"), "cy": (lambda: F.round(num.centroid(F.array(F.struct(c("x").alias("x"), c("y").alias("y")), F.struct((c("x") + 2).alias("x"), (c("y") + 3).alias("y")), F.struct((c("x") - 1).alias("x"), c("y").alias("y"))))["y"], 6), "round((y + y + 3 + y) / 3, 6)")}, x="sale_id % 80 / 10e0", y="sale_id % 90 / 10e0")
over_sales("sc_geo_verify", {"verified": (lambda: num.in_department(c("latitude"), c("longitude"), c("department")), "CASE department " + " ".join(f"WHEN '{k}' THEN latitude BETWEEN {a}e0 AND {b}e0 AND longitude BETWEEN {x}e0 AND {y}e0" for k, (a, b, x, y) in num.DEPARTMENT_BOXES.items()) + " ELSE FALSE END")})
# text
over_sales("sc_clean_text", {"cleaned": (lambda: text.clean_text(c("title")), "nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), '')")})
over_sales("sc_strip_accents", {"plain": (lambda: text.strip_accents(c("address")), "strip_accents(address)")})
over_sales("sc_search_norm", {"norm": (lambda: text.search_norm(c("address")), f"trim(regexp_replace({FOLDED.format('address')}, '[^a-z0-9]+', ' ', 'g'))")})
ADDRESS = "address || ', ' || postal_code || ' ' || city || CASE sale_id % 3 WHEN 0 THEN ' (France)' WHEN 1 THEN ', France' ELSE '' END"
over_sales("sc_postal_city", {"postal": (lambda: text.postal_code(c("t")), "nullif(regexp_extract(t, '\\b(\\d{5})\\b', 1), '')"), "town": (lambda: text.city_after_postal(c("t")), "nullif(trim(replace(regexp_extract(t, '\\b\\d{5}\\s+([^,\\n()]+)', 1), 'France', ''), ' ,'), '')")}, t=ADDRESS)
over_sales("sc_department", {"dept": (lambda: text.department(c("p")), "CASE WHEN p LIKE '97%' OR p LIKE '98%' THEN substring(p, 1, 3) WHEN length(p) >= 2 THEN substring(p, 1, 2) END")}, p="CASE sale_id % 4 WHEN 0 THEN '97' || substring(postal_code, 3, 3) WHEN 1 THEN substring(postal_code, 1, 1) ELSE postal_code END")
over_sales("sc_insee_parcel", {"insee": (lambda: text.insee_code(c("department"), c("k")), "CASE WHEN length(k) >= 5 THEN k ELSE department || lpad(k, 3, '0') END"), "parcel": (lambda: text.parcel_id(c("department"), c("k"), c("pre"), c("sec"), c("plan")), "upper(department || lpad(k, 3, '0') || lpad(coalesce(pre, '000'), 3, '0') || lpad(sec, 2, '0') || lpad(plan, 4, '0'))")}, k="CAST(sale_id % 900 AS STRING)", pre="CASE WHEN sale_id % 3 = 0 THEN CAST(sale_id % 90 AS STRING) END", sec="CASE sale_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'Zb' ELSE NULL END", plan="CAST(sale_id % 7000 AS STRING)")
over_sales("sc_fingerprint", {"signature": (lambda: text.sale_signature(c("sale_date"), c(P)), f"coalesce(CAST(sale_date AS VARCHAR), '') || '|' || coalesce(CAST({P} AS VARCHAR), '')"), "snapshot": (lambda: F.concat_ws("|", *(F.coalesce(c(x).cast("string"), F.lit("")) for x in (P, "sale_date", "status", "investment_score"))), f"concat_ws('|', coalesce(CAST({P} AS VARCHAR), ''), coalesce(CAST(sale_date AS VARCHAR), ''), coalesce(status, ''), coalesce(CAST(investment_score AS VARCHAR), ''))")})


def one_of(key: str, values: list[str | None]) -> str:
    """SQL: a value by the remainder of a key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(values) if x is not None) + " END"


#: What is written of a type, an occupancy and a state, and what it means.
TYPES = [("Appartement T3", "apartment"), ("MAI", "house"), ("Bâtiments agricoles et parcelles de prés", "mixed"), ("Hangar, stabulation", "commercial"), ("Parcelles boisées", "land"), ("Terrain et maison", "house"), ("Stationnement au sous-sol", "parking"), ("Propriété", "mixed"), ("Local commercial", "commercial"), ("Immeuble de rapport, parking", "building"), ("Cave", "other"), (None, "other"), ("studio meublé", "apartment"), ("unknown", "unknown")]
OCCUPANCIES = [("Libre de toute occupation", "vacant"), ("à vérifier", "unknown"), ("occupé sans bail", "occupied"), ("absence de bail écrit", "unknown"), ("loué à un tiers", "rented"), ("bail en cours", "rented"), ("occupé par le propriétaire", "owner_occupied"), ("squatté", "squatted"), ("occupée", "occupied"), ("amiante, plomb, termites", None), (None, None)]
STATES = [("Adjugé", "adjudicated"), ("vente passée", "past"), ("A venir", "upcoming"), ("upcoming", "upcoming"), ("reportée", ""), (None, "")]
MEANT = one_of("sale_id", [m for _, m in STATES])
over_sales(
    "sc_enum_norm",
    {
        "kind": (lambda: text.property_type_of(c("a")), one_of("sale_id", [m for _, m in TYPES])),
        "titled": (lambda: text.property_type_of(c("title")), "CASE sale_id % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'apartment' WHEN 2 THEN 'building' ELSE 'other' END"),
        "occupancy": (lambda: text.occupancy_of(c("b")), one_of("sale_id", [m for _, m in OCCUPANCIES])),
        "state": (lambda: text.sale_state_of(c("s"), c("sale_date"), F.lit("1996-01-01").cast("date")), f"coalesce(nullif({MEANT}, ''), CASE WHEN sale_date < DATE '1996-01-01' THEN 'past' ELSE 'upcoming' END)"),
    },
    a=one_of("sale_id", [w for w, _ in TYPES]),
    b=one_of("sale_id", [w for w, _ in OCCUPANCIES]),
    s=one_of("sale_id", [w for w, _ in STATES]),
)
over_sales("sc_excerpt", {"around": (lambda: text.excerpt(c("address"), "de", 6), "CASE WHEN position('de' IN address) > 0 THEN substring(address, greatest(position('de' IN address) - 6, 1), position('de' IN address) - greatest(position('de' IN address) - 6, 1) + 8) END")})
#: Labels of documents, their addresses, and what they are.
LABELS = [
    ("PV descriptif anonyme", "https://x.example/1.pdf", "pv_huissier"),
    ("Cahier des conditions de vente", "https://x.example/1.pdf", "cahier_conditions_vente"),
    ("CAHIER LIQUIDATION 20260415.pdf", None, "cahier_conditions_vente"),
    ("Dossier de présentation", None, "cahier_conditions_vente"),
    ("Diagnostics techniques DPE.pdf", None, "diagnostics_techniques"),
    ("Cahier et diagnostic", None, "diagnostics_techniques"),
    ("Dossier diag (1)", None, "diagnostics_techniques"),
    ("Avis simplifié.pdf", None, "annonce_vente"),
    ("PLACARD PUBLICITE .pdf", None, "annonce_vente"),
    ("PV de notaire.pdf", None, "pv_notaire"),
    ("Procès verbal", "https://x.example/download?id=1", "proces_verbal"),
    ("Proces verbal de description", "https://x.example/download?id=2", "pv_huissier"),
    ("Conditions de vente", None, "conditions_vente"),
    ("Bail commercial", None, "bail"),
    ("Commandement de payer", None, "procedure_saisie"),
    ("Parcelles", None, "cadastre"),
    (None, "https://x.example/2.PDF", "pdf"),
    ("Photo", "https://x.example/2", "other"),
    (None, None, "other"),
]
over_sales("sc_doc_classify", {"kind": (lambda: text.document_type(c("label"), c("url")), one_of("sale_id", [k for _, _, k in LABELS]))}, label=one_of("sale_id", [x for x, _, _ in LABELS]), url=one_of("sale_id", [u for _, u, _ in LABELS]))
over_sales("sc_title", {"shown": (lambda: text.display_title(c("property_type"), c("city"), c(SURF), c("title")), f"coalesce(nullif(trim(regexp_replace(title, '\\s+', ' ', 'g')), ''), concat_ws(' ', coalesce(CASE property_type WHEN 'apartment' THEN 'Appartement' WHEN 'house' THEN 'Maison' WHEN 'building' THEN 'Immeuble' WHEN 'land' THEN 'Terrain' WHEN 'parking' THEN 'Parking' WHEN 'commercial' THEN 'Local commercial' END, 'Bien immobilier'), CASE WHEN {SURF} > 0 THEN CAST({SURF} AS VARCHAR) || ' m²' END, '- ' || city))")})
over_sales("sc_url_guard", {"allowed": (lambda: text.allowed_url(c("u"), ["automobile.example", "building.example"]), "coalesce(starts_with(u, 'https://automobile.example/') OR starts_with(u, 'https://building.example/'), FALSE)")}, u="CASE sale_id % 4 WHEN 0 THEN replace(source_url, 'https', 'http') WHEN 1 THEN replace(source_url, '.example', '.example.evil') ELSE source_url END")
over_sales("snk_csv_safe", {"line": (lambda: F.concat_ws(",", *(text.csv_cell(x) for x in (c("t"), c("city"), c(P)))), "concat_ws(',', " + ", ".join(f"'\"' || replace(CASE WHEN regexp_matches(coalesce(CAST({x} AS VARCHAR), ''), '^[=+\\-@]') THEN '''' ELSE '' END || coalesce(CAST({x} AS VARCHAR), ''), '\"', '\"\"') || '\"'" for x in ("t", "city", P)) + ")")}, t="CASE sale_id % 4 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN 'a \"b\" c' WHEN 2 THEN '-' || title ELSE title END")
over_sales("sc_json_path", {"k": (lambda: F.get_json_object("j", "$.a.k").cast("bigint"), "CAST(json_extract_string(j, '$.a.k') AS BIGINT)"), "n_items": (lambda: F.expr("json_array_length(get_json_object(j, '$.l'))"), "CAST(json_array_length(j, '$.l') AS INTEGER)")}, j="'{\"a\":{\"k\":' || CAST(sale_id AS STRING) || '},\"l\":[1,2' || CASE sale_id % 2 WHEN 0 THEN ',3' ELSE '' END || ']}'")
over_sales("sc_json_build", {"built": (lambda: F.to_json(F.struct(c("sale_id").alias("id"), c("city"), c("status"))), "'{\"id\":' || sale_id || ',\"city\":\"' || city || '\",\"status\":\"' || status || '\"}'")})
over_sales("sc_dpe_extract", {"dpe": (lambda: F.coalesce("dpe_class", F.nullif(F.upper(F.regexp_extract("t", r"(?i)\b(?:dpe|classe)\s*:?\s*([a-g])\b", 1)), F.lit(""))), "coalesce(dpe_class, nullif(upper(regexp_extract(t, '(?i)\\b(?:dpe|classe)\\s*:?\\s*([a-g])\\b', 1)), ''))")}, t="CASE sale_id % 4 WHEN 0 THEN 'DPE : d, GES e' WHEN 1 THEN 'classe B' WHEN 2 THEN 'sans diagnostic' END")
# rules
over_sales("flt_price_sanity", {"training": (lambda: search.valid_training_price(c("property_type"), c("m2"), c(SURF)), f"CASE WHEN property_type = 'land' THEN m2 BETWEEN 1 AND 100000 ELSE m2 BETWEEN 300 AND 50000 AND {SURF} >= 9 END"), "comparable": (lambda: c("m2").between(500, 25_000) & (c(SURF) >= 9), f"m2 BETWEEN 500 AND 25000 AND {SURF} >= 9")}, m2=f"{P} / CASE WHEN {SURF} > 0 THEN {SURF} END")
over_sales("flt_dpe_match", {"some": (lambda: search.dpe_matches(c("dpe_class"), ["A", "B"]), "coalesce(dpe_class IN ('A', 'B'), FALSE)"), "every": (lambda: search.dpe_matches(c("dpe_class"), []), "TRUE")})
over_sales("flt_sale_link", {"links": (lambda: F.array_join(search.source_links(F.array("source_url", F.lit("https://other.example/x"), "source_url")), ";"), "split_part(replace(source_url, 'https://', ''), '.', 1) || '=' || source_url || ';other=https://other.example/x'")})
over_sales("sc_cdf", {"p": (lambda: F.round(num.cumulative_probability(c("x"), F.lit(40_000.0), F.lit(90_000.0), F.lit(200_000.0)), 8), "round(CASE WHEN x >= 300000 THEN 1e0 WHEN x <= 20000 THEN x / 20000 * 0.01e0 WHEN x <= 40000 THEN 0.01e0 + 0.09e0 * (ln(x) - ln(20000e0)) / (ln(40000e0) - ln(20000e0)) WHEN x <= 90000 THEN 0.1e0 + 0.4e0 * (ln(x) - ln(40000e0)) / (ln(90000e0) - ln(40000e0)) WHEN x <= 200000 THEN 0.5e0 + 0.4e0 * (ln(x) - ln(90000e0)) / (ln(200000e0) - ln(90000e0)) ELSE 0.9e0 + 0.09e0 * (ln(x) - ln(200000e0)) / (ln(300000e0) - ln(200000e0)) END, 8)")}, x=f"CAST(coalesce({P}, 0) AS DOUBLE)")
MAPE_CAP = "CASE WHEN mape >= 35 THEN 0.3e0 WHEN mape >= 25 THEN 0.45e0 ELSE 0.7e0 END"
WEIGHT = f"CASE WHEN mape IS NULL THEN qw ELSE greatest(0.2e0, least({MAPE_CAP}, qw + greatest(-0.12e0, least(0.08e0, (16 - mape) / 100)))) END"
over_sales("sc_hybrid_blend", {"weight": (lambda: F.round(num.model_weight(c("q"), c("mape")), 6), f"round({WEIGHT}, 6)"), "blend": (lambda: F.round(num.geometric_blend(F.lit(2000.0), F.lit(2600.0), num.model_weight(c("q"), c("mape"))), 4), f"round(exp(ln(2000e0) * (1 - {WEIGHT}) + ln(2600e0) * ({WEIGHT})), 4)")}, q="sale_id % 100", mape="CASE WHEN sale_id % 7 > 0 THEN (sale_id % 45) * 1e0 END", qw="CASE WHEN sale_id % 100 >= 78 THEN 0.35e0 WHEN sale_id % 100 >= 58 THEN 0.45e0 ELSE 0.6e0 END")
UNCERTAIN = "least(0.65e0, greatest(CASE sale_id % 3 WHEN 0 THEN 0.24e0 WHEN 1 THEN 0.32e0 ELSE 0.4e0 END, CASE property_type WHEN 'building' THEN 0.12e0 WHEN 'commercial' THEN 0.08e0 ELSE 0e0 END + CASE sale_id % 3 WHEN 0 THEN 0.24e0 WHEN 1 THEN 0.32e0 ELSE 0.4e0 END))"
TEN = "greatest(10e0, floor(({}) / 10 + 5e-1) * 10)"
over_sales("sc_stat_fallback", {
    "p10": (lambda: num.round_tens(c("m") * (1 - num.statistic_uncertainty(c("lvl"), c("property_type")))), TEN.format(f"m * (1 - {UNCERTAIN})")),
    "p75": (lambda: num.round_tens(c("m") * (1 + F.greatest(F.lit(0.12), num.statistic_uncertainty(c("lvl"), c("property_type")) * 0.58))), TEN.format(f"m * (1 + greatest(0.12e0, {UNCERTAIN} * 0.58e0))")),
    "quality": (lambda: num.statistic_quality(c("lvl"), c("n"), c("property_type")), "greatest(12e0, least(54e0, CASE sale_id % 3 WHEN 0 THEN 42 WHEN 1 THEN 32 ELSE 22 END + least(12e0, floor(log10(n + 1) * 6 + 5e-1)) - CASE WHEN property_type = 'building' THEN 8 ELSE 0 END))"),
}, m="CAST(1000 + sale_id % 4000 AS DOUBLE)", n="sale_id % 500", lvl="CASE sale_id % 3 WHEN 0 THEN 'commune' WHEN 1 THEN 'epci' ELSE 'department' END")


@query("flt_status_map", S + "SELECT 'upcoming' AS kind, count(*) FILTER (status IN ('upcoming')) AS n FROM sales UNION ALL SELECT 'past', count(*) FILTER (status IN ('past', 'adjudicated')) FROM sales UNION ALL SELECT 'all', count(*) FROM sales")
def status_map(spark, d):
    one = sales(spark, d).agg(*(F.count_if(c("status").isin(v)).alias(k) for k, v in search.STATUSES.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c(k).alias("n")) for k in search.STATUSES))))


@query("flt_nearby_bbox", S + "SELECT sale_id FROM sales WHERE latitude BETWEEN 45e0 - 30000e0 / 111000 AND 45e0 + 30000e0 / 111000 AND longitude BETWEEN 2e0 - 30000e0 / 111000 / cos(radians(45e0)) AND 2e0 + 30000e0 / 111000 / cos(radians(45e0))")
def nearby_bbox(spark, d):
    return sales(spark, d).where(search.in_bbox(*search.bbox_around(45.0, 2.0, 30_000))).select("sale_id")


@query("srt_dynamic", S + "SELECT sale_id, starting_price_eur FROM sales ORDER BY starting_price_eur ASC NULLS LAST, sale_id LIMIT 1000")
def srt_dynamic(spark, d):
    return search.page(sales(spark, d).select("sale_id", "starting_price_eur"), "price_asc", 5000)


@query("win_total_count", S + "SELECT sale_id, count(*) OVER () AS total_count FROM sales ORDER BY surface_m2 DESC NULLS LAST, sale_id LIMIT 20")
def total_count(spark, d):
    return search.page_with_total(sales(spark, d), "surface_desc", 20).select("sale_id", "total_count")


@query("agg_effective_sample", S + "SELECT city, round(pow(sum(investment_score), 2) / sum(investment_score * investment_score), 4) AS effective_n FROM sales WHERE investment_score > 0 GROUP BY city")
def effective_sample(spark, d):
    return agg.weighted_average(sales(spark, d).where("investment_score > 0"), "city", c("sale_id"), c("investment_score")).select("city", "effective_n")


@query("agg_parcel_sum_of_max", f"WITH {MUTATIONS_CTE} SELECT mutation_id, CAST(sum(m) AS BIGINT) AS land_m2 FROM (SELECT mutation_id, parcel_id, max(land_m2) AS m FROM mutations GROUP BY ALL) GROUP BY mutation_id")
def parcel_sum_of_max(spark, d):
    return agg.sum_of_max(mutations(spark, d), "mutation_id", "parcel_id", "land_m2")


@query("agg_distinct_centroid", f"WITH {MUTATIONS_CTE} SELECT mutation_id, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM (SELECT DISTINCT mutation_id, latitude, longitude FROM mutations) GROUP BY mutation_id")
def distinct_centroid(spark, d):
    return agg.distinct_centroid(mutations(spark, d), "mutation_id")


@query("win_running_weight", S + ", v AS (SELECT city, investment_score AS v, sum(surface_m2) AS w FROM sales WHERE investment_score IS NOT NULL AND surface_m2 IS NOT NULL GROUP BY ALL) SELECT city, v, CAST(sum(w) OVER (PARTITION BY city ORDER BY v) AS BIGINT) AS upto FROM v")
def running_weight(spark, d):
    return agg.running_weight(sales(spark, d).where("investment_score IS NOT NULL AND surface_m2 IS NOT NULL"), "city", "investment_score", "surface_m2")


CELL_Q, CELL_R = hexagon("latitude", "longitude", LAND)


@query("agg_cell_log_stats", f"WITH {MUTATIONS_CTE} SELECT {CELL_Q} AS q, {CELL_R} AS r, count(*) AS n, round(sum(ln(price_eur)), 6) AS sum_log, round(stddev_samp(ln(price_eur)), 6) AS std_log FROM mutations WHERE price_eur > 0 GROUP BY ALL")
def cell_log_stats(spark, d):
    return agg.cell_log_stats(mutations(spark, d), c("latitude"), c("longitude"), c("price_eur"), LAND)
