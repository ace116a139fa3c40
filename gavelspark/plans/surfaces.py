"""Queries of surfaces that are settled, beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import surfaces
from ..sources.adapters import SALES_CTE, sales
from .registry import query

c = F.col
S = f"WITH {SALES_CTE} "

INPUTS = {"property_type": "string", **dict.fromkeys([*surfaces.STORED, *surfaces.SAID, "title_built_m2", "description_built_m2"], "double"), "land_in_document": "boolean", "surface_in_document": "boolean", "surface_scope": "string", "text": "string"}
OUTPUTS = ["surface_m2", "habitable_m2", "carrez_m2", "land_m2"]
SHOWN = ["app_surface_m2", "app_surface_kind", "surface_scope"]
#: What is known of a sale, what is settled (in the order of OUTPUTS), what is shown (of SHOWN), and flags.
SETTLED = [
    ({"property_type": "apartment", "surface_m2": 50}, (50, None, 50, None), (50, "carrez", "total"), ""),
    ({"property_type": "apartment", "carrez_m2": 40, "said_carrez_m2": 39.82}, (39.82, None, 39.82, None), (39.82, "carrez", "total"), "surface_conflict_resolved"),
    ({"property_type": "apartment", "carrez_m2": 40, "said_carrez_m2": 45.5}, (40, None, 40, None), (40, "carrez", "total"), ""),
    ({"property_type": "house", "surface_m2": 5, "land_m2": 800}, (None, None, None, 800), (None, None, "land"), ""),
    ({"property_type": "house", "surface_m2": 80, "said_built_m2": 120}, (120, 120, None, None), (120, "habitable", "total"), ""),
    ({"property_type": "house", "surface_m2": 80, "said_built_m2": 120, "title_built_m2": 120, "description_built_m2": 120}, (120, 120, None, None), (120, "habitable", "total"), "surface_conflict_resolved"),
    ({"property_type": "house", "surface_m2": 80, "said_built_m2": 120, "surface_in_document": True}, (80, 80, None, None), (80, "habitable", "total"), ""),
    ({"property_type": "house", "surface_m2": 80, "said_built_m2": 12}, (80, 80, None, None), (80, "habitable", "total"), ""),
    ({"property_type": "house", "habitable_m2": 15}, (None, 15, None, None), (None, None, "room_or_annex"), "ambiguous_surface"),
    ({"property_type": "land", "land_m2": 1200}, (None, None, None, 1200), (1200, "land", "land"), ""),
    ({"property_type": "land", "said_land_m2": 900}, (None, None, None, 900), (900, "land", "land"), ""),
    ({"property_type": "commercial", "surface_m2": 1500}, (1500, None, None, None), (None, None, "unknown"), "ambiguous_surface"),
    ({"property_type": "commercial", "surface_m2": 1500, "text": "Entrepôt et bureaux"}, (1500, None, None, None), (1500, "built", "total"), ""),
    ({"property_type": "mixed", "land_m2": 700}, (None, None, None, 700), (700, "land", "land"), ""),
    ({"property_type": "apartment", "surface_m2": 60, "land_m2": 500}, (60, None, 60, None), (60, "carrez", "total"), ""),
    ({"property_type": "house", "surface_m2": 100, "land_m2": 100}, (100, 100, None, None), (100, "habitable", "total"), "land_surface_conflict_resolved"),
    ({"property_type": "house", "surface_m2": 100, "land_m2": 50, "said_land_m2": 450}, (100, 100, None, 450), (100, "habitable", "total"), "land_surface_conflict_resolved"),
    ({"property_type": "house", "surface_m2": 100, "land_m2": 50, "said_land_m2": 450, "land_in_document": True}, (100, 100, None, 50), (100, "habitable", "total"), ""),
    ({"property_type": "building", "habitable_m2": 30}, (None, 30, None, None), (30, "built", "total"), ""),
    ({"property_type": "apartment", "habitable_m2": 45, "carrez_m2": 42}, (42, 45, 42, None), (42, "carrez", "total"), "ambiguous_surface"),
    ({"property_type": "apartment", "surface_m2": 50, "surface_scope": "partial"}, (50, None, 50, None), (None, None, "partial"), "ambiguous_surface"),
    ({"property_type": "other", "said_habitable_m2": 70}, (None, 70, None, None), (70, "habitable", "total"), ""),
    ({"surface_m2": 60}, (60, None, None, None), (None, None, None), "ambiguous_surface"),
    ({}, (None, None, None, None), (None, None, None), ""),
]


def _literal(x, kind: str) -> str:
    if x is None:
        return f"CAST(NULL AS {kind.upper().replace('STRING', 'VARCHAR')})"
    return f"'{x}'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else f"{float(x)}e0"


EXPECTED = ", ".join(f"({i}, {', '.join(_literal(x, 'double') for x in settled)}, {_literal(shown[0], 'double')}, {_literal(shown[1], 'string')}, {_literal(shown[2], 'string')}, '{flags}')" for i, (_, settled, shown, flags) in enumerate(SETTLED))
MEANT = S + f", x(i, {', '.join(OUTPUTS)}, {', '.join(SHOWN)}, flags) AS (VALUES {EXPECTED}) SELECT sale_id, {{}} FROM sales JOIN x ON sale_id % {len(SETTLED)} = i"
MEANT = MEANT.replace("sale_id, {}", "sale_id, {cols}").replace("FROM sales JOIN x", "FROM (SELECT sale_id FROM sales) JOIN x")


def settled(spark, d):
    """Sales, with what is known of their surfaces by the remainder of their id."""
    known = [tuple(x.get(n) if x.get(n) is None or k != "double" else float(x[n]) for n, k in INPUTS.items()) for x, _, _, _ in SETTLED]
    inputs = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for v, (n, k) in zip(row, INPUTS.items(), strict=True))) for row in known))
    rows = sales(spark, d).select("sale_id", F.get(inputs, (c("sale_id") % len(SETTLED)).cast("int")).alias("x")).select("sale_id", "x.*")
    return surfaces.resolve_surfaces(rows).withColumn("flags", F.array_join("flags", ","))


@query("sc_surface_rules", MEANT.format(cols=", ".join([*OUTPUTS, "flags"])))
def surface_rules(spark, d):
    return settled(spark, d).select("sale_id", *OUTPUTS, "flags")


@query("sc_app_surface", MEANT.format(cols=", ".join(SHOWN)))
def app_surface(spark, d):
    return settled(spark, d).select("sale_id", *SHOWN)
