"""Numbers, money, dates and places as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text

PI = math.pi
#: Works a square metre by scenario.
WORKS_M2 = {"refresh": 350, "renovation": 900, "full": 1850}
#: South, north, west and east of departments that are checked.
DEPARTMENT_BOXES = {"05": (44.1, 45.2, 5.4, 7.1), "16": (45.1, 46.2, -0.5, 1.0), "24": (44.5, 45.8, -0.1, 1.5)}

#: Notary fees by bracket (upper bound, rate), taxes and costs.
BRACKETS = [(6_500, 0.07), (17_000, 0.0385), (30_000, 0.0275), (None, 0.015)]
VAT, DUTIES, FIXED_COSTS = 0.20, 0.058, 3_000
#: Rent a square metre by department, and where none is known.
RENTS = {"75": 32, "92": 26, "93": 19, "94": 21, "78": 18, "77": 14, "91": 15, "95": 15, "69": 15, "13": 14, "06": 17, "33": 14, "31": 13, "44": 13, "67": 12, "59": 11, "35": 13, "34": 13, "76": 11, "38": 12, "83": 14, "42": 9, "29": 11, "21": 11}
DEFAULT_RENT = 11.0


def decimal_fr(x: Column) -> Column:
    """A decimal with comma and (narrow) no-break spaces; null if it is none."""
    return F.translate(F.regexp_replace(x, r"[\s  ]", ""), ",", ".").try_cast("decimal(18,2)")


def parse_price(x: Column) -> Column:
    """The first number, with French separators: 1.234,50 or 1 234 or 1234.5; null if what is found is none."""
    packed = F.replace(F.regexp_extract(clean_text(x), r"([0-9][0-9\s.,]*)", 1), F.lit(" "), F.lit(""))
    bare = F.replace(packed, F.lit("."), F.lit(""))
    return F.when(packed.contains(","), F.replace(bare, F.lit(","), F.lit("."))).when(packed.rlike(r"^\d{1,3}(\.\d{3})+$"), bare).otherwise(packed).try_cast("double")


def confidence(x: Column) -> Column:
    """0 to 1; what lies above 1, to 100, is per cent; further values are held to 0 and 1."""
    return F.when(x < 0, 0.0).when(x <= 1, x).when(x <= 100, x / 100).when(x > 100, 1.0)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half goes up, also below zero."""
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f


def price_m2(price: Column, surface: Column) -> Column:
    return F.when(surface > 0, price / surface)


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres between two points; null if a coordinate is."""
    r = F.radians
    a = F.pow(F.sin(r(lat2 - lat1) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(r(lng2 - lng1) / 2), 2)
    return 2 * 6_371_000 * F.asin(F.sqrt(F.when(a.isNotNull(), F.least(F.lit(1.0), a))))


def ring_similarity(ring: Column) -> Column:
    """By Chebyshev distance of two cells."""
    return F.when(ring == 0, 1.0).when(ring == 1, 0.82).when(ring == 2, 0.58).when(ring == 3, 0.38).otherwise(0.2)


def month_distance(later: Column, earlier: Column) -> Column:
    """Days over 30.4375, not calendar months."""
    return F.datediff(later, earlier) / 30.4375


def add_months_overflow(d: Column, months: int) -> Column:
    """31 January plus one month is 2 or 3 March."""
    return F.date_add(F.add_months(F.trunc(d, "month"), months), F.dayofmonth(d) - 1)


def first_date(x: Column) -> Column:
    """One of three formats, else null."""
    return F.coalesce(*(F.when(x.rlike(p), F.try_to_timestamp(x, F.lit(f)).cast("date")) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"))))


def next_dispatch(ts: Column, weekly: bool) -> Column:
    """07:00 of the next day, or of the next Monday."""
    day = F.next_day(ts, "MON") if weekly else F.date_add(F.to_date(ts), 1)
    return F.to_timestamp(day) + F.expr("INTERVAL 7 HOURS")


def segment(kind: Column) -> Column:
    """Market segment of a type in words; the first that matches."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    rules = [("land", r"terrain|\bland\b|parcelle"), ("apartment", r"appartement|apartment|studio|\bapt\b|\bt[1-9]\b"), ("house", "maison|house|villa|pavillon"), ("building", "immeuble|building"), ("commercial", "commerce|commercial|local d'activit|local professionnel|bureau|retail"), ("building", r"\b(mixed|mixte)\b")]
    return F.coalesce(*(F.when(k.rlike(pattern), name) for name, pattern in rules), F.lit("unsupported"))


def type_code(code: Column, kind: Column, built: Column, land: Column) -> Column:
    """Register code of a type; dwellings and premises need a built surface, bare land a land surface."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    has = F.coalesce(code, F.lit(""))
    needs_built = lambda out: F.when(built.isNotNull(), out)
    return (
        F.when(has.isin("111", "121", "112", "122", "123", "141", "142", "151", "152"), code)
        .when((has == "1") | k.rlike("maison|villa|pavillon|house"), needs_built("111"))
        .when((has == "2") | k.rlike("appartement|studio|apartment"), needs_built("121"))
        .when((has == "4") | k.rlike("local industriel|local commercial|commerce|bureau"), needs_built("141"))
        .when(code.isNull() & (k == "") & built.isNull() & (land > 0), "211")
    )


def urgency(days: Column) -> Column:
    return F.when(days < 0, "past").when(days < 7, "week").when(days < 30, "month").when(days.isNotNull(), "later")


def in_department(lat: Column, lng: Column, department: Column) -> Column:
    """Whether a place lies in the box of its department; not, for departments without one; null without a place."""
    out = F
    for k, (south, north, west, east) in DEPARTMENT_BOXES.items():
        out = out.when(department == k, lat.between(south, north) & lng.between(west, east))
    return out.otherwise(F.lit(False))


def model_weight(quality: Column, mape: Column) -> Column:
    """Weight of a model beside comparables: less where these are good, and by its own mean error in per cent."""
    base = F.when(quality >= 78, 0.35).when(quality >= 58, 0.45).otherwise(0.6)
    cap = F.when(mape >= 35, 0.3).when(mape >= 25, 0.45).otherwise(0.7)
    adjusted = base + F.greatest(F.lit(-0.12), F.least(F.lit(0.08), (16 - mape) / 100))
    return F.when(mape.isNull(), base).otherwise(F.greatest(F.lit(0.2), F.least(cap, adjusted)))


def geometric_blend(comparable: Column, model: Column, weight: Column) -> Column:
    return F.exp(F.ln(comparable) * (1 - weight) + F.ln(model) * weight)


def statistic_uncertainty(level: Column, kind: Column) -> Column:
    scope = F.when(level == "commune", 0.24).when(level == "epci", 0.32).otherwise(0.4)
    return F.least(F.lit(0.65), F.greatest(scope, F.when(kind == "building", 0.12).when(kind == "commercial", 0.08).otherwise(0.0) + scope))


def statistic_quality(level: Column, n: Column, kind: Column) -> Column:
    """12 to 54: by level, by number of sales, less for buildings."""
    scope = F.when(level == "commune", 42).when(level == "epci", 32).otherwise(22)
    score = scope + F.least(F.lit(12.0), round_half_up(F.log10(n + 1) * 6)) - F.when(kind == "building", 8).otherwise(0)
    return F.greatest(F.lit(12.0), F.least(F.lit(54.0), score))


def round_tens(x: Column) -> Column:
    return F.greatest(F.lit(10.0), round_half_up(x / 10) * 10)


def emoluments(price: Column) -> Column:
    """Progressive fees before tax."""
    total, low = F.lit(0.0), 0
    for high, rate in BRACKETS:
        part = price - low if high is None else F.least(price, F.lit(high)) - low
        total = total + F.greatest(part, F.lit(0)) * rate
        low = high or low
    return total


def acquisition_cost(price: Column, works: Column | None = None) -> Column:
    return price + emoluments(price) * (1 + VAT) + price * DUTIES + FIXED_COSTS + (F.lit(0) if works is None else works)


def max_bid(total: Column) -> Column:
    """The highest bid, in whole hundreds, whose cost of acquisition is at most total: the inverse of the piecewise-linear cost, piece by piece."""
    best = F.lit(0.0)
    low, base = 0, 0.0
    for high, rate in BRACKETS:
        slope = 1 + DUTIES + rate * (1 + VAT)
        start = low * (1 + DUTIES) + base * (1 + VAT) + FIXED_COSTS
        here = low + (total - start) / slope
        best = F.when(total > start, here if high is None else F.least(here, F.lit(float(high)))).otherwise(best)
        if high is not None:
            base += (high - low) * rate
            low = high
    return F.floor(F.greatest(best, F.lit(0.0)) / 100) * 100


def rent_m2(department: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in RENTS.items() for x in (pair[0], float(pair[1]))))
    return F.coalesce(F.try_element_at(known, department), F.lit(DEFAULT_RENT))


def gross_yield_pct(price: Column, surface: Column, rent: Column | None = None) -> Column:
    """A year's rent over 1.1 prices, in per cent."""
    return F.when((price > 0) & (surface > 0), surface * (F.lit(DEFAULT_RENT) if rent is None else rent) * 12 / (price * 1.1) * 100)


def annuity(principal: Column, yearly_rate: float, years: int) -> Column:
    """Monthly payment."""
    r = yearly_rate / 12
    return principal * (r / (1 - math.pow(1 + r, -12 * years)))


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile."""
    n = float(1 << zoom)
    x = F.floor((lng + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2 * n)
    return x.cast("bigint"), y.cast("bigint")


def centroid(points: Column) -> Column:
    """Mean of the vertices of a ring: array<struct<x, y>>."""
    mean = lambda f: F.aggregate(F.transform(points, lambda p: p[f].cast("double")), F.lit(0.0), lambda a, v: a + v) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray cast over the edges of a closed ring: array<struct<x, y>>."""
    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    edges = F.sequence(F.lit(0), F.size(ring) - 2)
    return F.size(F.filter(edges, lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def cumulative_probability(x: Column, p10: Column, p50: Column, p90: Column) -> Column:
    """Probability that a price is at most x: linear to half of p10, then linear in the logarithm through 1, 10, 50, 90 and 99 % at half of p10, p10, p50, p90 and 1.5 of p90; 1 from there."""
    low, high = F.greatest(F.lit(1.0), p10 * 0.5), F.greatest(p90 + 1, p90 * 1.5)
    price = F.greatest(x, F.lit(0.0))
    out = F.when(price >= high, 1.0).when(price <= low, price / low * 0.01)
    knots = [(low, 0.01), (p10, 0.1), (p50, 0.5), (p90, 0.9), (high, 0.99)]
    for (a, pa), (b, pb) in zip(knots, knots[1:], strict=False):
        out = out.when(price <= b, F.when(a == b, pb).otherwise(pa + (pb - pa) * (F.ln(price) - F.ln(a)) / (F.ln(b) - F.ln(a))))
    return out.otherwise(1.0)


#: Fixed values of a let property: share of rent lost, of rent for charges, tax and insurance, own funds, yearly rate, years, insurance of the loan, and the yields aimed for.
VACANCY, CHARGES, OWN, RATE, YEARS, LOAN_INSURANCE, GROSS_AIM, NET_AIM = 0.05, 0.165, 0.2, 0.042, 20, 0.0025, 6.5, 4.5


def rentability(rows, price: Column, rent: Column):
    """rows with gross_yield and net_yield (per cent), cashflow a month, break_even occupancy (per cent) and score (0 to 100) of letting at an estimated rent a month."""
    total = acquisition_cost(price)
    gross = rent * 12
    net = gross * (1 - VACANCY - CHARGES)
    loan = total * (1 - OWN)
    debt = (annuity(loan, RATE, YEARS) + loan * LOAN_INSURANCE / 12) * 12
    gy, ny, cash, even = gross / total * 100, net / total * 100, (net - debt) / 12, (gross * CHARGES + debt) / gross * 100
    step = lambda x, aim: F.when(x - aim >= 2, 16).when(x - aim >= 0, 10).when(x - aim >= -1, 4).otherwise(-12)
    score = 50 + step(gy, GROSS_AIM) + step(ny, NET_AIM) + F.when(cash >= 300, 14).when(cash >= 0, 8).when(cash >= -150, -6).otherwise(-14) + F.when(even <= 80, 8).when(even <= 92, 2).when(even <= 100, -4).otherwise(-12) - 4
    return rows.withColumns({"gross_yield": round_half_up(gy, 1), "net_yield": round_half_up(ny, 1), "cashflow": round_half_up(cash), "break_even": round_half_up(even, 1), "score": F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint")})


#: Built surface by number of rooms, the surface a room more adds, and the one without a number.
ROOM_SURFACES = {"apartment": ([20, 42, 62, 82, 105], 20, 50), "house": ([45, 60, 80, 100, 120], 22, 100)}
STUDIO = 20


def resolved_surface(kind: Column, surface: Column, rooms: Column, bedrooms: Column) -> tuple[Column, Column]:
    """The surface to show (that of a studio for a flat of one room without one), and the built surface for valuation (estimated from rooms, or bedrooms and one, where it is unknown or below 9; none for land)."""
    known = F.when(surface > 0, surface)
    shown = F.coalesce(known, F.when((rooms <= 1) & (kind == "apartment"), STUDIO))
    n = F.coalesce(F.when(rooms > 0, rooms), F.when(bedrooms > 0, bedrooms + 1))
    n = F.when(n.isNotNull(), F.greatest(F.lit(1), n))
    out = F.when(kind == "land", None).when(surface >= 9, surface)
    for k, (table, more, none) in ROOM_SURFACES.items():
        out = out.when(kind == k, F.when(n.isNull(), F.lit(none)).otherwise(F.get(F.lit(table), F.least(F.lit(5), n).cast("int") - 1) + F.greatest(F.lit(0), n - 5) * more))
    out = out.when(kind == "building", F.coalesce(n * 28, F.lit(250))).when(kind == "commercial", F.coalesce(n * 28, F.lit(80)))
    return shown, out


def progress_pct(done: Column, total: Column) -> Column:
    """Whole per cent; nothing to do is done."""
    return F.when(total == 0, 100.0).otherwise(round_half_up(done / total * 100))
