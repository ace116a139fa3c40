"""A hexagonal index as Column arithmetic: axial coordinates of cells on a plane, their rings, distances and parents.

Places are laid on a plane by their latitude and, shortened by the cosine of a middle latitude, their longitude: true to about a per cent over some degrees around it. A cell is (q, r); its corners point north; `size` is its edge in metres. Nulls stay nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH, MIDDLE_LATITUDE = 6_371_000, 46.5
#: Mean edges of cells, in metres, by what is compared in them.
EDGES = {"land": 1220.63, "house": 461.355, "apartment": 174.376}
#: An inner edge to that of the next coarser cells.
COARSER = 7**0.5


def plane(lat: Column, lng: Column, middle: float = MIDDLE_LATITUDE) -> tuple[Column, Column]:
    return F.radians(lng) * F.cos(F.radians(F.lit(middle))) * EARTH, F.radians(lat) * EARTH


def _rounded(q: Column, r: Column) -> Column:
    """The cell of fractional coordinates: of the three, which sum to zero, the one that is moved most by rounding follows from the others."""
    nearest = lambda x: F.floor(x + 0.5)
    s = -q - r
    a, b, d = nearest(q), nearest(r), nearest(s)
    far = lambda x, y: F.abs(x - y)
    moved_q = (far(a, q) > far(b, r)) & (far(a, q) > far(d, s))
    moved_r = ~moved_q & (far(b, r) > far(d, s))
    return F.struct(F.when(moved_q, -b - d).otherwise(a).cast("bigint").alias("q"), F.when(moved_r, -a - d).otherwise(b).cast("bigint").alias("r"))


def cell_of(lat: Column, lng: Column, size: float, middle: float = MIDDLE_LATITUDE) -> Column:
    """Struct q, r of the cell that a place lies in; null without a place."""
    x, y = plane(lat, lng, middle)
    return F.when(lat.isNotNull() & lng.isNotNull(), _rounded((x * (3**0.5 / 3) - y / 3) / size, y * (2 / 3) / size))


def centre_of(cell: Column, size: float) -> tuple[Column, Column]:
    """The middle of a cell on the plane."""
    return (cell["q"] + cell["r"] / 2) * (3**0.5 * size), cell["r"] * (1.5 * size)


def parent_of(cell: Column, size: float) -> Column:
    """The coarser cell (of edge size * COARSER) that a cell's middle lies in."""
    x, y = centre_of(cell, size)
    return F.when(cell.isNotNull(), _rounded((x * (3**0.5 / 3) - y / 3) / (size * COARSER), y * (2 / 3) / (size * COARSER)))


def steps_between(a: Column, b: Column) -> Column:
    """How many cells one is from another."""
    q, r = a["q"] - b["q"], a["r"] - b["r"]
    return ((F.abs(q) + F.abs(r) + F.abs(q + r)) / 2).cast("int")


def disk(cell: Column, k: int) -> Column:
    """All cells within k steps, as an array. With k = 1, any place within an edge of a place in the cell lies in one of them."""
    near = [(q, r) for q in range(-k, k + 1) for r in range(-k, k + 1) if abs(q) + abs(r) + abs(q + r) <= 2 * k]
    return F.when(cell.isNotNull(), F.array(*(F.struct((cell["q"] + q).alias("q"), (cell["r"] + r).alias("r")) for q, r in near)))
