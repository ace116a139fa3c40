"""Surfaces of a sale: what is stored against what its texts say, as one ordered fold of rules, and the surface that is shown.

A rule is a name, a condition and what it sets; rules apply in their order, each to what the ones before left, and a rule that applied is named in `rules`. Conflicts that are settled and surfaces that stay ambiguous raise flags.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.occurrences import ANY_CASE

c = F.col

#: Least surfaces of a room's and of a home's size, what is large for no dwelling, and how far apart two measures are another's.
ROOM, HOME, LARGE, APART = 9, 20, 1000, 1.5
#: What supports a large surface that is no dwelling's; types that may have land.
LARGE_USE = r"\b(?:surface\s+totale|b[âa]timent|stabulation|hangar|stockage|salle\s+de\s+traite|local\s+(?:commercial|industriel)|entrep[oô]t|atelier)\b"
WITH_LAND = ["land", "house", "building", "commercial", "mixed"]

#: Surfaces in square metres, as stored and as texts say (null: not); the columns that rules read and set.
STORED = ["surface_m2", "habitable_m2", "carrez_m2", "land_m2"]
SAID = ["said_habitable_m2", "said_carrez_m2", "said_land_m2", "said_built_m2"]


@dataclass
class Rule:
    name: str
    when: Callable[[], Column]
    sets: dict[str, Callable[[], Column]]
    flag: str | None = None


def _is(*kinds: str) -> Column:
    return F.coalesce(c("property_type").isin(*kinds), F.lit(False))


def _null(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def _whole(x: Column) -> Column:
    return x == F.floor(x)


def _built() -> Column:
    """All built surfaces that are known."""
    return F.array_compact(F.array("surface_m2", "habitable_m2", "carrez_m2"))


def _longer_by_digits(now: Column, said: Column) -> Column:
    """Whether a larger whole number ends in the digits of another, or is about ten times it: a digit or a thousand was lost."""
    digits = lambda x: x.cast("bigint").cast("string")
    return _whole(now) & _whole(said) & (digits(said).endswith(digits(now)) | said.between(now * 9, now * 11))


def _differs(now: str, said: str) -> Column:
    return c(now).isNotNull() & c(said).isNotNull() & (c(now) != c(said))


def _takes_carrez() -> Column:
    """A measure of the text goes before a stored one if it only adds decimals to it, or is another surface altogether."""
    now, said = c("carrez_m2"), c("said_carrez_m2")
    decimals = _whole(now) & ~_whole(said)
    other = (F.least(now, said) > 0) & (F.greatest(now, said) >= F.least(now, said) * APART)
    return _differs("carrez_m2", "said_carrez_m2") & (said >= ROOM) & F.when(decimals, F.abs(now - said) < 1).otherwise(other)


def _takes_land() -> Column:
    now, said = c("land_m2"), c("said_land_m2")
    built = F.array_contains(_built(), now) & ~F.array_contains(_built(), said)
    return _differs("land_m2", "said_land_m2") & ~c("land_in_document") & (built | ((said > now) & _longer_by_digits(now, said)))


def _agreed() -> Column:
    """Title and description tell the same built surface, which is the text's."""
    return F.coalesce((c("title_built_m2") == c("description_built_m2")) & (c("title_built_m2") == c("said_built_m2")), F.lit(False))


def _takes_built() -> Column:
    now, said = c("surface_m2"), c("said_built_m2")
    better = (now < ROOM) | ((said >= HOME) & (said > now)) | ((said >= ROOM) & _agreed())
    return _differs("surface_m2", "said_built_m2") & _is("house", "apartment", "building") & ~c("surface_in_document") & better


def _was(x: str) -> Column:
    return F.coalesce(c(x) == c("surface_before"), F.lit(False))


RULES = [
    Rule("habitable_said", lambda: c("habitable_m2").isNull() & c("said_habitable_m2").isNotNull(), {"habitable_m2": lambda: c("said_habitable_m2")}),
    Rule("carrez_measured", lambda: _takes_carrez() & ~c("carrez_in_document"), {"carrez_m2": lambda: c("said_carrez_m2")}, "surface_conflict_resolved"),
    Rule("carrez_said", lambda: c("carrez_m2").isNull() & c("said_carrez_m2").isNotNull(), {"carrez_m2": lambda: c("said_carrez_m2")}),
    Rule("land_corrected", _takes_land, {"land_m2": lambda: c("said_land_m2")}, "land_surface_conflict_resolved"),
    Rule("land_is_built", lambda: c("said_land_m2").isNull() & _is("house", "apartment", "building") & ~c("land_in_document") & F.array_contains(_built(), c("land_m2")), {"land_m2": _null}, "land_surface_conflict_resolved"),
    Rule("land_said", lambda: c("stored_land_m2").isNull() & c("land_m2").isNull() & c("said_land_m2").isNotNull(), {"land_m2": lambda: c("said_land_m2")}),
    Rule("placeholder_habitable", lambda: _is("house", "building") & c("land_m2").isNotNull() & (c("habitable_m2") < ROOM), {"habitable_m2": _null}),
    Rule("placeholder_built", lambda: _is("house", "building") & c("land_m2").isNotNull() & (c("surface_m2") < ROOM) & c("habitable_m2").isNull(), {"surface_m2": _null}),
    Rule("built_settled", lambda: _takes_built() & _agreed(), {"settled": lambda: F.lit(True)}, "surface_conflict_resolved"),
    Rule("built_corrected", _takes_built, {"surface_before": lambda: c("surface_m2"), "surface_m2": lambda: c("said_built_m2"), "corrected": lambda: F.lit(True)}),
    Rule("habitable_follows", lambda: c("corrected") & _is("house", "apartment") & (c("habitable_m2").isNull() | _was("habitable_m2")), {"habitable_m2": lambda: c("surface_m2")}),
    Rule("carrez_follows", lambda: c("corrected") & _is("apartment") & _was("carrez_m2"), {"carrez_m2": lambda: c("surface_m2")}),
    Rule("built_said", lambda: c("surface_m2").isNull() & c("said_built_m2").isNotNull(), {"surface_m2": lambda: c("said_built_m2")}),
    Rule("measured_goes_first", lambda: (_is("apartment") & (F.coalesce("carrez_m2", "habitable_m2") >= ROOM)) | (_is("house") & (c("habitable_m2") >= HOME)), {"surface_m2": lambda: F.when(_is("apartment"), F.coalesce("carrez_m2", "habitable_m2")).otherwise(c("habitable_m2"))}),
    Rule("house_without_habitable", lambda: c("habitable_m2").isNull() & _is("house") & c("surface_m2").isNotNull(), {"habitable_m2": lambda: c("surface_m2")}),
    Rule("apartment_without_carrez", lambda: c("carrez_m2").isNull() & _is("apartment") & c("surface_m2").isNotNull(), {"carrez_m2": lambda: c("surface_m2")}),
    Rule("no_land", lambda: c("land_m2").isNotNull() & ~_is(*WITH_LAND), {"land_m2": _null}),
]


def app_surface() -> tuple[Column, Column, Column]:
    """The surface that is shown, its kind (carrez, habitable, built, land) and its scope (total, land, partial), by the type of property. A partial measure shows none."""
    built = F.coalesce("surface_m2", "habitable_m2", "carrez_m2")
    one = lambda m2, kind: F.when(m2.isNotNull(), F.struct(m2.alias("m2"), F.lit(kind).alias("kind")))
    carrez, habitable, land = one(c("carrez_m2"), "carrez"), one(c("habitable_m2"), "habitable"), one(c("land_m2"), "land")
    shown = F.when(_is("apartment"), F.coalesce(carrez, habitable)).when(_is("land"), land).when(_is("building"), one(built, "built")).when(_is("commercial", "mixed"), F.coalesce(one(built, "built"), land)).otherwise(habitable)
    shown = F.when(c("surface_scope").isNull() | (c("surface_scope") != "partial"), shown)
    scope = F.when(shown.isNotNull(), F.when(shown["kind"] == "land", "land").otherwise("total")).otherwise(c("surface_scope"))
    return shown["m2"], shown["kind"], scope


def resolve_surfaces(sales: DataFrame) -> DataFrame:
    """Sales with property_type, STORED, SAID, title_built_m2 and description_built_m2, land_in_document, carrez_in_document and surface_in_document (true: from a file), surface_scope, and text in; STORED settled, app_surface_m2, app_surface_kind, surface_scope, flags and rules (what applied, in order) beside their other columns out. All that is not given is null, or false.

    A house or building of under HOME square metres is a room; a shop or other property of over LARGE without a word of such a use is of unknown scope: both show no surface and are ambiguous, as are sales with two different measures that are neither house nor building, and those with a surface that is not shown.
    """
    inputs = {**dict.fromkeys([*STORED, *SAID, "title_built_m2", "description_built_m2"], "double"), **dict.fromkeys(["land_in_document", "carrez_in_document", "surface_in_document"], "boolean"), "surface_scope": "string", "text": "string", "property_type": "string"}
    out = sales.withColumns({n: (c(n) if n in sales.columns else F.lit(None)).cast(kind) for n, kind in inputs.items()})
    out = out.withColumns({n: F.coalesce(c(n), F.lit(False)) for n, kind in inputs.items() if kind == "boolean"})
    none = F.array().cast("array<string>")
    out = out.withColumns({"stored_land_m2": c("land_m2"), "surface_before": _null(), "corrected": F.lit(False), "settled": F.lit(False), "flags": none, "rules": none})
    for rule in RULES:
        out = out.withColumn("_on", F.coalesce(rule.when(), F.lit(False)))
        told = {"rules": F.when(c("_on"), F.array_append("rules", F.lit(rule.name))).otherwise(c("rules"))}
        if rule.flag:
            told["flags"] = F.when(c("_on"), F.array_append("flags", F.lit(rule.flag))).otherwise(c("flags"))
        out = out.withColumns({n: F.when(c("_on"), value()).otherwise(c(n)) for n, value in rule.sets.items()} | told)
    m2, kind, scope = app_surface()
    out = out.withColumns({"app_surface_m2": m2, "app_surface_kind": kind, "surface_scope": scope})
    room = _is("house", "building") & (c("app_surface_m2") < HOME)
    unsupported = _is("commercial", "mixed", "other", "unknown") & (c("app_surface_m2") > LARGE) & ~F.coalesce(c("text").rlike(ANY_CASE + LARGE_USE), F.lit(False))
    out = out.withColumns({"_room": F.coalesce(room, F.lit(False)), "_unsupported": F.coalesce(unsupported, F.lit(False))})
    hidden = c("_room") | c("_unsupported")
    out = out.withColumns({"app_surface_m2": F.when(~hidden, c("app_surface_m2")), "app_surface_kind": F.when(~hidden, c("app_surface_kind")), "surface_scope": F.when(c("_room"), "room_or_annex").when(c("_unsupported"), "unknown").otherwise(c("surface_scope"))})
    measures = F.array_distinct(F.array_compact(F.array("habitable_m2", "carrez_m2", "land_m2")))
    ambiguous = hidden | ((F.size(measures) > 1) & ~_is("house", "building")) | (c("app_surface_m2").isNull() & c("surface_m2").isNotNull())
    land = c("surface_scope").isNull() & c("app_surface_m2").isNull() & c("land_m2").isNotNull() & _is("house", "building")
    out = out.withColumns({"surface_scope": F.when(land, "land").otherwise(c("surface_scope")), "flags": F.array_distinct(F.when(ambiguous, F.array_append("flags", F.lit("ambiguous_surface"))).otherwise(c("flags")))})
    gone = ["_on", "_room", "_unsupported", "stored_land_m2", "surface_before", "corrected", "settled", *(n for n in inputs if n not in (*STORED, "surface_scope") and n not in sales.columns)]
    return out.drop(*gone)
