"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and the letters that they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Patterns of short forms in addresses and the words for them, applied in this order; particles that are left out.
STREET_WORDS = [
    (r"\b(?:av|aven)\b", "avenue"),
    (r"\bbd\b", "boulevard"),
    (r"\b(?:r|ruee)\b", "rue"),
    (r"\b(?:all|alle)\b", "allee"),
    (r"\bimp\b", "impasse"),
    (r"\bch\b", "chemin"),
    (r"\brte\b", "route"),
    (r"\bpl\b", "place"),
    (r"\bsq\b", "square"),
    (r"\bfg\b", "faubourg"),
    (r"\bst\b", "saint"),
    (r"\bste\b", "sainte"),
]
PARTICLES = r"\b(?:d|de|du|des|la|le|les|l)\b"


def clean_text(x: Column) -> Column:
    """White space, no-break spaces and NUL become single spaces; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(x, r"[\s \u0000]+", " ")), F.lit(""))


def strip_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, PLAIN)


def fold(x: Column) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(x))


def search_norm(x: Column) -> Column:
    """Folded; all but letters and digits is one space; trimmed."""
    return F.trim(F.regexp_replace(fold(x), r"[^a-z0-9]+", " "))


def street_key(x: Column) -> Column:
    """An address as a key: folded, without country, cedex and the word for number, short forms written out, without particles."""
    out = F.regexp_replace(fold(x), r"[^\x00-\x7f]", "")
    for pattern, by in ((r"\bfrance\b", " "), (r"\bcedex\b\s*\d*", " "), (r"\b(?:n|no|numero)\s+(\d+)\b", "$1"), (r"[^a-z0-9]+", " "), *STREET_WORDS, (PARTICLES, " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def postal_code(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"\b(\d{5})\b", 1), F.lit(""))


def city_after_postal(x: Column) -> Column:
    """What follows the postal code of an address, up to a comma or bracket, without the country."""
    town = F.replace(F.regexp_extract(x, r"\b\d{5}\s+([^,\n()]+)", 1), F.lit("France"), F.lit(""))
    return F.nullif(F.trim(town, F.lit(" ,")), F.lit(""))


def department(postal: Column) -> Column:
    """First two digits; three overseas; null if there are fewer."""
    return F.when(postal.rlike("^9[78]"), F.substring(postal, 1, 3)).when(F.char_length(postal) >= 2, F.substring(postal, 1, 2))


def insee_code(dept: Column, commune: Column) -> Column:
    return F.when((F.char_length(commune) >= 5) | dept.isNull(), commune).otherwise(F.concat(dept, F.lpad(commune, 3, "0")))


def parcel_id(dept: Column, commune: Column, prefix: Column, section: Column, plan: Column) -> Column:
    """14 characters: department and commune, prefix (000 if there is none), section, plan number; null without one of the others."""
    return F.upper(F.concat(dept, F.lpad(commune, 3, "0"), F.lpad(F.coalesce(prefix, F.lit("000")), 3, "0"), F.lpad(section, 2, "0"), F.lpad(plan, 4, "0")))


def sale_signature(sale_date: Column, price: Column) -> Column:
    """Date and price in whole euros, by which a known listing counts as unchanged."""
    return F.concat(F.coalesce(F.to_date(sale_date).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.rint(price).cast("bigint").cast("string"), F.lit("")))


TYPE_LABELS = {"apartment": "Appartement", "house": "Maison", "building": "Immeuble", "land": "Terrain", "parking": "Parking", "commercial": "Local commercial"}


def display_title(kind: Column, city: Column, surface: Column, title: Column) -> Column:
    """The cleaned title; else one made of type, surface and city."""
    label = F
    for k, v in TYPE_LABELS.items():
        label = label.when(kind == k, v)
    made = F.concat_ws(" ", label.otherwise("Bien immobilier"), F.when(surface > 0, F.concat(surface.cast("string"), F.lit(" m²"))), F.concat(F.lit("- "), city))
    return F.coalesce(clean_text(title), made)


def allowed_url(url: Column, hosts: list[str]) -> Column:
    """https, and exactly one of the hosts."""
    return F.coalesce((F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.lower(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 256)


def csv_cell(x: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe; quotes are doubled."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    guarded = F.when(s.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


#: Short codes of property types; words in folded text that tell a type, in the order they are looked for.
TYPE_CODES = {"app": "apartment", "mai": "house", "ter": "land", "imb": "building", "loc": "commercial", "com": "commercial", "gar": "parking", "pkg": "parking"}
LAND, WORKED_BUILDING = r"\b(?:terrains?|parcelles?|pres?)\b", r"\b(?:batiments?|hangars?|exploitation|stabulation|locaux?)\b"
FARM = r"\b(?:exploitation\s+agricole|batiments?\s+agricoles?|hangars?|stabulation|salle\s+de\s+traite)\b"
BUILT = r"\b(?:appartement|maison|villa|studio|immeuble|commerce|commercial|local)\b"
TYPE_WORDS = [
    ("apartment", "apartment|appartement|studio"),
    ("house", "house|maison|villa"),
    ("building", "building|batiment|immeuble"),
    ("land", "land|terrain"),
    ("commercial", "commercial|magasin|local|commerce"),
    ("parking", "parking|stationnement"),
    ("mixed", "propriete agricole|propriete|ensemble immobilier|mixed"),
    ("other", "autres|autre|other"),
    ("unknown", "unknown"),
]


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is worked out once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _first(rules: list[tuple[Column | str, Column]], otherwise: Column | str | None = None) -> Column:
    """The value of the first rule that holds."""
    out = F
    for value, test in rules:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def property_type_of(text: Column) -> Column:
    """The type that a listing's words tell: short codes; buildings with land, farm buildings, bare land; then the first word. `other` without one, and for null."""

    def kind_of(t: Column) -> Column:
        codes = [(kind, t == code) for code, kind in TYPE_CODES.items()]
        land = t.rlike(LAND)
        estates = [("mixed", t.rlike(WORKED_BUILDING) & land), ("commercial", t.rlike(FARM)), ("land", land & ~t.rlike(BUILT))]
        return _first([*codes, *estates, *((kind, t.rlike(words)) for kind, words in TYPE_WORDS)], "other")

    return let(F.coalesce(fold(clean_text(text)), F.lit("")), kind_of)


#: What folded text says of who is in a dwelling, and of a sale's state.
RENTED, LET, LEASE = r"\b(?:locataire|rented|leased|tenant|loyer)\b", r"\bloue(?:e|s|es)?\b", r"\bbail\b"
NO_LEASE = r"\b(?:sans|absence\s+de|aucun(?:e)?|pas\s+de|non\s+soumis\s+a\s+un)\s+(?:bail|contrat\s+de\s+location)\b"
NOT_SAID = r"\b(?:unknown|inconnu(?:e|s|es)?|a\s+(?:verifier|confirmer|determiner)|non\s+(?:renseigne|precise)(?:e|s|es)?|indetermine(?:e|s|es)?)\b"
VACANT, USED = "libre|vacant|inoccup|free|vide|disponible", r"\b(?:occup|exploit|habit|utilis)\w*\b"
ADJUDICATED, STATES = r"\badjuge(?:e|es|s)?\b|\badjudicated\b", ["upcoming", "past", "adjudicated"]


def occupancy_of(text: Column) -> Column:
    """squatted, owner_occupied, rented, unknown (said to be so), vacant, occupied; null where nothing is said. A text that denies a lease tells occupied or, without a word of use, unknown."""

    def kind_of(t: Column) -> Column:
        denied = t.rlike(NO_LEASE)
        rented = t.rlike(RENTED) | t.rlike(LET) | (t.rlike(LEASE) & ~denied)
        return _first([("squatted", t.contains("squat")), ("owner_occupied", t.rlike("proprietaire|owner")), ("rented", rented), ("unknown", t.rlike(NOT_SAID)), ("vacant", t.rlike(VACANT)), ("occupied", denied & t.rlike(USED)), ("unknown", denied), ("occupied", t.contains("occup"))])

    return let(fold(clean_text(text)), kind_of)


def sale_state_of(text: Column, sale_date: Column, now: Column) -> Column:
    """adjudicated, past or upcoming, by what is said, else by the date; unknown without either."""
    t = F.coalesce(fold(clean_text(text)), F.lit(""))
    said = [("adjudicated", t.rlike(ADJUDICATED)), ("past", t.contains("passe")), ("upcoming", t.rlike("venir|upcoming")), (t, t.isin(STATES))]
    return _first([*said, ("past", sale_date < now), ("upcoming", sale_date >= now)], "unknown")


def excerpt(text: Column, needle: str, around: int = 30) -> Column:
    """What lies within `around` characters of the first place of needle; null if it is not there."""
    at = F.locate(needle, text)
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(needle) + around))


#: Types of documents and what folded labels and addresses of them hold, in the order they are looked for.
DOCUMENT_TYPES = [
    ("diagnostics_techniques", r"diagnostic|dpe|erp|amiante|plomb|termites|crep|\bdiag(?:nostics?)?\b"),
    ("cahier_conditions_vente", r"cahier|ccv|dossier[ _]de[ _]consultation|dossier[ _]de[ _]presentation|reglement de consultation"),
    ("conditions_vente", r"conditions[ _]de[ _]vente"),
    ("pv_notaire", r"notaire|notarie"),
    ("pv_huissier", r"pv descriptif|pv description|pvd|descriptif|proces-verbal de constat|commissaire de justice|huissier|\bproces[-\s]+verbal\b.*\b(?:description|descriptif|constat)\b|\bpv\b"),
    ("proces_verbal", r"\bproces[-\s]+verbal\b"),
    ("annonce_vente", r"avis|simplifie|affiche|insertion|annonce|placard|publicite"),
    ("bail", r"bail|location"),
    ("procedure_saisie", r"hypothecaire|commandement"),
    ("cadastre", r"cadastre|plan|parcelle"),
    ("pdf", r"\.pdf"),
]


def document_type(label: Column, url: Column | None = None) -> Column:
    """The type of a document by its label and address: the first that fits; `other` without one, and for nulls."""
    t = fold(F.concat_ws(" ", label, *([] if url is None else [url])))
    return let(t, lambda t: _first([(kind, t.rlike(words)) for kind, words in DOCUMENT_TYPES], "other"))


def geojson_point(lng: Column, lat: Column, properties: Column) -> Column:
    point = F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")))
