"""Facts of a sale's documents: candidates of every page, with their evidence, and the choice among those that compete.

Pages are read in one pass: each gives at most one candidate a fact. A fact's candidates compete by the rank of their document (which differs from fact to fact), then by what the fact itself ranks by; the winner keeps its source, and the values that lost are kept beside it with the number of pages that support them.
"""

from __future__ import annotations

import re
from datetime import datetime
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import CLOCK, MONTHS, NUMBERED, WORDED
from ..functions.text import ACCENTED, LEASE, LET, NO_LEASE, PLAIN, RENTED, USED
from .risks import normal_document_type

c = F.col

#: What documents are worth for each fact; any other one is worth OTHER.
PRICE_RANK = {"cahier_conditions_vente": 100, "conditions_vente": 95, "annonce_vente": 70, "pv_huissier": 55, "pv_notaire": 55, "proces_verbal": 45, "pdf": 40}
SURFACE_RANK = {"diagnostics_techniques": 80, "pv_huissier": 75, "pv_notaire": 70, "annonce_vente": 60, "cahier_conditions_vente": 55, "conditions_vente": 50, "pdf": 40}
ENERGY_RANK = {"diagnostics_techniques": 3, "pv_huissier": 2, "pv_notaire": 2, "pdf": 1}
OTHER = {"starting_price": 30, "surface": 30, "energy": 0}
#: How a starting price is written, in the order it is looked for; what of the text around it is about a deposit, and what is not, all the same.
PRICES = [
    r"\bmise\s+[àa]\s+prix\s*[:\-]\s*([0-9][0-9\s. ]*(?:,[0-9]{1,2})?)\s*(?:€|euros?)(?=\s|[).,;:]|$)",
    r"\bmise\s+[àa]\s+prix\b.{0,260}?(?:ci[\s-]*apr[eè]s\s+indiqu[eé]e?s?|adjudication\s+aura\s+lieu|en\s+un\s+seul\s+lot).{0,140}?([0-9][0-9\s. ]*(?:,[0-9]{1,2})?)\s*(?:€|euros?)(?=\s|[).,;:]|$)",
    r"\badjudication\b.{0,180}?\bsur\s+la\s+mise\s+[àa]\s+prix\b.{0,180}?([0-9][0-9\s. ]*(?:,[0-9]{1,2})?)\s*(?:€|euros?)(?=\s|[).,;:]|$)",
]
DEPOSIT = r"\b(?:caution|cheque\s+de\s+banque|minimum\s+de)\b|\b10\s*%\s+du\s+montant\s+de\s+la\s+mise\s+a\s+prix\b"
NO_DEPOSIT = r"\b(?:adjudication\s+aura\s+lieu|en\s+un\s+seul\s+lot|ci[\s-]*apres\s+indique)\b"
#: What texts have in which any of the patterns of prices, or of surfaces, may be found.
OF_PRICE, OF_SURFACE = "prix", r"surface|superficie|carrez|environ|total|habitable"
#: A number of square metres, and how built surfaces are written, in the order they are looked for.
M2 = r"([0-9]+(?:[\s.][0-9]{3})*(?:[,.][0-9]+)?|[0-9]+(?:[,.][0-9]+)?)"
SURFACES = [
    rf"(?:surface|superficie)\s+de\s+r[ée]f[ée]rence\s*:?\s*(?:de\s+)?{M2}\s*m\s*(?:2|²)",
    rf"surface\s+(?:privative\s+)?(?:loi\s+)?carrez(?:\s+totale)?\s*:?\s*(?:de\s+)?(?:environ\s+)?{M2}\s*m\s*(?:2|²)",
    rf"(?:surface\s*(?:habitable|privative|utile|totale|carrez|au\s+sol\s+totale)?|superficie(?:\s+(?:carrez|habitable|privative))?)\s*:?\s*(?:de\s+)?(?:environ\s+)?{M2}\s*m\s*(?:2|²)",
    rf"(?:surface\s+(?:habitable|privative|utile|totale|carrez)?|superficie(?:\s+carrez)?).{{0,80}}?\b(?:soit|est\s+de|de)\s+{M2}\s*m\s*(?:2|²)",
    rf"(?:mesurage\s+(?:loi\s+)?carrez|loi\s+carrez|surface\s+(?:privative\s+)?(?:loi\s+)?carrez|superficie\s+(?:privative\s+)?(?:loi\s+)?carrez)\s*:?\s*(?:de\s+)?(?:environ\s+)?{M2}\s*m\s*(?:2|²)",
    rf"\b(?:d['’]\s*)?environ\s+{M2}\s*m\s*(?:2|²)\b",
    rf"{M2}\s*m\s*(?:2|²|\*)\s+(?:habitables?|de\s+surface|loi\s+carrez)",
    rf"\btotal\s*:?\s*{M2}\s*m\s*(?:2|²|\*)",
    rf"superficie\s*approximative\s*habitable\s*totale\s*:?\s*{M2}\s*m\s*(?:2|²|\?)",
]
#: Surfaces that are sure to be the dwelling's; what shows that one is of something else; what moves the rank of a surface.
SURE_SURFACE, REFERENCE = r"\b(?:habitable|carrez|privative|surface\s+de\s+r[ée]f[ée]rence)\b", r"\b(?:surface|superficie)\s+de\s+r[ée]f[ée]rence\b"
ENERGY_CONTEXT = r"\bkwh\b|kg\s*co2|\bges\b|performance\s+[ée]nerg[ée]tique"
PART_OF_BUILDING = r"\b(?:mur|paroi|plafond|toiture|fa[çc]ade|isolant|isolation|plancher|baie|fen[eê]tre|porte|garage|cave|parking)\b"
MEASURED, REFERRED, OF_LAND = r"carrez|surface\s*habitable|superficie\s+privative", r"surface\s+de\s+r[ée]f[ée]rence", r"terrain|parcelle|contenance cadastrale|are|centiare"
PARTLY = r"\b(?:mesurage|calcul\s+de\s+superficie).{0,80}\b(?:incomplet|partiel|pas\s+pu|n(?:'|’)ont\s+pu)\b|\bn(?:'|’)ont\s+pu\s+[eê]tre\s+r[ée]alis[ée]s?\s+dans\s+leur\s+int[ée]gralit[ée]\b|\bpi[eè]ces?\s+(?:non\s+)?(?:mesur[ée]es?|accessibles?)\b"
#: What tells of energy at all, and how classes, consumption and emissions are written, in the order they are looked for.
OF_ENERGY = r"\b(?:dpe|diagnostic\s+de\s+performance\s+energetique|diagnostic\s+de\s+performance\s+[ée]nerg[ée]tique|ges|gaz\s+a\s+effet\s+de\s+serre|gaz\s+à\s+effet\s+de\s+serre|kwh|co2)\b"
CLASSES = [
    r"\b(?:dpe|classe\s+energie|classe\s+energetique|etiquette\s+energie|performance\s+energetique)\s*[:=-]?\s*(?:classe\s*)?([A-G])\b",
    r"\bdiagnostic\s+de\s+performance\s+[ée]nerg[ée]tique.{0,80}?\b(?:classe\s*)?([A-G])\b",
]
GAS_CLASSES = [r"\b(?:ges|emissions?\s+de\s+gaz\s+a\s+effet\s+de\s+serre|emissions?\s+de\s+gaz\s+à\s+effet\s+de\s+serre|gaz\s+a\s+effet\s+de\s+serre|gaz\s+à\s+effet\s+de\s+serre)\s*[:=-]?\s*(?:classe\s*)?([A-G])\b"]
CONSUMPTIONS = [
    r"\b(?:consommation\s+(?:energetique|énergétique)|conso(?:mmation)?\s*(?:5\s+usages)?|energie\s+primaire).{0,80}?([0-9]+(?:[,.][0-9]+)?)\s*kwh(?:ep)?\s*/?\s*m(?:2|²)\s*/?\s*(?:an|a|annee|année)?\b",
    r"\b([0-9]+(?:[,.][0-9]+)?)\s*kwh(?:ep)?\s*/?\s*m(?:2|²)\s*/?\s*(?:an|a|annee|année)?\b",
]
EMISSIONS = [
    r"\b(?:emissions?\s+(?:de\s+)?(?:gaz\s+a\s+effet\s+de\s+serre|gaz\s+à\s+effet\s+de\s+serre|ges)|ges).{0,100}?([0-9]+(?:[,.][0-9]+)?)\s*kg\s*(?:co2|co₂)\s*/?\s*m(?:2|²)\s*/?\s*(?:an|a|annee|année)?\b",
    r"\b([0-9]+(?:[,.][0-9]+)?)\s*kg\s*(?:co2|co₂)\s*/?\s*m(?:2|²)\s*/?\s*(?:an|a|annee|année)?\b",
]
#: Facts that documents of some kinds do not tell.
NO_PRICE_IN = ["diagnostics_techniques", "bail", "cadastre"]

#: What documents are worth for areas of land and days of sale.
LAND_RANK = {"pv_huissier": 80, "pv_notaire": 75, "cahier_conditions_vente": 70, "conditions_vente": 65, "diagnostics_techniques": 60, "annonce_vente": 45, "pdf": 40}
DATE_RANK = {"annonce_vente": 90, "cahier_conditions_vente": 85, "conditions_vente": 80, "pv_huissier": 65, "pv_notaire": 65, "proces_verbal": 60, "pdf": 40, "diagnostics_techniques": 10}
OTHER |= {"land": 30, "sale_date": 30}
RANKS = {"starting_price": PRICE_RANK, "surface": SURFACE_RANK, "energy": ENERGY_RANK, "land": LAND_RANK, "sale_date": DATE_RANK}
#: How areas of land are written, in square metres and in hectares, ares and centiares; what must stand near them, and what shows that they are of a building.
LANDS = [
    rf"\b(?:surface|superficie)\s+(?:du\s+|de\s+la\s+)?(?:terrain|parcelle|jardin|cadastrale)\s*:?\s*(?:de\s+)?{M2}\s*m\s*(?:2|²)",
    rf"\b(?:terrain|parcelles?|jardin)\b.{{0,140}}?\b(?:surface|superficie|contenance)\b.{{0,60}}?{M2}\s*m\s*(?:2|²)",
    rf"\bcontenance(?:\s+(?:totale|cadastrale))?\b.{{0,100}}?{M2}\s*m\s*(?:2|²)",
    rf"\b{M2}\s*m\s*(?:2|²).{{0,80}}\b(?:de\s+terrain|terrain|parcelles?|jardin)\b",
]
LAND_UNITS = [
    r"\b(?P<ha>\d{1,5})\s*(?:ha|hectares?)\s*(?:(?P<a>\d{1,5})\s*(?:a|ares?))?\s*(?:(?P<ca>\d{1,2})\s*(?:ca|centiares?))?\b",
    r"\b(?P<a>\d{1,5})\s*(?:a|ares?)\s*(?:(?P<ca>\d{1,2})\s*(?:ca|centiares?))?\b",
]
NEAR_LAND = r"\b(?:terrain|parcelles?|cadastr(?:e|ee|al|ale)|contenance|jardin)\b"
BUILT, LAND_WORDS = r"\b(?:habitable|carrez|privative|utile|b[âa]tie|surface\s+de\s+r[ée]f[ée]rence)\b", r"\b(?:terrain|parcelle|jardin|cadastrale)\b"
#: Phrases that may tell the day of a sale, what takes them out, and what moves the rank of a day; what tells of visits.
SALE_DAYS = [
    r"\b(?:audience\s+d['’]\s*adjudication|audience\s+des?\s+cri[eé]es?|date\s+d['’]\s*audience|date\s+de\s+(?:la\s+)?vente|vente\s+aux\s+ench[eè]res(?:\s+publiques?)?|adjudication)\b[^.;\n]{0,180}",
    r"\bvente\s+(?:fix[eé]e?\s*)?(?:au|aura\s+lieu\s+le|le|:)\s*[^.;\n]{0,160}",
    r"\bsera\s+(?:proc[eé]d[eé]\s+)?vendu[^.;\n]{0,160}",
]
A_DAY = rf"\b\d{{1,2}}\s+(?:{'|'.join(MONTHS)})\s+\d{{4}}\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b"
A_WHOLE_DAY = f"{WORDED}|{NUMBERED}"
VISIT, HEARING, NO_SALE_DAY = r"\b(?:visites?|rendez[-\s]?vous)\b", r"\b(?:audience|date\s+d['’ ]audience|date\s+de\s+la\s+vente|vente\s+aux\s+encheres)\b", r"\b(?:prix\s+d['’ ]adjudication|frais|mise\s+a\s+prix)\b"
NAMED_DAY, A_SALE, OTHER_DAY = r"\b(?:audience\s+d['’ ]adjudication|date\s+de\s+la\s+vente|date\s+d['’ ]audience)\b", r"\b(?:vente\s+aux\s+encheres|adjudication)\b", r"\b(?:visites?|rendez[-\s]?vous|diagnostic|dpe|ges)\b"
VISIT_DAY = r"\b(?:visite\s+(?:sur\s+place|libre|groupee|obligatoire|prevue)|date\s+des\s+visites?|rendez[-\s]?vous|(?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche)\b|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b)"
#: What folded text says of who is in a dwelling: no title, use, that it ended, free.
NO_TITLE = r"sans\s+droit\s+ni\s+titre|squatt?\w*"
IN_USE = r"\b(?:actuellement\s+)?occupe(?:e?s?|s)?\b|\bsuivant\s+un\s+bail\b|\bbail\s+(?:meuble|d['’]habitation|en\s+cours)\b|\blocataire\b|\bloyer\s+mensuel\b"
ENDED, FREE = r"\blibre\s+de\s+toute\s+occupation\b|\ba\s+quitte\s+les\s+lieux\b|\bdepart\s+effectif\b|\bconstate(?:e?s?|s)?\s+libre\b", r"\b(?:libre|inoccupe(?:e?s?|s)?)\b"
CROWDED = r"\bencombrement\s+trop\s+important\b"

CANDIDATE = "struct<fact:string,number:double,said:string,energy:struct<dpe:string,ges:string,consumption:double,emissions:double>,more:double,second:double,evidence:string>"
TO_PLAIN = [(a, b) for a, b in zip(ACCENTED, PLAIN, strict=True) if a == a.lower()]


@cache
def _compiled(pattern: str) -> re.Pattern:
    """For texts in lower case, which are searched much faster than in any case."""
    return re.compile(pattern.replace("[A-G]", "[a-g]"), re.S)


def _search(pattern: str, low: str) -> re.Match | None:
    return _compiled(pattern).search(low)


def _lower(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x.lower() if len(x.lower()) == 1 else x for x in text)


def _fold(text: str) -> str:
    low = _lower(text)
    if not low.isascii():
        for accented, plain in TO_PLAIN:
            low = low.replace(accented, plain)
    return low


def _clean(text: str) -> str:
    return " ".join(text.replace("\0", " ").split())


def _near(text: str, m: re.Match, ahead: int, behind: int) -> str:
    return text[max(0, m.start() - ahead) : m.end() + behind]


def _number(written: str) -> float | None:
    """A number as it is written: blanks and dots part thousands, a comma or a lone dot the rest."""
    packed = re.sub(r"\s", "", written)
    bare = packed.replace(".", "")
    try:
        return float(bare.replace(",", ".") if "," in packed else bare if re.fullmatch(r"\d{1,3}(?:\.\d{3})+", packed) else packed)
    except ValueError:
        return None


def _first(text: str, patterns: list[str], judge):
    """What judge first makes of a match, patterns in their order; None if it makes nothing of any."""
    return next((one for p in patterns for m in _compiled(p).finditer(text) if (one := judge(m)) is not None), None)


def _told(fact: str, evidence: str, number: float | None = None, said: str | None = None, energy: dict | None = None, more: float = 0.0, second: float = 0.0) -> dict:
    return {"fact": fact, "number": number, "said": said, "energy": energy, "more": more, "second": second, "evidence": evidence}


def price_told(text: str, low: str) -> dict | None:
    def judge(m: re.Match) -> dict | None:
        price, evidence = _number(m[1]), _clean(_near(text, m, 180, 220))
        plain = _fold(evidence)
        deposit = _search(DEPOSIT, plain) and not _search(NO_DEPOSIT, plain)
        return _told("starting_price", evidence, price) if price and not deposit else None

    return _first(low, PRICES, judge) if OF_PRICE in low else None


def surface_told(text: str, low: str) -> dict | None:
    def judge(m: re.Match) -> dict | None:
        m2, near = _number(m[1]), _near(low, m, 160, 60)
        other = not _search(REFERENCE, near) and (_search(ENERGY_CONTEXT, near) or _search(PART_OF_BUILDING, low[max(0, m.start() - 120) : m.start()]))
        if not m2 or (other and not _search(SURE_SURFACE, m[0])):
            return None
        said = _clean(_near(text, m, 120, 160))
        words = _lower(said)
        more = 15 if _search(MEASURED, words) else 10 if _search(REFERRED, words) else 0
        return _told("surface", said, m2, more=more - (25.0 if _search(OF_LAND, words) else 0.0))

    return _first(low, SURFACES, judge) if any(w in low for w in OF_SURFACE.split("|")) and _search(r"m\s*[2²*?]", low) else None


def _land_rank(text: str, m: re.Match) -> int:
    ahead, behind = _fold(_clean(text[max(0, m.start() - 120) : m.start()])), _fold(_clean(text[m.end() : m.end() + 100]))
    both = f"{ahead} {behind}"
    here = r"\b(?:parcelle|terrain|jardin)\b"
    tests = [(60, here, ahead[-90:]), (40, here, behind[:70]), (45, r"\b(?:contenance|total|totale)\b", both), (20, r"\bjouissance\s+(?:exclusive|privative)\b", ahead), (-15, r"\b(?:section|cadastre|cadastree|tableau)\b", both)]
    return sum(points for points, pattern, where in tests if _search(pattern, where))


def land_told(text: str, low: str) -> dict | None:
    """Land in square metres; else in hectares, ares and centiares, of several the one that stands nearest to words of land, if it stands near enough."""
    of_land = lambda m: _search(NEAR_LAND, _fold(_clean(_near(text, m, 180, 180))))

    def judge(m: re.Match) -> dict | None:
        ahead, m2 = low[max(0, m.start(1) - 100) : m.start(1)], _number(m[1])
        built = _search(BUILT, ahead) and not _search(LAND_WORDS, ahead[-70:])
        return _told("land", _clean(_near(text, m, 120, 160)), m2) if m2 and of_land(m) and not built else None

    ground = any(w in low for w in ("terrain", "parcelle", "jardin"))
    found = _first(low, LANDS if ground else LANDS[:1] + LANDS[2:3], judge) if _search(r"m\s*[2²]", low) else None
    if found:
        return found
    units = []
    for pattern in LAND_UNITS if _search(r"[0-9]\s*(?:ha|hect|a)", low) else []:
        for m in _compiled(pattern).finditer(low):
            of = m.groupdict()
            m2 = int(of.get("ha") or 0) * 10000 + int(of.get("a") or 0) * 100 + int(of.get("ca") or 0)
            if m2 and of_land(m):
                units.append((_land_rank(text, m), _told("land", _clean(_near(text, m, 120, 160)), float(m2))))
    rank, best = max(units, key=lambda x: x[0], default=(0, None))
    return best if len(units) == 1 or rank >= 40 else None


def energy_told(text: str, low: str, plain: str) -> dict | None:
    if not any(w in low for w in ("dpe", "diagnostic", "ges", "gaz", "kwh", "co2")) or not _search(OF_ENERGY, low):
        return None
    found = {n: _first(where, patterns, lambda m: m) for n, where, patterns in (("dpe", plain, CLASSES), ("ges", plain, GAS_CLASSES), ("consumption", low, CONSUMPTIONS if "kwh" in low else []), ("emissions", low, EMISSIONS if "kg" in low else []))}
    there = [m for m in found.values() if m]
    if not there:
        return None
    evidence = _clean(text[max(0, min(m.start() for m in there) - 120) : max(m.end() for m in there) + 180])
    value = {n: m and (m[1].upper() if n in ("dpe", "ges") else float(m[1].replace(",", "."))) for n, m in found.items()}
    return _told("energy", evidence, energy=value, second=float(len(there)))


def _chunks(text: str) -> list[str]:
    """Lines, and sentences of those that are long or alone."""
    sentences = lambda x: [s for s in map(_clean, re.split(r"(?<=[.;])\s+", x)) if s]
    lines = [x for x in map(_clean, re.split(r"[\n\r]+", text)) if x]
    if len(lines) <= 1:
        lines = sentences(text)
    return [part for x in lines for part in (sentences(x) if len(x) > 500 else [x])]


def _moment(phrase: str) -> str | None:
    """The first day of a phrase, its month in words or numbers (day first), and its time, midnight without one; None if there is no such day."""
    low = _fold(phrase)
    named, numbered = _search(WORDED, low), _search(NUMBERED, low)
    if not named and not numbered:
        return None
    day, month, year = (int(named[1]), MONTHS.index(named[2]) + 1, int(named[3])) if named else (int(numbered[i]) for i in (1, 2, 3))
    at = _search(CLOCK, _compiled(A_WHOLE_DAY).sub(" ", low))
    try:
        return datetime(year, month, day, int(at[1]) if at else 0, int(at[2] or 0) if at else 0).isoformat()
    except ValueError:
        return None


def sale_day_told(chunks: list[str]) -> dict | None:
    """Of the phrases that tell a day of sale the one whose words name it best, the first of equal ones."""
    best = None
    for chunk in chunks:
        low = _fold(chunk)
        if not _search(A_DAY, low) or (_search(VISIT, low) and not _search(HEARING, low)):
            continue
        for pattern in SALE_DAYS:
            for m in _compiled(pattern).finditer(_lower(chunk)):
                phrase = _clean(chunk[m.start() : m.end()])
                said = _fold(phrase)
                at = _moment(phrase) if _search(A_DAY, said) and not _search(NO_SALE_DAY, said) else None
                score = (25.0 if _search(NAMED_DAY, said) else 15.0 if _search(A_SALE, said) else 0.0) - (20.0 if _search(OTHER_DAY, said) else 0.0)
                if at and (best is None or score > best["second"]):
                    best = _told("sale_date", phrase, said=at, second=score)
    return best


def visits_told(chunks: list[str]) -> dict | None:
    """All visits of a page, as they are written."""
    visits = []
    for chunk in chunks:
        low = _fold(chunk)
        if "visite virtuelle" not in low and _search(VISIT, low) and _search(VISIT_DAY, low):
            visit = re.sub(r"^(?:conditions?\s+de\s+)?visites?\s*:\s*", "", chunk, flags=re.I).strip()
            visits.append(re.sub(r"^date\s+des\s+visites?\s*:\s*", "", visit, flags=re.I).strip().rstrip(" .;"))
    visits = list(dict.fromkeys(v for v in visits if v))
    return _told("visit_dates", visits[0], said=" | ".join(visits), more=float(len(visits))) if visits else None


#: Which occupancy goes before another where pages differ, as one text of them all would be read.
OCCUPANCIES = {"squatted": 4.0, "rented": 3.0, "occupied": 2.0, "vacant": 1.0, "unknown": 0.0}


def occupancy_told(text: str, low: str) -> dict | None:
    """low: folded. A word that each pattern needs is looked for first."""
    has = lambda *words: any(w in low for w in words)
    denied = _search(NO_LEASE, low) if has("bail", "contrat") else None
    no_lease = denied and ("occupied" if _search(USED, low) else "unknown")
    rented = (has("locataire", "rented", "leased", "tenant", "loyer") and _search(RENTED, low)) or (has("loue") and _search(LET, low)) or (not denied and has("bail") and _search(LEASE, low)) or None
    title = _search(NO_TITLE, low) if has("sans", "squat") else None
    use = _search(IN_USE, low) if has("occupe", "bail", "locataire", "loyer") else None
    free = _search(FREE, low) if has("libre", "inoccupe") else None
    if title:
        kind, at = "squatted", title
    elif use and not _search(ENDED, low):
        kind, at = no_lease or ("rented" if rented else "occupied"), use
    elif free:
        kind, at = "vacant", free
    elif denied:
        kind, at = no_lease, denied
    else:
        used = _search(r"\boccupe(?:e?s?|s)?\b", low)
        kind, at = ("occupied", used) if used else ("rented", rented) if rented else (None, None)
    return _told("occupancy", _clean(_near(text, at, 120, 160)), said=kind, more=OCCUPANCIES[kind]) if kind else None


@lru_cache(1 << 13)
def read_page(text: str) -> list[dict]:
    """What a page tells, at most once a fact; and, as `partly`, that measures of its document are not whole. Words that each reading needs are looked for first. Pages that recur are read once a worker, while they are few."""
    low, plain = _lower(text), _fold(text)
    has = lambda *words: any(w in plain for w in words)
    out = [price_told(text, low), surface_told(text, low), energy_told(text, low, plain)]
    out += [land_told(text, low)] if has("terrain", "parcelle", "cadastr", "contenance", "jardin") else []
    days, visits = has("audience", "vente", "adjudication", "vendu") and _search(A_DAY, _clean(plain)), has("visite", "rendez")
    chunks = _chunks(text) if days or visits else []
    out += [sale_day_told(chunks)] if days else []
    out += [visits_told(chunks)] if visits else []
    out += [occupancy_told(text, plain)] if has("occup", "bail", "locat", "loue", "loyer", "libre", "squat", "titre", "rented", "leased", "tenant") else []
    crowded = out[1] and "carrez" in _fold(out[1]["evidence"]) and len(_compiled(CROWDED).findall(_fold(f"{out[1]['evidence']} {text}"))) >= 2
    if crowded or (has("mesur", "superficie", "integralit", "piece") and _search(PARTLY, plain)):
        out.append(_told("partly", ""))
    return [x for x in out if x]


def pages_read(text: Column) -> Column:
    """An array of CANDIDATE for each text; null for null."""

    @F.arrow_udf(f"array<{CANDIDATE}>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else read_page(t) for t in texts.to_pylist()], CANDIDATES)

    return read(text)


ENERGY_TYPE = pa.struct([("dpe", pa.string()), ("ges", pa.string()), ("consumption", pa.float64()), ("emissions", pa.float64())])
CANDIDATES = pa.list_(pa.struct([("fact", pa.string()), ("number", pa.float64()), ("said", pa.string()), ("energy", ENERGY_TYPE), ("more", pa.float64()), ("second", pa.float64()), ("evidence", pa.string())]))


def _worth(kind: Column, fact: Column) -> Column:
    """What a document is worth for a fact; visits and occupancy are told by any."""
    table = lambda rank: F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    out = F
    for name, rank in RANKS.items():
        out = out.when(fact == name, F.coalesce(F.try_element_at(table(rank), kind), F.lit(OTHER[name])))
    return out.otherwise(0).cast("double")


def page_candidates(pages: DataFrame) -> DataFrame:
    """sale_id, document_no, document_url, document_label, document_type, page_number, page_confidence, text in; a row out for each candidate of a page: price, surface, land, energy, day of sale, visits, occupancy. A page that says that measures are partial lowers the surfaces of all its document."""
    kind = normal_document_type(c("document_type"), F.lit("pdf"))
    source = ["sale_id", "document_no", "document_url", "document_label", "document_type", "page_number", "page_confidence"]
    told = pages.withColumn("document_type", kind).select(*source, F.inline(pages_read(c("text"))))
    told = told.where(~((c("fact") == "starting_price") & c("document_type").isin(*NO_PRICE_IN))).repartition("sale_id")  # once, for all that is grouped by sale after Python
    document = Window.partitionBy("sale_id", "document_no", "document_url")
    told = told.withColumn("_partly", F.bool_or(c("fact") == "partly").over(document)).where("fact <> 'partly'")
    value = F.when(c("number").isNotNull(), F.format_string("%.2f", "number")).when(c("fact") == "energy", F.to_json("energy")).otherwise(c("said"))
    first = _worth(c("document_type"), c("fact")) + c("more") - F.when((c("fact") == "surface") & c("_partly"), 40).otherwise(0)
    second = F.when(c("fact") == "starting_price", F.coalesce("page_confidence", F.lit(0.0))).otherwise(c("second"))
    third = F.when(c("fact") == "starting_price", F.coalesce("page_number", F.lit(0))).when(c("fact") == "sale_date", c("page_number").isNotNull().cast("int")).otherwise(0)
    return told.select(*source, "fact", value.alias("value"), first.alias("first"), second.alias("second"), third.cast("double").alias("third"), "evidence")


def document_facts(pages: DataFrame) -> DataFrame:
    """A row for each fact of a sale that its pages tell: fact, value (a price, surface or land with two decimals; classes and figures of energy in JSON; a day and time of sale; visits as they are written, parted by bars; occupancy), support (pages that say so), the source (document and page), evidence, and lost: the other values, each with its support, the best supported first.

    Of candidates of one rank the earlier document, there the earlier page, wins. Pages without text tell nothing.
    """
    ranks = ["first", "second", "third"]
    source = ["document_url", "document_label", "document_type", "page_number", "page_confidence", "evidence"]
    best = F.struct(*ranks, (-c("document_no")).alias("no"), (-F.coalesce("page_number", F.lit(0))).alias("page"), *source)
    values = page_candidates(pages).groupBy("sale_id", "fact", "value").agg(F.count("*").alias("support"), F.max(best).alias("best"))
    one = values.groupBy("sale_id", "fact").agg(F.max(F.struct("best", "value", "support")).alias("w"), F.sort_array(F.collect_list(F.struct((-c("support")).alias("less"), "value"))).alias("all"))
    lost = F.transform(F.filter("all", lambda x: x["value"] != c("w.value")), lambda x: F.struct(x["value"].alias("value"), (-x["less"]).alias("support")))
    return one.select("sale_id", "fact", "w.value", "w.support", *(c(f"w.best.{s}").alias(s) for s in source), lost.alias("lost"))


def reconciled_prices(facts: DataFrame, sales: DataFrame) -> DataFrame:
    """sale_id, price, status of sales whose documents tell a starting price: extracted (there was none), corroborated, resolved (one below 1,000 or none gives way to a documented one of 3,000 or more and twenty times as much) or conflict_unresolved (the sale's own stays)."""
    told = facts.where("fact = 'starting_price'").select("sale_id", c("value").cast("double").alias("documented"))
    both = sales.select("sale_id", c("starting_price_eur").cast("double").alias("own")).join(told, "sale_id")
    gives_way = (c("own") <= 0) | ((c("own") < 1000) & (c("documented") >= 3000) & (c("documented") >= 20 * c("own")))
    status = F.when(c("own").isNull(), "extracted").when(c("own") == c("documented"), "corroborated").when(gives_way, "resolved").otherwise("conflict_unresolved")
    return both.select("sale_id", F.when(status == "conflict_unresolved", c("own")).otherwise(c("documented")).alias("price"), status.alias("status"))
