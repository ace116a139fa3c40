"""Risks that texts of a sale tell of: each occurrence with its place, what is around it, severity and confidence.

What a risk's word means depends on what stands around it: a negation before it, a clause that holds for any sale, an annexed list of diagnostics. Each risk is a row of a table; the table becomes one expression over a text's occurrences, so that a text is read where it lies and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.occurrences import ANY_CASE, after, around, before, occurrences, quick
from ..functions.text import clean_text, let

c = F.col

#: Other names of types of documents; those that describe the property itself, and those of general conditions.
DOCUMENT_ALIASES = {
    "pv_descriptif": "pv_huissier",
    "pvd": "pv_huissier",
    "pv": "proces_verbal",
    "constat": "pv_huissier",
    "diagnostics": "diagnostics_techniques",
    "diagnostic": "diagnostics_techniques",
    "avis_simplifie": "annonce_vente",
    "avis_simplifié": "annonce_vente",
    "insertion_legale": "annonce_vente",
    "insertion_légale": "annonce_vente",
    "cahier_conditions": "cahier_conditions_vente",
    "ccv": "cahier_conditions_vente",
}
DESCRIBING = ["pv_huissier", "diagnostics_techniques", "annonce_vente"]
CONDITIONS = ["cahier_conditions_vente", "conditions_vente"]

#: How far negations and contexts reach, how many occurrences of a risk a text tells, and how confidence shifts.
NEGATION_REACH, CONTEXT, MOST, SAME = (90, 90), (80, 120), 3, 120
IN_FILE, IN_DESCRIPTION, IN_CONDITIONS, SUREST = 0.04, 0.04, -0.05, 0.96

#: What denies a risk just before it, and what denies that a hazard was found.
DENIED_BEFORE = [r"aucun(?:e|es|s)?\s+\w{0,25}$", r"absence\s+(?:de|d['’])\s*\w{0,25}$", r"pas\s+de\s+\w{0,25}$", r"sans\s+\w{0,25}$", r"n['’]est\s+pas\s+soumis.{0,45}$"]
NOT_FOUND = r"(?:n['’]a\s+pas\s+[ée]t[ée]\s+(?:rep[ée]r[ée]|constat[ée]|d[ée]tect[ée])|non\s+(?:d[ée]tect[ée]|rep[ée]r[ée]|concern[ée])|il\s+n['’]a\s+pas\s+[ée]t[ée]\s+rep[ée]r[ée])"
#: Clauses that stand in any file; suppositions; words of general conditions; lists of annexed diagnostics, and what shows that one found something.
ANY_FILE = r"renseignements\s+ci-dessus.{0,80}servitudes?.{0,80}sans\s+aucune\s+garantie|d[ée]signation\s+de\s+l['’]immeuble.{0,120}servitudes?.{0,120}proc[èe]s\s+verbal|bon\s+ou\s+mauvais\s+[ée]tat\s+de\s+l['’]immeuble|pour\s+les\s+parties\s+communes\s+des\s+immeubles\s+soumis"
SUPPOSED = r"\b(?:si|dans\s+le\s+cas\s+(?:o[uù]|on|\w{1,3}\s+\w?immeuble)|dans\s+l['’]hypoth[eè]se|le\s+cas\s+[ée]ch[ée]ant)\b.{0,120}\b(?:copropri[ée]t[ée]|servitudes?|travaux|lotissement)\b"
GENERAL = r"\b(?:article|chapitre|conditions?\s+pour\s+ench[ée]rir|r[èe]glement\s+int[ée]rieur|l['’]adjudicataire|l['’]acqu[ée]reur|frais\s+de\s+vente|distribution\s+du\s+prix|devra\s+notifier|sera\s+tenu|se\s+reporter|s['’]imposeront)\b"
ANNEXED = r"(?:diagnostics?|annexes?|pi[eè]ces?).{0,140}(?:amiante|plomb|termites).{0,140}(?:diagnostics?|annexes?|constat|rep[ée]rage|exposition|performance\s+[ée]nerg[ée]tique)"
FOUND = r"pr[ée]sence|positif|d[ée]tect[ée]|rep[ée]r[ée]|contient|contiennent|infestation"


@dataclass(frozen=True)
class Risk:
    """told: what in the context tells of the risk, with its severity and the documents in which it counts (None: all), the first that fits. denied: what in the context denies it, also of what is told if `strict`. proven: what makes it hold in a general clause, too (told itself if True)."""

    kind: str
    pattern: str
    confidence: float
    told: tuple[tuple[str, int, tuple[str, ...] | None], ...]
    denied: str | None = None
    strict: bool = False
    hazard: bool = False
    supposable: bool = False
    proven: str | bool = False


#: The risks, in the order they are told.
RISKS = {
    "occupation": Risk(
        "legal",
        r"occup[ée]\s+sans\s+bail|sans\s+droit\s+ni\s+titre|squatt|\bbail\b|\blocataire\b|\bloyer\s+mensuel\b",
        0.82,
        ((r"occup[ée].{0,80}(?:sans\s+bail|sans\s+droit\s+ni\s+titre|par\s+les?\s+propri[ée]taires?|locataire|preneur)|(?:bail|locataire|preneur|loyer).{0,100}(?:en\s+cours|actuel|occup|sign[ée])|squatt", 5, None),),
    ),
    "servitude": Risk(
        "legal",
        r"\bservitudes?\b",
        0.8,
        (
            (r"\bservitudes?\s+(?:de\s+passage|d['’]utilit[ée]\s+publique|conventionnelle|grevant|active|passive)\b", 2, None),
            (r"\b(?:grev[ée]|b[ée]n[ée]ficie|affect[ée]|supporte).{0,90}\bservitudes?\b", 2, None),
            (r"\bservitudes?\s+(?:suivantes?|mentionn[ée]es?|existant|publi[ée]es?)\b", 2, ("cahier_conditions_vente", "conditions_vente")),
        ),
        denied=r"aucune\s+servitude|absence\s+de\s+servitude|servitude\s+non\s+mentionn[ée]e",
        strict=True,
        supposable=True,
        proven=True,
    ),
    "copropriété": Risk(
        "legal",
        r"\bcopropri[ée]t[ée]\b|charges\s+de\s+copropri[ée]t[ée]",
        0.72,
        (
            (r"charges?\s+de\s+copropri[ée]t[ée]\s+(?:impay[ée]es?|dues?|annuelles?)", 1, None),
            (r"(?:soumis|d[ée]pend|fait\s+partie|d[ée]nomm[ée]|ensemble\s+immobilier).{0,100}copropri[ée]t[ée]", 1, None),
            (r"\blot\s+(?:num[ée]ro|n[°o])\b.{0,140}\b(?:tanti[eè]mes|parties\s+communes)\b", 1, None),
            (r"\b(?:tanti[eè]mes|syndic|parties\s+communes)\b", 1, ("annonce_vente", "source_listing", "pv_huissier")),
        ),
        denied=r"pas\s+soumis\s+au\s+r[ée]gime\s+de\s+la\s+copropri[ée]t[ée]|non\s+soumis\s+.*copropri[ée]t[ée]",
        strict=True,
        supposable=True,
        proven=r"(?:soumis|d[ée]pend|d[ée]nomm[ée]|lot\s+(?:num[ée]ro|n[°o])|tanti[eè]mes).{0,90}copropri[ée]t[ée]",
    ),
    "amiante": Risk(
        "physical",
        r"\bamiante\b",
        0.86,
        ((r"(?:pr[ée]sence|positif|d[ée]tect[ée]|rep[ée]r[ée]|contient|contiennent).{0,100}amiante|amiante.{0,100}(?:pr[ée]sent|positif|d[ée]tect[ée]|rep[ée]r[ée]|contient|contiennent)", 3, None),),
        denied=r"absence\s+d['’]amiante|sans\s+amiante|amiante\s*:\s*non",
        strict=True,
        hazard=True,
    ),
    "plomb": Risk(
        "physical",
        r"\bplomb\b",
        0.86,
        ((r"(?:pr[ée]sence|positif|concentration|rev[êe]tements?).{0,100}plomb|plomb.{0,100}(?:pr[ée]sent|positif|d[ée]tect[ée]|sup[ée]rieur|classe\s*[1-4])", 3, None),),
        denied=r"absence\s+de\s+plomb|sans\s+plomb|plomb\s*:\s*non|crep\s*:\s*non|ne\s+constate\s+pas.{0,120}rev[êe]tements?\s+d[ée]grad[ée]s?.{0,80}plomb|pas\s+de\s+rev[êe]tements?\s+d[ée]grad[ée]s?.{0,80}plomb|ne\s*d[ée]passe\s*pas.{0,80}(?:plafond|seuil)|quantit[ée].{0,80}ne\s*d[ée]passe\s*pas.{0,80}(?:plafond|seuil)|inf[ée]rieur(?:e)?\s+(?:au|aux)\s+(?:plafond|seuil)",
        strict=True,
        hazard=True,
    ),
    "termites": Risk(
        "physical",
        r"\btermites?\b",
        0.86,
        ((r"(?:pr[ée]sence|indices?|infestation|attaque).{0,100}termites?|termites?.{0,100}(?:pr[ée]sence|indices?|infestation|attaque)", 3, None),),
        denied=r"absence\s+de\s+termites?|sans\s+termites?|termites?\s*:\s*non|non\s+termite",
        strict=True,
        hazard=True,
    ),
    "DPE": Risk(
        "physical",
        r"\bDPE\b|diagnostic\s+de\s+performance\s+[ée]nerg[ée]tique",
        0.84,
        ((r"\b(?:classe\s*)?[FG]\b|dpe\s*[:=-]?\s*[FG]\b|passoire|d[ée]favorable|consommation\s+(?:excessive|tr[èe]s\s+[ée]lev[ée]e)|[ée]nergivore", 2, None),),
    ),
    "travaux": Risk(
        "physical",
        r"\btravaux\b|r[ée]novation|rafra[iî]chissement|v[ée]tuste|ruine|mauvais\s+[ée]tat|d[ée]grad[ée]s?|d[ée]g[aâ]t\s+des\s+eaux|infiltration",
        0.78,
        (
            (r"gros\s+travaux|travaux\s+(?:lourds|importants|structurels|de\s+remise\s+en\s+[ée]tat|n[ée]cessaires?)|ruine|insalubre|hors\s+d['’]eau|effondr|infiltrations?\s+d['’]eau|d[ée]g[aâ]t\s+des\s+eaux", 5, None),
            (r"(?:pr[ée]voir|prevoir)\s+(?:des\s+)?travaux|travaux\s+(?:[àa]\s+pr[ée]voir|de\s+r[ée]novation)|[àa]\s+r[ée]nover|a\s+renover|r[ée]novation\s+(?:compl[eè]te|importante|[àa]\s+pr[ée]voir)", 4, None),
            (r"mauvais\s+[ée]tat|fortement\s+d[ée]grad[ée]|d[ée]gradations?|v[ée]tuste|rouill[ée]|moisi|fissures?|hors\s+service|arrach[ée]|affaiss[ée]|travaux\s+futurs|remise\s+en\s+[ée]tat", 4, None),
            (r"rafra[iî]chissement|r[ée]novation\s+[àa]\s+pr[ée]voir", 3, None),
        ),
        denied=r"aucun\s+travaux|pas\s+de\s+travaux|sans\s+travaux",
        supposable=True,
        proven=True,
    ),
}


def _has(x: Column, pattern: str) -> Column:
    return x.rlike(ANY_CASE + quick(pattern))


def normal_document_type(document_type: Column, source_kind: Column) -> Column:
    """A document's type under its usual name; a sale's own text is its listing."""
    raw = F.translate(F.lower(F.coalesce(clean_text(document_type), F.lit(""))), "- ", "__")
    names = F.create_map(*(F.lit(x) for pair in DOCUMENT_ALIASES.items() for x in pair))
    own = F.when(source_kind == "sale_text", "source_listing").otherwise("pdf")
    named = lambda raw: F.when((source_kind == "sale_text") & raw.isin("", "none", "null"), "source_listing").otherwise(F.coalesce(F.try_element_at(names, raw), F.when(raw != "", raw), own))
    return let(raw, named)


def _denies(risk: Risk, context: Column) -> Column:
    out = F.lit(False) if risk.denied is None else _has(context, risk.denied)
    return out | _has(context, NOT_FOUND) if risk.hazard else out


def _severity(risk: Risk, context: Column, kind: Column) -> Column:
    """Of what the context tells; null if it tells nothing."""
    out = F
    for pattern, severity, kinds in risk.told:
        out = out.when(_has(context, pattern) & (F.lit(True) if kinds is None else kind.isin(*kinds)), severity)
    told = out.otherwise(F.lit(None).cast("int"))
    return F.when(~_denies(risk, context), told) if risk.strict else told


def _general(risk: Risk, context: Column, kind: Column) -> Column:
    """Whether the context is one of any sale rather than of this one."""
    out = _has(context, ANY_FILE)
    if risk.hazard:
        out = out | (_has(context, ANNEXED) & ~_has(context, FOUND))
    if risk.supposable:
        out = out | _has(context, SUPPOSED)
    proven = _severity(risk, context, F.lit(CONDITIONS[0])).isNotNull() if risk.proven is True else _has(context, risk.proven) if risk.proven else F.lit(False)
    return out | (_has(context, GENERAL) & ~kind.isin(*DESCRIBING, "source_listing") & ~proven)


def _told(label: str, text: Column, kind: Column) -> Column:
    """The occurrences of a risk that count: label, severity, start, end, term, excerpt."""
    risk = RISKS[label]

    def judged(o: Column) -> Column:
        ahead = before(text, o, NEGATION_REACH[0])
        read = F.struct(clean_text(around(text, o, *CONTEXT)).alias("excerpt"), F.concat(ahead, o["term"], after(text, o, NEGATION_REACH[1])).alias("near"), ahead.alias("ahead"))

        def made(x: Column) -> Column:
            denied = F.lit(False) if label == "occupation" else _has(x["ahead"], "|".join(DENIED_BEFORE)) | _denies(risk, x["near"])
            severity = F.when(~denied & ~_general(risk, x["excerpt"], kind), _severity(risk, x["excerpt"], kind))
            return F.struct(F.lit(label).alias("risk_label"), F.lit(risk.kind).alias("risk_type"), severity.alias("severity"), o["start"].alias("start"), o["end"].alias("end"), o["term"].alias("term"), x["excerpt"].alias("excerpt"), F.lit(risk.confidence).alias("confidence"))

        return let(read, made)

    def first_of_each(told: Column) -> Column:
        begins = F.transform(told, lambda x: F.left(x["excerpt"], F.lit(SAME)))
        return let(begins, lambda seen: F.slice(F.filter(told, lambda x, i: F.array_position(seen, F.left(x["excerpt"], F.lit(SAME))) == i + 1), 1, MOST))

    return let(F.filter(F.transform(occurrences(text, risk.pattern), judged), lambda x: x["severity"].isNotNull()), first_of_each)


def risk_occurrences(texts: DataFrame) -> DataFrame:
    """text, source_kind (sale_text, pdf, ...) and document_type in, beside any further columns, which stay (text does not); a row out for each risk that a text tells, three of a kind at most: risk_label, risk_type, severity (1 to 5), start and end in the text, term, excerpt, confidence (0 to 1), score_impact, document_type under its usual name.

    Of occurrences with the same beginning of their context the first stays. Null and empty texts tell nothing.
    """
    kind = normal_document_type(c("document_type"), c("source_kind"))
    others = [x for x in texts.columns if x not in ("text", "document_type")]
    own = texts.select(*others, c("text"), kind.alias("document_type"))
    told = F.concat(*(_told(label, c("text"), c("document_type")) for label in RISKS))
    found = own.select(*others, "document_type", F.inline(told))
    shift = F.when(c("source_kind") == "pdf", IN_FILE).otherwise(0.0) + F.when(c("document_type").isin(*DESCRIBING), IN_DESCRIPTION).otherwise(0.0) + F.when(c("document_type").isin(*CONDITIONS, "pdf"), IN_CONDITIONS).otherwise(0.0)
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(SUREST), c("confidence") + shift)), 4)
    return found.withColumn("confidence", sure).withColumn("score_impact", -c("severity").cast("double"))
