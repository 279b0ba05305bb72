"""Extraction from positioned text, and the checks and lookups around it.

All operators are lazy and built in, but for the fuzzy lookups, which score by the Arrow UDFs of ``functions.similarity``.
Grouped lists are those of one page or one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from . import matching as M
from .candidates import held
from .records import issues, small

# -- corrections -----------------------------------------------------------------------------------------------------


def rewritten(c: Column, pattern: str, fix: Callable[[Column], Column]) -> Column:
    """c with each match of the pattern replaced by fix(match)."""
    parts = F.regexp_extract_all(c, F.lit(f"(?:{pattern})|(?:(?!{pattern})[\\s\\S])+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^(?:{pattern})$"), fix(x)).otherwise(x)), "")


#: Patterns of common misreadings and what they stand for.
KEYWORD_REPAIRS = (
    (r"\bd[&cCeE]partement\b", "Département"), (r"\bg[&cCeE]om[eèéêë&c]tre\b", "Géomètre"), (r"\bpropri[&cCeE]t[&cCeE]?\b", "Propriété"), (r"\bpropri[&cCeE]taire\b", "Propriétaire"),
    (r"\bc0mmune\b", "Commune"), (r"\bparce[l1I]{1,2}es?\b", "Parcelle"), (r"\bsecti0n\b", "Section"),
)


#: A scale and a section behind their words, a short token with a digit among look-alikes, and a file number; K4: what the signs of each become.
SCALE_TEXT, SECTION_TEXT = r"(?U)(?:[Ee]chelle|[Ee]ch\.?)\s*[A-Za-z0-9/]+\b", r"(?U)(?:[Ss]ection|[Ss]ect\.?)\s*[0-9A-Za-z]{1,2}\b"
NUMBER_TEXT, FILE_TEXT = r"(?U)\b(?=[A-Za-z]{0,4}[0-9])[0-9OolISsB]{1,5}\b", r"(?U)\b\d{4}[- ]\d+[A-ZÀ-Ÿ]?\b"


def cadastral_rules(c: Column | str) -> Column:
    """Signs of scales, section letters, short tokens of digit-like signs, file numbers, keywords; null stays null."""
    head = lambda x, p: F.regexp_extract(x, p, 1)
    tail = lambda x, p: F.substring(x, F.length(head(x, p)) + 1, F.length(x))
    a, b = r"^((?:[Ee]chelle|[Ee]ch\.?)\s*)", r"^((?:[Ss]ection|[Ss]ect\.?)\s*)"
    out = rewritten(X.col(c), SCALE_TEXT, lambda x: F.concat(head(x, a), F.translate(tail(x, a), "lIftOo", "11//00")))
    out = rewritten(out, SECTION_TEXT, lambda x: F.concat(head(x, b), F.translate(tail(x, b), "0185", "OIBS")))
    out = rewritten(out, NUMBER_TEXT, lambda x: F.translate(x, "OolISsB", "0011558"))
    out = rewritten(out, FILE_TEXT, lambda x: F.translate(x, "Oo", "00"))
    for pattern, word in KEYWORD_REPAIRS:
        out = F.regexp_replace(out, "(?iU)" + pattern, word)
    return out


def dictionary_correction(rows: DataFrame, names: DataFrame, text: str, name: str, least: float = 88.0) -> DataFrame:
    """Texts of 3 to 30 signs with at most two digits become the name of the best weighted score, from ``least`` on."""
    key = X.match_key(text)
    fit = (F.length(F.trim(text)) >= 3) & (F.length(text) <= 30) & (F.length(key) >= 3) & (F.length(F.regexp_replace(key, "[^0-9]", "")) <= 2)
    own = rows.withColumn("_q", F.when(fit, key))
    best = M.top_k(own, names.select(F.col(name).alias("_n")), "_q", "_n", 1, least=least).select("_q", "_n")
    return own.join(best, "_q", "left").withColumn("corrected", F.coalesce("_n", text)).drop("_q", "_n")


#: Words that are no person.
NO_SIGNATORY = (
    "COMMUNE", "SECTION", "FEUILLE", "ECHELLE", "PLAN", "CADASTRE", "DMPC", "DATE", "BORNAGE", "ARPENTAGE", "LOTISSEMENT", "DIVISION", "GEOMETRE", "GEOMETRES",
    "GEOMETRES EXPERTS", "GEOMETRES-EXPERTS", "EXPERT", "EXPERTS", "RECONNAISSANCE DE LIMITES", "ACCORD AMIABLE", "DESIGNAIION DES PARIIES", "DESIGNATION DES PARTIES",
    "OBJET DE", "CLAUSES GENERALES", "ACCORD DES PARTIES", "DOCUMENIS ANALYSES", "DEFINITION DES LIMIIES", "DEBAI CONIRADICIOIRE", "ORDRE DES", "DOCUMENT DE CONSERVATION",
    "DOCUMENT D ARPENTAGE", "FRANCE", "ARDECHE", "DROME", "GARD", "LOIRE", "RHONE", "RECONAISSANCE", "REIABLISSEMENI DES BORNES", "CLAUSES", "GENERALES", "ACCORD", "AMIABLE",
    "VALS LES BAINS", "VALLON PONT", "VALLON PONT D ARC", "GUILHERAND GRANGES", "GUILHERAND", "ANNONAY", "AUBENAS", "PRIVAS",
)


def is_signatory(c: Column | str) -> Column:
    """Has a capital, is no listed word, has four words at most or a civility, starts with no digit."""
    c = F.trim(X.col(c))
    plain = X.squeeze(F.regexp_replace(F.upper(c), r"[^A-Z\s]", " "))
    short = (F.size(F.split(c, r"\s+")) <= 4) | c.rlike(r"(?i)(M\.|Mme|Monsieur|Madame|Mlle)")
    return F.coalesce(c.rlike("[A-Z]") & ~plain.isin(*NO_SIGNATORY) & short & ~c.rlike(r"^\d"), F.lit(False))


# -- extraction ------------------------------------------------------------------------------------------------------

#: Per field the signs, lines and left margin (signs) that a value may take.
FIELD_EXTENT = {
    "commune": (30, 2.0, 12), "section": (5, 1.5, 2), "n_ordre": (15, 1.5, 2), "n_dossier": (12, 1.5, 2), "feuille": (5, 1.5, 2), "geometre": (35, 2.5, 5), "date": (12, 1.5, 2),
    "proprietaires_anciens": (60, 3.0, 3), "proprietaires_nouveaux": (60, 3.0, 3), "indication": (50, 2.5, 3), "signataires": (40, 3.0, 3), "echelle": (15, 1.5, 2),
}
OTHER_EXTENT = (15, 1.5, 3)


def anchor_zones(labels: DataFrame, page: list[str], width: str = "width", height: str = "height") -> DataFrame:
    """Per page and field the rectangle, in page fractions, in which the value of the longest label is looked for.

    labels: page keys, field, label, block_id, text, x0, y0, x1, y1 and the page's size. Of labels of one length the smaller
    block id counts. The size of a sign is estimated from the label's box and held between bounds; handwriting takes 1.5 times it.
    """
    pick = F.max_by(F.struct("label", "text", "x0", "y0", "x1", "y1", width, height), F.struct(F.length("label"), -F.col("block_id")))
    best = labels.groupBy(*page, "field").agg(pick.alias("b")).select(*page, "field", "b.*")
    extent = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in FIELD_EXTENT.items() for x in (k, float(v[i]))]), F.col("field")), F.lit(float(OTHER_EXTENT[i])))
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    held = lambda v, low, high: F.least(F.greatest(v, low), high)
    sign = held((F.col("x1") - F.col("x0")) / F.greatest(F.lit(1), F.length("text")), w * 0.002, w * 0.04)
    line = held(F.col("y1") - F.col("y0"), h * 0.005, h * 0.04)
    zero = F.lit(0.0)
    wide = lambda margin, rise, factor: F.array(
        F.greatest(zero, F.col("x0") - sign * margin) / w, F.greatest(zero, F.col("y0") - line * rise) / h,
        F.least(w, F.col("x1") + extent(0) * sign * factor) / w, F.least(h, F.col("y1") + extent(1) * line * factor) / h,
    )
    return best.select(*page, "field", "label", F.col("text").alias("brut"), wide(extent(2), 0.5, 1.5).alias("zone"), wide(F.lit(2.0), 0.0, 1.0).alias("display_zone"))


def grid_values(labels: DataFrame, blocks: DataFrame, page: list[str], valid: Column, right: Column, below: Column) -> DataFrame:
    """Per label the nearest valid block to the right or below, by dx + 3 dy of the centres; ties to the smaller block id.

    Boxes are l_x0.. and x0..; ids label_id, label_block and block_id; ``right`` and ``below`` are the farthest distances.
    """
    centre = lambda a, b: (F.col(a) + F.col(b)) / 2
    dx, dy = centre("x0", "x1") - centre("l_x0", "l_x1"), centre("y0", "y1") - centre("l_y0", "l_y1")
    pairs = labels.join(blocks.filter(valid), page).filter((F.col("block_id") != F.col("label_block")) & (F.abs(dx) <= right) & (dy >= -0.5 * (F.col("l_y1") - F.col("l_y0"))) & (dy <= below))
    near = F.min(F.struct((F.abs(dx) + 3 * F.abs(dy)).alias("d"), "block_id"))
    return pairs.groupBy(*page, "label_id").agg(near.alias("b")).select(*page, "label_id", "b.block_id", F.col("b.d").alias("distance"))


#: The sentences of which a form leaves one standing.
INDICATIONS = {
    "A": "d'après les indications qu'ils ont fournies au bureau",
    "B": "en conformité d'un piquetage qu'ils ont effectué sur le terrain",
    "C": "d'après un plan d'arpentage ou de bornage, dont copie ci-jointe",
}


def joined_text(blocks: DataFrame, page: list[str], order: str = "block_id", text: str = "text") -> DataFrame:
    """The blocks of each page in order, one a line."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"])
    return blocks.groupBy(*page).agg(F.array_join(lines, "\n").alias("full_text"))


def indication(pages: DataFrame, page: list[str], text: str = "full_text", least: float = 75.0) -> DataFrame:
    """Of the three sentences the one that the page's text holds best, by partial ratio from ``least`` on; the first of equals."""
    score = S.partial_col
    each = [F.struct(score(F.lit(s), F.trim(F.lower(text))).alias("s"), F.lit(-i).alias("i"), F.lit(s).alias("v")) for i, s in enumerate(INDICATIONS.values())]
    best = pages.select(*page, F.array_max(F.array(*each)).alias("b")).filter(F.col("b.s") >= least)
    return best.select(*page, F.col("b.v").alias("valeur"), F.least(F.lit(0.95), F.col("b.s") / 100).alias("confidence"))


#: How a model begins before it says what it read.
ANSWER_STARTS = (
    r"la commune\s.*?(?:est|:|: |\s)\s*", r"la commune est", r"la date .*? est", r"le num[é\w]ro .*? est", r"le da est", r"le g[é\w]om[è\w]tre est", r"la photo montre.*?(?:sont|est|:)\s*",
    r"l'image montre.*?(?:sont|est|:)\s*", r"this image (?:shows|contains|depicts).*?(?::,)\s*", r"il semble.*?:\s*", r"les nombres.*?(?:sont|est|:)\s*", r"le texte sur l'?image est",
    r"le texte dans l'?image est", r"le texte correspondant .*? est", r"il s'agit de", r"ce document", r"voici le texte", r"texte lu", r"le texte lu est", r"le texte est", r"texte:", r"valeur",
    r"je peux voir", r"je vois", r"i can see", r"the text (?:reads|says|is)", r"based on the image", r"in the image",
)


def plain_answer(c: Column | str) -> Column:
    """C17: a model's answer without its beginnings, quotes and outer signs."""
    own = F.trim(F.regexp_replace(X.col(c), r"(?iu)^(?:.*?(?:" + "|".join(ANSWER_STARTS) + r")\s*:?\s*)+", ""))
    own = F.trim(F.regexp_replace(own, r"(?iu)^(?:texte|le texte|la valeur)?\s*(?:dans|sur)?\s*(?:l'?image|ce document)?\s*(?:est|:)?\s*", ""))
    return F.trim(F.translate(own, "\"'", ""), F.lit(" .:,"))


def chosen_indication(c: Column | str) -> Column:
    """C17: plain_answer(); one that names one of A, B and C only becomes its sentence."""
    plain = plain_answer(c)
    has = {k: F.contains(F.upper(plain), F.lit(k)) for k in INDICATIONS}
    out = F.when(F.lit(False), "")
    for k, sentence in INDICATIONS.items():
        alone = has[k]
        for other in INDICATIONS:
            alone = alone & ~has[other] if other != k else alone
        out = out.when(alone, sentence)
    return out.otherwise(plain)


#: Numbers behind 'parcelles n°', and the lines of numbers below a line that names parcels or sections.
PARCELS_BEHIND = r"(?iu)(?:parcelle[s]?\s*n[o°][s]?|n[o°]\s*de\s*parcelle[s]?)\s*[:\-]?\s*(\d{1,5}[A-Za-z]?(?:\s*[,/;]\s*\d{1,5}[A-Za-z]?)*)"
PARCELS_BELOW = r"(?iu)(?:parcelle[s]?|section[s]?)[^\n]{0,80}\n((?:\s*(?:n[o°]\s*)?\d{1,5}[A-Za-z]?(?:\s*[,/;]\s*|\s*\n\s*|\s+|$)){1,15})"


def parcel_lists(pages: DataFrame, page: list[str], text: str, new: str, old: str) -> DataFrame:
    """The parcels of a text (behind and below the words that name them, years left out below), tagged new, then those read by colour: new ones that
    the text lacks, and old ones, each once. ``new`` and ``old`` are null where colours don't tell.
    """
    found = lambda p, one: F.flatten(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(one), F.lit(0))))
    below = F.filter(found(PARCELS_BELOW, r"\b\d{1,5}[A-Za-z]?\b"), lambda n: ~n.rlike(r"^(?:19|20)\d{2}$"))
    none = F.array().cast("array<string>")
    own = F.coalesce(F.concat(found(PARCELS_BEHIND, r"\d{1,5}[A-Za-z]?"), below), none)
    tagged = lambda a, tag: F.transform(a, lambda x: F.concat(x, F.lit(f" ({tag})")))
    fresh = F.array_distinct(F.filter(F.coalesce(F.col(new), none), lambda x: ~F.array_contains(own, x)))
    return pages.select(*page, F.concat(tagged(own, "Nouveau"), tagged(fresh, "Nouveau"), tagged(F.array_distinct(F.coalesce(F.col(old), none)), "Ancien")).alias("parcelles"))


def signatories(blocks: DataFrame, doc: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Names behind a civility, else behind words of certification; valid ones, each once, in order of their first block."""
    t = F.trim(text)
    titled = F.trim(F.regexp_extract(t, r"(?U)\b(?:M\.?|Mme\.?|Monsieur|Madame|Mlle\.?)\s+[A-ZÀ-Ý][A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\-]{1,30}", 0))
    signed = F.regexp_extract(t, r"(?iu)(?:certifi[eé]\s+exact|vu\s+et\s+approuv[eé]|soussign[eé](?:e?s)?)[,\s:]+([A-ZÀ-Ý][A-Za-zÀ-ÿ\s\-.]{3,50})", 1)
    name = F.when(titled != "", titled).otherwise(F.regexp_replace(F.trim(signed), "[.,;:]+$", ""))
    found = blocks.select(*doc, F.struct(*order).alias("_o"), name.alias("_n")).filter((F.col("_n") != "") & is_signatory("_n"))
    first = found.groupBy(*doc, "_n").agg(F.min("_o").alias("_o"))
    return first.groupBy(*doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_n"))), lambda s: s["_n"]).alias("signataires"))


#: Words of the three ways to sign, in order.
SIGNING = (("dispense", "dispensés de signer (3°)"), ("represente", "représentés (2°)"), ("soussigne", "soussignés (1°)"))


def certification(docs: DataFrame, blocks: DataFrame, doc: list[str], least: float = 0.25) -> DataFrame:
    """Who represents the owners where a block says so; else the way of signing whose word was read most surely, struck-out words being
    read badly; 'soussignés (1°)' where none was.
    """
    t = F.lower(X.strip_accents("text"))
    hits = F.filter(F.array(*[F.when(t.contains(w), F.struct(F.col("prob").alias("p"), F.lit(-i).alias("i"), F.lit(v).alias("v"))) for i, (w, v) in enumerate(SIGNING)]), lambda x: x.isNotNull())
    best = blocks.filter(F.col("prob") >= least).select(*doc, F.explode(hits).alias("b")).groupBy(*doc).agg(F.max("b").alias("b"))
    who = F.trim(F.regexp_extract("text", r"(?iu)repr[eé]sent[eé]s?\s+(?:par\s+)?([A-ZÀ-Ý][A-Za-zÀ-ÿ\s\-.]{2,40})", 1))
    named = blocks.select(*doc, "block_id", F.when(who != "", who).alias("w")).filter("w is not null").groupBy(*doc).agg(F.min_by("w", "block_id").alias("w"))
    said = F.coalesce(F.concat(F.lit("représentés par "), F.col("w"), F.lit(" (2°)")), F.col("b.v"), F.lit(SIGNING[-1][1]))
    return docs.select(*doc).distinct().join(best, doc, "left").join(named, doc, "left").select(*doc, said.alias("certification"))


def page_role(page: Column | str, pages: Column | str) -> Column:
    """X26."""
    page, pages = X.col(page), X.col(pages)
    return F.when(pages == 1, "all").when(page == 1, "entete").when(page == pages, "signatures").otherwise("corps")


def merged_lines(c: Column | str, gap: int = 8) -> Column:
    """Sorted positions; one at most ``gap`` from the last line moves that line to the middle of both, else begins a line."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    step = lambda acc, y: F.when((F.size(acc) == 0) | (F.abs(y - last(acc)) > gap), F.concat(acc, F.array(y))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.floor((last(acc) + y) / 2))))
    return F.aggregate(F.array_sort(X.col(c).cast("array<long>")), F.array().cast("array<long>"), step)


# -- checks and lookups ----------------------------------------------------------------------------------------------


def frequency_penalty(matches: DataFrame, page: list[str], name: str = "official", score: str = "score", share: float = 0.3) -> DataFrame:
    """A name in max(3, share of the page's cells) cells or more loses 10 a cell from there on, 40 at most, and not below 0."""
    line = F.greatest(F.lit(3), F.floor(F.count("*").over(W.partitionBy(*page)) * share).cast("int"))
    n = F.count("*").over(W.partitionBy(*page, name))
    real = F.col(name).isNotNull() & ~F.col(name).isin("", "Non identifiée", "[VIDE]")
    less = F.greatest(F.lit(0.0), F.col(score) - F.least(F.lit(40), (n - line + 1) * 10))
    return matches.withColumn(score, F.when(real & (n >= line), less).otherwise(F.col(score).cast("double")))


#: Words that a surveyor's name doesn't hold.
NO_SURVEYOR = ("expert", "géom", "geom", "ingénierie", "ingenier", "référence")


def output_audit(results: DataFrame, keys: list[str]) -> DataFrame:
    """Missing and doubtful fields of the columns fichier, commune, n_ordre, n_dossier, geometre, section, nature."""
    none = lambda c: F.coalesce(F.col(c).isin("", "None"), F.lit(True))
    act = F.coalesce(F.col("n_ordre") == "", F.lit(True)) | (none("n_ordre") & F.col("fichier").contains("PLa")) | F.lower("fichier").contains("dmpc")
    doubtful = F.lower("geometre").rlike("|".join(NO_SURVEYOR))
    rules = [
        ("COMMUNE_VIDE", "ERREUR", none("commune"), ["commune"]), ("NUMEROS_VIDES", "ALERTE", act & none("n_dossier"), ["n_ordre", "n_dossier"]), ("GEOMETRE_VIDE", "ALERTE", none("geometre"), ["geometre"]),
        ("GEOMETRE_SUSPECT", "ALERTE", ~none("geometre") & doubtful, ["geometre"]), ("SECTION_VIDE", "INFO", none("section"), ["section"]), ("NATURE_INCONNUE", "INFO", F.coalesce(F.col("nature").isin("", "AUTRE"), F.lit(True)), ["nature"]),
    ]
    return issues(results, keys, rules)


def alias_or_fuzzy(rows: DataFrame, names: DataFrame, aliases: DataFrame, text: str, confidence: str) -> DataFrame:
    """The alias (alias, name) equal to the text, else the best weighted name; score 0.7 of the match and 0.3 of the confidence."""
    own = rows.withColumn("_q", X.match_key(text))
    exact = small(aliases.groupBy(X.match_key("alias").alias("_q")).agg(F.min("name").alias("_exact")))
    best = M.top_k(own, names.select(X.match_key("name").alias("_n")), "_q", "_n", 1).select("_q", "_n", F.round("score", 1).alias("_s"))
    official = small(names.groupBy(X.match_key("name").alias("_n")).agg(F.min("name").alias("_fuzzy")))
    out = own.join(exact, "_q", "left").join(best.join(official, "_n"), "_q", "left")
    match = F.when(F.col("_exact").isNotNull(), 100.0).otherwise(F.coalesce("_s", F.lit(0.0)))
    how = F.when(F.col("_exact").isNotNull(), "Alias Exact").when(F.col("_fuzzy").isNotNull(), "Fuzzy matching").otherwise("Échec")
    return out.withColumns({"commune": F.coalesce("_exact", "_fuzzy", F.lit("Non identifiée")), "score": F.round(0.7 * match + 0.3 * F.col(confidence), 1), "methode": how}).drop("_q", "_n", "_s", "_exact", "_fuzzy")


def kb_entry(rows: DataFrame, kb: DataFrame, commune: str, least: float = 85.0) -> DataFrame:
    """The commune of the knowledge base with an equal key, else the one of the best weighted score from ``least`` on."""
    own = rows.withColumn("_q", X.loose_key(commune))
    keys = kb.groupBy(X.loose_key("commune").alias("_k")).agg(F.min("commune").alias("kb_commune"))
    todo = own.select("_q").distinct().join(keys.select(F.col("_k").alias("_q")), "_q", "left_anti")
    near = M.top_k(todo, keys, "_q", "_k", 1, least=least).select("_q", "_k")
    ways = near.unionByName(keys.select(F.col("_k").alias("_q"), "_k")).join(keys, "_k").select("_q", "kb_commune")
    return own.join(small(ways), "_q", "left").drop("_q")


def kb_bootstrap(kb: DataFrame, reference: DataFrame) -> DataFrame:
    """Communes of the reference (nom, code) that the base lacks come in empty; a base entry keeps all but a missing code."""
    new = reference.filter(F.trim("nom") != "").groupBy(F.trim("nom").alias("commune")).agg(F.min(F.trim("code")).alias("_code"))
    code = F.coalesce(F.when(F.col("code_insee") != "", F.col("code_insee")), F.col("_code"))
    empty = F.array().cast("array<string>")
    lists = [F.coalesce(c, empty).alias(c) for c in ("sections_connues", "prefixes_dossier", "types_plans_frequents")]
    return kb.join(new, "commune", "full").select("commune", code.alias("code_insee"), F.coalesce("departement", F.substring("_code", 1, 2)).alias("departement"), *lists)


def kb_enriched(kb: DataFrame, validated: DataFrame) -> DataFrame:
    """Sections of validated documents (commune, section) that an entry lacks are appended, in upper case and order."""
    new = validated.filter(F.trim("section") != "").groupBy("commune").agg(F.array_sort(F.collect_set(F.upper(F.trim("section")))).alias("_new"))
    known = F.coalesce("sections_connues", F.array().cast("array<string>"))
    return kb.join(new, "commune", "left").withColumn("sections_connues", F.array_union(known, F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def search(records: DataFrame, equal: dict[str, object], date: str, first: str | None = None, last: str | None = None, order: tuple[str, ...] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Records whose columns have the given values and whose date lies in the range, a page of them in order."""
    for column, value in equal.items():
        records = records.filter(F.col(column) == F.lit(value))
    for bound, holds in ((first, F.col(date) >= F.lit(first)), (last, F.col(date) <= F.lit(last))):
        records = records.filter(holds) if bound is not None else records
    page = records.orderBy(*order).offset(offset) if order or offset else records
    return page.limit(limit) if limit is not None else page


def text_scan(pages: DataFrame, names: DataFrame, page: list[str], text: str, name: str, above: float = 88.0, longer: int = 5) -> DataFrame:
    """Per page the name of more than ``longer`` signs that its text holds best, by partial ratio above a line; ties by name. A text that is shorter than
    a name can't hold it and is held against the whole of it: else a page of one letter would match every name with that letter.
    """
    own = pages.select(*page, X.match_key(text).alias("_t"))
    ref = names.groupBy(X.match_key(name).alias("_n")).agg(F.min(name).alias("found")).filter(F.length("_n") > longer)
    hits = held(own, ref, "_t", "_n", above)
    short = F.length("_t") < F.length("_n")
    hits = hits.withColumn("_whole", S.ratio_col(F.when(short, F.col("_t")), F.when(short, F.col("_n")))).withColumn("_score", F.when(short, F.col("_whole")).otherwise(F.col("_score"))).filter(F.col("_score") > above)
    best = hits.groupBy("_t").agg(F.min(F.struct((-F.col("_score")).alias("s"), "_n")).alias("b")).select("_t", "b._n", (-F.col("b.s")).alias("score"))
    return own.join(best.join(small(ref), "_n"), "_t").select(*page, "found", "score")


def manual_references(matches: DataFrame, manual: DataFrame, keys: list[str]) -> DataFrame:
    """A typed reference (keys, reference, op_code) becomes the record where none matched; a match stays, blanks don't count.

    matches: keys, status, reference, op_code; of several typed references of a key the smallest counts.
    """
    typed = manual.filter(F.trim("reference") != "").groupBy(*keys).agg(F.min(F.struct(F.trim("reference").alias("reference"), F.trim("op_code").alias("op_code"))).alias("_m"))
    use = F.col("_m").isNotNull() & (F.coalesce("status", F.lit("NO_MATCH")) == "NO_MATCH")
    pick = lambda c: F.when(use, F.col(f"_m.{c}")).otherwise(F.col(c)).alias(c)
    return matches.join(typed, keys, "left").select(*keys, F.when(use, "MANUEL").otherwise(F.col("status")).alias("status"), pick("reference"), pick("op_code"))


def model_answers(cells: DataFrame, names: DataFrame, cell: str = "cell_id", name: str = "name") -> DataFrame:
    """The name that a model's answers stand for: cell, official, score, methode; cells of which no pass is sure are left out.

    cells: cell, answer, hint, second, letters (signs that were counted; 0 or null: unknown). A name scores the best of the answer's
    weighted score (15 names), 0.95 of its ratio and 0.9 of the hint's weighted score (10 each). P1 takes 75 with at most 5 letters
    more or less; P2 the second answer's best name from 70, or 82 if the length differs; P3 one of the first five from 65, within 6.
    """
    own = cells.select(cell, *[X.match_key(c).alias(f"_{c}") for c in ("answer", "hint", "second")], F.upper("second").alias("_raw"), F.coalesce("letters", F.lit(0)).alias("_len"))
    ref = names.groupBy(X.match_key(name).alias("_n")).agg(F.min(name).alias("official"))
    ways = [("_answer", S.weighted_col, 15, 1.0), ("_answer", S.ratio_col, 10, 0.95), ("_hint", S.weighted_col, 10, 0.9)]
    scored = None
    for probe, score, k, share in ways:
        some = own.filter(F.col(probe) != "")
        best = M.top_k(some, ref, probe, "_n", k, score).select(probe, "_n", F.floor(F.col("score") * share).alias("score"))
        way = some.select(cell, probe, "_len").join(best, probe).select(cell, "_len", "_n", "score")
        scored = way if scored is None else scored.unionByName(way)
    merged = scored.groupBy(cell, "_len", "_n").agg(F.max("score").alias("score"))
    gap = F.when(F.col("_len") == 0, 0).otherwise(F.abs(F.col("_len") - F.length(F.replace("_n", F.lit(" "), F.lit("")))))
    ranked = merged.withColumn("_r", F.row_number().over(W.partitionBy(cell).orderBy(F.desc("score"), "_n"))).withColumn("_gap", gap)
    row = lambda df, n, methode, share: df.select(cell, F.lit(n).alias("_p"), F.col("_r"), "_n", F.floor(F.col("score") * share).alias("score"), F.lit(methode).alias("methode"))
    asked = own.filter((F.col("_second") != "") & ~F.col("_raw").contains("ILLISIBLE") & (F.length("_raw") > 2))
    again = asked.join(M.top_k(asked, ref, "_second", "_n", 1).select("_second", "_n", "score"), "_second").withColumns({"_r": F.lit(1), "_gap": gap})
    passes = row(ranked.filter("score >= 75 and _gap <= 5"), 1, "VLM_P1", 1.0)
    passes = passes.unionByName(row(again.filter("score >= if(_gap <= 5, 70, 82)"), 2, "VLM_P2", 0.95))
    passes = passes.unionByName(row(ranked.filter("_r <= 5 and score >= 65 and _gap <= 6"), 3, "VLM_P3_rescue", 0.85))
    first = passes.groupBy(cell).agg(F.min_by(F.struct("_n", "score", "methode"), F.struct("_p", "_r")).alias("b"))
    return first.select(cell, "b.*").join(ref, "_n").select(cell, "official", "score", "methode")
