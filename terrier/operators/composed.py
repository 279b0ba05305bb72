"""From the blocks of a document's pages to one row of its fields: every strategy, verification, revision, vote, merge.

Each page's text is gathered once, and each strategy gives its values of all pages as rows (page, field, methode, valeur). From there a page and
field is one row with what every strategy says of it, so that verification, revision and vote are columns of that row; only what
one field must know of others (the closing words, values that belong to another field) comes from a window over the page. Values of a field are
checked in a branch of their own, so no expression holds the rules of all fields.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import validators as V
from . import communes as C
from . import documents as D
from . import extraction as E
from . import fields as L
from . import matching as M
from . import records as R
from .shared import once, remove, stored, unbroadcast

Score = Callable[[Column, Column], Column]
FIELDS = ("commune", "n_ordre", "n_dossier", "section", "feuille", "date", "echelle", "geometre", "proprietaires_anciens", "proprietaires_nouveaux", "indication")
#: The fields that a page of each role is read for.
ROLE_FIELDS = {
    "entete": ("commune", "n_ordre", "n_dossier", "section", "feuille", "echelle", "indication"), "corps": ("proprietaires_anciens", "proprietaires_nouveaux"), "signatures": ("geometre", "date"), "all": FIELDS,
}
#: The fields that a sketch is read for on every page, besides.
SKETCH_FIELDS = ("date", "geometre", "indication", "commune", "echelle", "section", "n_ordre")
#: Fields that are voted on, and those whose sure values others may not take.
CRITICAL = ("commune", "n_ordre", "proprietaires_anciens", "proprietaires_nouveaux", "geometre", "date", "indication")
EXCLUSIVE = {"geometre": ("proprietaires_anciens", "proprietaires_nouveaux"), "commune": ("proprietaires_anciens", "proprietaires_nouveaux", "geometre"), "section": ("commune", "geometre")}
#: Labels of each field, the longest that a block holds counts.
LABELS = {
    "commune": ("sur la commune de", "en la commune de", "territoire de la commune de", "territoire de", "commune de", "commune :", "ville de", "commune"),
    "n_ordre": ("n d ordre du document d arpentage", "n d ordre du document", "numero d ordre du document d arpentage", "numero d ordre", "numero d arpentage", "n d arpentage", "n d ordre", "dossier n", "affaire n", "reference :", "da n", "n ordre", "ref :"),
    "n_dossier": ("n de dossier", "dossier :", "reference :", "ref :"),
    "section": ("section cadastrale n", "section cadastrale", "section n", "section :"),
    "feuille": ("feuille cadastrale", "feuille n", "feuille :"),
    "date": ("en date du", "etabli le", "dresse le", "signe le", "edite le", "fait a", "fait le", "date :", "date", "le :", "le"),
    "echelle": ("echelle :", "ech :", "echelle"),
    "geometre": ("geometre expert :", "geometre-expert :", "geometre expert", "dresse par m.", "dresse par m", "dresse par mr", "arpentage dresse par m", "arpentage dresse par", "etabli par :", "le geometre", "geometre :", "par le cabinet", "cabinet :", "cabinet", "dresse par", "le soussigne geometre", "geometre"),
    "proprietaires_anciens": ("ancien proprietaire", "proprietaire actuel", "proprietaire sortant", "a la demande de", "a la requete de", "appartenant a", "propriete de", "cedant :", "cedant", "vendeur :", "vendeur", "requis par", "denomme", "ci dessus nomme"),
    "proprietaires_nouveaux": ("nouveau proprietaire", "proprietaire entrant", "beneficiaire :", "beneficiaire", "acquereur :", "acquereur", "acheteur :", "acheteur", "au profit de", "en faveur de", "acquis par", "est attribue a", "cede a", "au benefice de", "transfere a", "desormais proprietaire", "mutation au profit de"),
    "indication": ("nature des operations", "objet du document", "objet :"),
}
#: Keywords of each field.
KEYWORDS = {
    "commune": ("commune", "territoire"), "n_ordre": ("n° d'ordre", "numero d'ordre", "da n°", "dossier", "affaire", "référence"), "n_dossier": ("dossier", "référence"), "section": ("section", "sect.", "sect"), "feuille": ("feuille",),
    "date": ("etabli le", "dresse le", "edite le", "signe le", "fait le", "date", "fait a"), "echelle": ("echelle", "ech.", "ech"), "geometre": ("geometre expert", "cabinet", "dresse par", "geometre"),
    "proprietaires_anciens": ("anciens proprietaires", "cedant", "vendeur"), "proprietaires_nouveaux": ("nouveaux proprietaires", "acquereur"), "indication": ("objet", "nature", "piquetage", "bornage", "division"),
}
#: Patterns of labelled values in a page's text, in order. Those of owners and surveyors are the caller's.
PATTERNS = {
    "commune": (r"c[ou]m+u[ni]e?\s*:\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s\-]{2,50}?)(?:\s*[-,]|\n|$)",),
    "n_dossier": (r"(?:dossier\s*(?:n[o°])?\s*:?|r[eé]f[eé]rence\s*(?:n[o°])?\s*:?|affaire\s*n[o°]\s*:?)\s*([A-Z0-9][A-Za-z0-9.\-/]{2,20})", r"\b([A-Z]?\d{4}[A-Z]\d{4,8})\b", r"\b([A-Z]\d{2}[.\-]\d{3,5})\b"),
    "section": (r"(?:section\s+(?:cadastrale\s+)?n[o°]?|section\s*:)\s*([A-Z]{1,2}\d{0,2})\b", r"\bsection\s+([A-Z]{1,2}\d{0,2})\b"),
    "feuille": (r"(?:feuille\s+(?:cadastrale\s+)?n[o°]?|feuille\s*:)\s*([A-Z0-9]{1,6})\b", r"\bfeuille\s+([A-Z0-9]{1,6})\b"),
    "date": (r"(?:(?:[eé]tabli|dress[eé]|[eé]dit[eé]|sign[eé]|fait)\s+le|en\s+date\s+du|fait\s+[aà])\s+(\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*\d{2,4})", r"\ble\s+(\d{1,2}\s*/\s*\d{1,2}\s*/\s*\d{4})\b", r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})\b"),
    "echelle": (r"(?:[eé]chelle|ech\.?)\s*[:\s]*(1\s*/\s*\d{3,5})", r"(?:[eé]chelle|ech\.?)\s*[:\s]*(\d{3,5}(?:\s*/\s*\d{3,5})?)"),
    "indication": (r"(?:objet\s*(?:du\s*document)?\s*:|nature\s+des\s+op[eé]rations\s*:)\s*([^\n]{5,150})", r"((?:piquetage|bornage|reconnaissance\s+de\s+limites|accord\s+amiable)(?:\s+contradictoire)?[^\n]{0,80})"),
}
#: Words of an act's object and its nature, in order.
NATURES = (
    (("bornage",), "BORNAGE"), (("division", "distraction"), "DIVISION_PARCELLAIRE"), (("lotissement",), "LOTISSEMENT"), (("reunion", "réunion"), "REUNION_PARCELLAIRE"), (("alignement", "limite"), "RECONNAISSANCE_LIMITES"),
    (("dmpc", "document d'arpentage"), "DMPC"),
)
PAGE = ["doc_id", "page"]
#: Pages that a task decides, so that its memory doesn't grow with the input.
TASK_PAGES = 25_000
#: The strategies, the first preferred, and the confidence of a value in a vote.
STRATEGIES = ("graphe", "contextuel", "mots_cles")
VOTE_CONFIDENCE = {"contextuel": 0.72, "mots_cles": 0.70}
_SURVEYOR_BELOW = (
    r"(?iu)(?:dress[eé]\s+par|g[eé]om[eè]tre[s\-]?\s*expert\s*[:\-,]|le\s+soussign[eé]\s+g[eé]om)[\s,:\-]*(?:M\.?\s*|Monsieur\s*|Mme\s*)?([A-ZÀ-ÿ][a-zà-ÿ]{2,}(?:\s+[A-ZÀ-ÿ][A-Za-zà-ÿ]{2,}){0,3})"
)


def nature(c: Column | str) -> Column:
    """The nature of an act by its object; '' without one, AUTRE for others."""
    low, out = F.lower(X.col(c)), F.when(F.coalesce(X.col(c), F.lit("")) == "", "")
    for words, name in NATURES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, name)
    return out.otherwise("AUTRE")


def page_table(blocks: DataFrame, documents: DataFrame | None = None, score: Score = S.partial_col) -> DataFrame:
    """A row a page: doc_id, page, full_text (blocks in order, a line each), role, kind. ``documents``: doc_id, native_text. The kind is that
    of the document's first page.
    """
    lit = F.coalesce(F.col("prob"), F.lit(1.0)) >= 0.25
    texts = blocks.groupBy(*PAGE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda b: b["text"]).alias("_lines"), F.transform(F.array_sort(F.collect_list(F.when(lit, F.struct("block_id", "text")))), lambda b: b["text"]).alias("_sure"),
    )
    own = texts.select(*PAGE, F.array_join("_lines", "\n").alias("full_text"), F.array_join("_sure", " ").alias("_sure")).withColumn("_pages", F.count("*").over(W.partitionBy("doc_id")))
    own = own.withColumns({"_first": F.min("page").over(W.partitionBy("doc_id")), "_last": F.max("page").over(W.partitionBy("doc_id"))})
    role = F.when(F.col("_pages") == 1, "all").when(F.col("page") == F.col("_first"), "entete").when(F.col("page") == F.col("_last"), "signatures").otherwise("corps")
    native = documents.select("doc_id", D.kind_of_text("native_text").alias("_initial")) if documents is not None else own.select("doc_id").distinct().withColumn("_initial", F.lit("GENERIC"))
    first = own.filter(F.col("page") == F.col("_first")).join(native, "doc_id", "left").withColumn("_initial", F.coalesce("_initial", F.lit("GENERIC")))
    first = first.select("doc_id", "page", "_initial", D.kind_of_reading(F.col("_initial"), F.replace("full_text", F.lit("\n"), F.lit(" ")), "_sure", score).alias("_kind"))
    dense = L.plan_density(blocks.join(first.select("doc_id", "page", "_initial"), PAGE).withColumn("prob", F.coalesce("prob", F.lit(1.0))), PAGE, F.col("_initial")).select(*PAGE, F.col("kind").alias("_dense"))
    kinds = first.join(unbroadcast(dense), PAGE, "left").select("doc_id", F.coalesce("_kind", "_dense", "_initial").alias("kind"))
    return own.join(kinds, "doc_id").select(*PAGE, "full_text", role.alias("role"), "kind")


def _checked(rows: DataFrame, value: str, score: Score) -> DataFrame:
    """rows with ``value`` cleaned by its field's rule (C18), once a row; refused ones go. Each rule is bound, so that they are no one piece of compiled code; surveyors are a
    branch of their own where their score is a UDF, which is made for every row of its branch.
    """
    apart = () if getattr(score, "builtin", False) else ("geometre",)
    passed = lambda own, fields: once(own.filter(F.col("field").isin(*fields)), {value: _of_field({f: V.validated(f, value, score) for f in fields})}, F.col(value) != "")
    out = passed(rows, [f for f in FIELDS if f not in apart])
    for f in apart:
        out = out.unionByName(passed(rows, [f]))
    return out


def _of_field(values: dict[str, Column], otherwise: Column | None = None) -> Column:
    """The value of the row's field."""
    out = None
    for f, value in values.items():
        out = F.when(F.col("field") == f, value) if out is None else out.when(F.col("field") == f, value)
    return out if otherwise is None else out.otherwise(otherwise)


def label_table(blocks: DataFrame, labels: dict[str, tuple[str, ...]] = LABELS) -> DataFrame:
    """X3 over all blocks: page, label_id, field, label."""
    keys: dict[str, str] = {}
    for field, words in labels.items():
        for w in words:
            keys.setdefault(L._key(w), field)
    known = blocks.sparkSession.createDataFrame(list(keys.items()), "label string, field string")
    hit = M.label_matches(blocks.select(*PAGE, "block_id", "text"), known, "text", "label")
    return hit.join(F.broadcast(known), F.col("found") == F.col("label")).select(*PAGE, F.col("block_id").alias("label_id"), "field", "label")


def candidates(blocks: DataFrame, pages: DataFrame, width: Column, height: Column, labels: dict = LABELS, keywords: dict = KEYWORDS, patterns: dict = PATTERNS, score: Score = S.weighted_col) -> DataFrame:
    """(page, field, methode, valeur, confidence): of each page and field one checked value of each strategy: the graph of labels and neighbours (X7; before it
    a boundary record's sentences, X18, and a form's certification, X17), patterns in the text (X14), keywords (X15).
    """
    tagged = unbroadcast(stored(label_table(blocks, labels), "labels"))
    order = lambda a, b, c: F.struct(a.cast("int").alias("a"), b.cast("long").alias("b"), c.cast("int").alias("c")).alias("o")
    graph = L.label_values(blocks, tagged, PAGE, width, height).select(*PAGE, "field", F.lit("graphe").alias("methode"), order(-F.length("label"), F.col("label_id"), F.col("place")), "valeur", "confidence")
    zones = L.zone_text(blocks, PAGE, ["block_id"])
    zero = F.lit(0)
    texts = L.contextual_options(zones, patterns, PAGE).select(*PAGE, "field", F.lit("contextuel").alias("methode"), order(F.col("place"), zero, zero), "valeur", F.lit(VOTE_CONFIDENCE["contextuel"]).alias("confidence"))
    words = L.keyword_options(blocks, keywords, PAGE, "block_id").select(*PAGE, "field", F.lit("mots_cles").alias("methode"), order(F.col("place"), zero, zero), "valeur", F.lit(VOTE_CONFIDENCE["mots_cles"]).alias("confidence"))
    raw = unbroadcast(stored(graph.unionByName(texts).unionByName(words), "raw"))
    own = _checked(raw, "valeur", score).groupBy(*PAGE, "field", "methode").agg(F.min(F.struct("o", "valeur", "confidence")).alias("b")).select(*PAGE, "field", "methode", "b.valeur", "b.confidence")
    record = D.textual_fields(pages.filter("kind = 'PVa'")).select(*PAGE, *[F.struct(F.lit(f).alias("field"), F.col(f).alias("valeur")).alias(f"_{f}") for f in ("commune", "date", "section")])
    record = record.select(*PAGE, F.explode(F.array("_commune", "_date", "_section")).alias("x")).filter("x.valeur is not null").select(*PAGE, "x.field", "x.valeur", F.lit(0.95).alias("confidence"))
    form = E.indication(pages.filter("kind = 'DMPC'"), PAGE).select(*PAGE, F.lit("indication").alias("field"), "valeur", "confidence")
    first = record.unionByName(form).withColumn("methode", F.lit("graphe"))
    out = own.join(unbroadcast(first.select(*PAGE, "field", "methode")), [*PAGE, "field", "methode"], "left_anti").unionByName(first.select(*own.columns))
    done = unbroadcast(stored(out, "candidates"))
    remove(tagged, raw)
    return done


def with_names(found: DataFrame, names: DataFrame, score: Score) -> DataFrame:
    """candidates() with communes as their names (J5), ``official`` (J6) and ``known``; a commune that is a label is none (F8)."""
    own = found.filter("field = 'commune'")
    veto = C.commune_veto(F.col("valeur"), tuple(KEYWORDS), F.lit(100))
    matched = C.match_name(own.filter(~veto), names, "valeur", score, score)
    scored = C.score_name(matched.drop("valeur").withColumnRenamed("matched", "valeur"), names, "valeur", score=score)
    communes = scored.select(*found.columns, F.col("matched").alias("official"), F.col("score").alias("name_score"), "known")
    rest = found.filter("field <> 'commune'").withColumns({"official": F.col("valeur"), "name_score": F.lit(None).cast("double"), "known": F.lit(False)})
    return communes.unionByName(rest)


def cells(pages: DataFrame, found: DataFrame, names: DataFrame, score: Score) -> DataFrame:
    """A row a page and field: the page's text and kind, and for each strategy a struct (valeur, confidence, official, known), null if it has nothing."""
    said = F.struct("valeur", "confidence", "official", "known")
    # the fields of a page come to it as one row, so that what follows is about a page and nothing but this is shuffled
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // TASK_PAGES))
    wide = found.repartition(parts, *PAGE).groupBy(*PAGE, "field").agg(*[F.min(F.when(F.col("methode") == s, said)).alias(s) for s in STRATEGIES])
    wide = wide.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(*STRATEGIES)))).alias("_said"))
    end = pages.select(*PAGE, L.closing("full_text").alias("c")).select(*PAGE, F.col("c.commune").alias("closing_commune"), F.col("c.date").alias("closing_date"))
    end = C.score_name(end, names, "closing_commune", score=score).select(*PAGE, F.when(F.coalesce("score", F.lit(0.0)) >= 80, F.col("matched")).alias("closing_name"), "closing_date")
    roles = F.create_map(*[x for r, fs in ROLE_FIELDS.items() for x in (F.lit(r), F.array(*map(F.lit, fs)))])
    wanted = F.when(F.col("kind") == "CROQUIS", F.array_union(roles[F.col("role")], F.array(*map(F.lit, SKETCH_FIELDS)))).otherwise(roles[F.col("role")])
    own = pages.repartition(parts, *PAGE).join(end, PAGE).join(wide, PAGE, "left").withColumn("field", F.explode(wanted)).withColumn("_s", F.try_element_at("_said", F.col("field")))
    return own.select(*pages.columns, "closing_name", "closing_date", "field", *[F.col(f"_s.{s}").alias(s) for s in STRATEGIES])


def _empty(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "none", "nan")


def verified(rows: DataFrame) -> DataFrame:
    """Rows (field, valeur, known, official, the strategies, full_text, closing words) with valeur, confidence, status after the passes.

    A: the confidence by format, by repeats in the text and by the names. B: a value that is not OK is extracted again by patterns, then by keywords; each other
    value than the first is a revision, and the first that gets 0.65 ends it. C: a commune under 0.70 or a date under 0.65 takes that of the
    closing words; a number without a digit goes; a missing date is the first plausible one of the text; a surveyor that is not OK is the name behind
    the words of drawing up.
    """
    field, text = F.col("field"), F.replace("full_text", F.lit("\n"), F.lit(" "))
    own = rows.withColumn("valeur", F.when((field == "commune") & F.coalesce("known", F.lit(False)), F.col("official")).otherwise(F.col("valeur")))
    own = L.verified(own.withColumn("_text", text), "_text").withColumnRenamed("verification_status", "status")
    base, old = F.col("confidence"), F.lower(F.coalesce("valeur", F.lit("")))
    weak = F.col("status").isin("INCERTAIN", "SUSPECT")
    tries = []
    for s in STRATEGIES[1:]:
        value = F.col(f"{s}.valeur")
        better = F.when(field == "commune", F.when(F.col(f"{s}.known"), F.greatest(F.lit(0.75), base + 0.20)).otherwise(base)).when(
            field.isin("n_ordre", "n_dossier"), F.when(F.upper(value).rlike(r"^[A-Z]\d{2}[.\-]?\d{2,5}$"), F.greatest(F.lit(0.85), base)).otherwise(base)
        ).otherwise(F.greatest(base + 0.15, F.lit(0.60)))
        tries.append(F.when(value.isNotNull() & (F.lower(value) != old), F.struct(value.alias("valeur"), F.bround(better, 2).alias("confidence"))))
    a, b = tries
    own = own.withColumn("_b", F.when(weak, X.bound(a, lambda a: F.when(a["confidence"] >= 0.65, a).otherwise(F.coalesce(b, a)))))
    own = own.withColumns({"valeur": F.coalesce("_b.valeur", "valeur"), "confidence": F.coalesce("_b.confidence", "confidence"), "status": F.when(F.col("_b").isNotNull(), F.when(F.col("_b.confidence") >= 0.65, "OK").otherwise("INCERTAIN")).otherwise(F.col("status"))})
    none, sure = _empty(F.col("valeur")), F.coalesce("confidence", F.lit(0.0))
    end = F.when((field == "commune") & (none | (sure < 0.70)), F.col("closing_name")).when((field == "date") & (none | (sure < 0.65)), F.col("closing_date"))
    bare = field.isin("n_ordre", "n_dossier") & F.col("valeur").isNotNull() & (F.coalesce("status", F.lit("")) != "OK") & ~F.coalesce("valeur", F.lit("")).rlike(r"\d")
    placed = F.when((field == "date") & none, X.bound(F.col("_text"), L.date_by_place))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("_text", _SURVEYOR_BELOW, 1), r"[.,;:]+$", ""), r"\s+", " "))
    real = lambda n: (F.length(n) >= 5) & (F.size(F.split(n, " ")) <= 4) & ~n.rlike(r"(?i)\b(et|de|le|la|du|un|une|par|sur|sans|avec|soussign|plan|accept|expert\b)") & ~F.upper(n).isin(*E.NO_SIGNATORY)
    drawn = F.when((field == "geometre") & (F.coalesce("status", F.lit("")) != "OK"), X.bound(name, lambda n: F.when(real(n), n)))
    own = own.withColumns({"_end": end, "_bare": bare, "_placed": placed, "_drawn": drawn})
    at = lambda e, p, n, k, d: F.when(F.col("_end").isNotNull(), e).when(F.col("_bare"), k).when(F.col("_placed").isNotNull(), p).when(F.col("_drawn").isNotNull(), n).otherwise(d)
    own = own.withColumns({
        "valeur": at(F.col("_end"), F.col("_placed"), F.col("_drawn"), F.lit(""), F.col("valeur")), "confidence": at(F.lit(0.82), F.lit(0.60), F.lit(0.75), F.lit(0.0), F.col("confidence")),
        "status": at(F.lit("OK"), F.lit("INCERTAIN"), F.lit("OK"), F.lit("SUSPECT"), F.col("status")),
    })
    return own.drop("_text", "_b", "_end", "_bare", "_placed", "_drawn")


def voted(rows: DataFrame) -> DataFrame:
    """Rows with valeur, confidence, status and ``again`` (whether the page had a vote). Critical fields that are empty or suspect are voted on: of the strategies' values, of
    which a later strategy's confidence replaces that of an equal earlier one, those go that another field of the page has for sure (unless none is left), and the
    most confident stays, if it beats the value at hand. New owners that equal the old ones are voted on as empty.
    """
    page, field = W.partitionBy(*PAGE), F.col("field")
    of = lambda name: F.max(F.when(field == name, F.lower("valeur"))).over(page)
    same = (field == "proprietaires_nouveaux") & (F.coalesce("valeur", F.lit("")) != "") & (F.lower("valeur") == of("proprietaires_anciens"))
    own = rows.withColumn("_same", F.coalesce(same, F.lit(False))).withColumn("valeur", F.when(F.col("_same"), "").otherwise(F.col("valeur")))
    open_ = field.isin(*CRITICAL) & (F.col("_same") | D.is_suspect(field, F.col("valeur"), F.col("confidence")))
    own = own.withColumn("_open", F.coalesce(open_, F.lit(False)))
    asked = F.collect_set(F.when(F.col("_open"), field)).over(page)
    own = own.withColumns({"_asked": asked, "again": F.max("_open").over(page)})
    taken = F.lit(None).cast("string")
    for source, forbidden in EXCLUSIVE.items():
        taken = F.when((field == source) & F.arrays_overlap("_asked", F.array(*map(F.lit, forbidden))), F.lower(F.trim("valeur"))).otherwise(taken)
    taken = F.when((F.coalesce("confidence", F.lit(0.0)) >= 0.75) & (F.length(taken) > 4), taken)
    own = own.withColumn("_taken", F.collect_set(taken).over(page))
    said = F.filter(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lower(F.col(f"{s}.valeur")).alias("key"), F.lit(i).alias("at"), F.col(f"{s}.confidence").alias("conf"), F.col(f"{s}.valeur").alias("valeur"))) for i, s in enumerate(STRATEGIES)]), lambda x: x.isNotNull())
    last = lambda said: F.transform(said, lambda x: X.bound(F.filter(said, lambda y: y["key"] == x["key"]), lambda e: F.struct((-F.element_at(e, -1)["conf"]).alias("conf"), F.get(e, F.lit(0))["at"].alias("at"), F.element_at(e, -1)["valeur"].alias("valeur"), x["key"].alias("key"))))
    own = own.withColumn("_said", F.when(F.col("_open"), X.bound(said, last)))  # what a field that isn't voted on says is not asked
    free = F.filter("_said", lambda x: ~F.exists("_taken", lambda t: F.startswith(x["key"], t) | F.startswith(t, x["key"])))
    guarded = field.isin("proprietaires_anciens", "proprietaires_nouveaux", "geometre")
    own = own.withColumn("_said", F.when(guarded & (F.size(free) > 0), free).otherwise(F.col("_said"))).withColumn("_best", F.array_min("_said"))
    wins = F.col("_open") & F.col("_best").isNotNull() & (F.lower(F.coalesce("valeur", F.lit(""))) != F.col("_best.key")) & (-F.col("_best.conf") > F.coalesce("confidence", F.lit(0.0)))
    wins = wins | (F.col("_same") & F.col("_best").isNotNull() & (-F.col("_best.conf") > F.coalesce("confidence", F.lit(0.0))))
    own = own.withColumn("_wins", F.coalesce(wins, F.lit(False)))
    new = {"valeur": F.when(F.col("_wins"), F.col("_best.valeur")).otherwise(F.col("valeur")), "confidence": F.when(F.col("_wins"), F.bround(-F.col("_best.conf"), 2)).otherwise(F.col("confidence"))}
    own = own.withColumns(new | {"status": F.when(F.col("_wins"), F.when(-F.col("_best.conf") >= 0.65, "OK").otherwise("INCERTAIN")).otherwise(F.col("status"))})
    return own.drop("_same", "_open", "_asked", "_taken", "_said", "_best", "_wins")


def decided(rows: DataFrame) -> DataFrame:
    """cells() to (doc_id, page, kind, field, valeur, confidence, status): the first strategy's value, verified; then, on pages where anything was voted on, the
    outcome of the vote, verified again.
    """
    first = F.coalesce(*[F.col(s) for s in STRATEGIES])
    twice = stored(voted(verified(rows.withColumns({"valeur": first["valeur"], "official": first["official"], "known": first["known"]}))), "voted")
    same = F.get(F.filter(F.array(*STRATEGIES), lambda s: s["valeur"] == F.col("valeur")), F.lit(0))
    again = twice.filter("again").withColumn("_s", same)
    named = (F.col("field") == "commune") & ((F.col("valeur") == F.coalesce("official", "closing_name")) | (F.col("valeur") == F.col("closing_name")))
    again = again.withColumns({"known": F.coalesce("_s.known", F.lit(False)) | F.coalesce(named, F.lit(False)), "official": F.coalesce("_s.official", "valeur")}).drop("_s", "confidence", "status", "again")
    columns = [*PAGE, "kind", "field", "valeur", "confidence", "status"]
    out = stored(verified(again).select(*columns).unionByName(twice.filter("not again").select(*columns)), "decided")
    remove(twice)
    return out


def page_fields(blocks: DataFrame, names: DataFrame, width: Column, height: Column, documents: DataFrame | None = None, score: Score = S.token_set_col, surveyor: Score = S.weighted_col, signal: Score = S.partial_col, **tables: dict) -> DataFrame:
    """(doc_id, page, kind, field, valeur, confidence, status) of every page and field that its role is read for."""
    blocks = unbroadcast(blocks)
    pages = unbroadcast(stored(page_table(blocks, documents, signal), "pages"))
    found = candidates(blocks, pages, width, height, score=surveyor, **tables)
    named = unbroadcast(stored(with_names(found, names, score), "named"))
    out = unbroadcast(decided(cells(pages, named, names, score)))
    remove(pages, found, named)
    return out


def document_fields(blocks: DataFrame, names: DataFrame, width: Column, height: Column, documents: DataFrame | None = None, **options) -> DataFrame:
    """One row a document: doc_id, kind, each field (the first page with a value wins, for the date the last, W8), nature, and the rules' score and status."""
    found = page_fields(blocks, names, width, height, documents, **options)
    merged = R.merge_pages(found, ["doc_id", "kind"], "page", "field", "valeur")
    docs = found.select("doc_id", "kind").distinct()
    wide = merged.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("valeur"))).alias(f) for f in FIELDS])
    row = docs.join(wide, "doc_id", "left").withColumn("nature", nature("indication"))
    known = {"anciens": "proprietaires_anciens", "nouveaux": "proprietaires_nouveaux", "type_plan": "kind"}
    own = [c for c in row.columns if c != "doc_id"]
    scored = R.scored(row.withColumns({k: F.col(v) for k, v in known.items()}), ["doc_id", *own], R.plan_rules())
    return scored.select("doc_id", *own, "score", F.col("status").alias("coherence"))
