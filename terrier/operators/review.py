"""Checks against a knowledge base and a schema, review of records, lineage of single parcels, places on the map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import small
from ..functions import text as X
from . import records as R
from .candidates import near

Score = Callable[[Column, Column], Column]
#: Names of places that are no surveyor.
PLACES = (
    "ARDECHE", "DROME", "GARD", "LOIRE", "RHONE", "HERAULT", "LOZERE", "FRANCE", "VALS LES BAINS", "AUBENAS", "PRIVAS", "ANNONAY", "GUILHERAND", "GUILHERAND GRANGES",
    "VALLON PONT D ARC",
)
#: Words that are no part of a surveyor's name.
FUNCTION_WORDS = (
    "par", "le", "la", "les", "du", "de", "des", "au", "aux", "dresse", "dressé", "dresser", "cachet", "service", "bureau", "origine", "dorigine", "apres", "après", "plon",
)
#: States of a record that is done, and of one that waits.
VALIDATED, IGNORED, WAITING = "Validé par l'humain", "Ignoré (Vide)", "À valider"
DONE = (VALIDATED, "Corrigé automatiquement", IGNORED)
#: The centre of the map where nothing is found.
DEFAULT_PLACE = (44.7356, 4.5990)


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def surveyor_rules() -> list[tuple[str, str, Column, list[str]]]:
    """V5: a surveyor's name that is a place, too short, or of three words and more without a proper one: one rule at most holds."""
    t = _text("geometre")
    place, short = X.loose_key(t).isin(*PLACES), F.length(t) < 5
    words = F.split(t, r"\s+")
    proper = F.exists(words, lambda w: ~F.lower(w).isin(*FUNCTION_WORDS) & w.rlike("^[A-ZÀÂÆÇÉÈÊËÎÏÔÙÛÜŸ][a-zàâæçéèêëîïôùûüÿ]{2,}$"))
    return [
        ("GEOMETRE_EST_VILLE", "ERREUR", (t != "") & place, ["geometre"]),
        ("GEOMETRE_TROP_COURT", "ALERTE", (t != "") & ~place & short, ["geometre"]),
        ("GEOMETRE_SUSPECT", "ALERTE", ~place & ~short & (F.size(words) >= 3) & ~proper, ["geometre"]),
    ]


def schema_rules() -> list[tuple[str, str, Column, list[str]]]:
    """Date without four digits, section not of one to three letters and up to two digits, scale outside 200 to 10000; a section
    without a commune only where no field is at fault.
    """
    date, section, commune = _text("date"), _text("section"), _text("commune")
    scale = F.regexp_extract(F.replace(_text("echelle"), F.lit(" "), F.lit("")), r"(\d{3,5})", 1)
    no_year = (date != "") & ~date.rlike(r"\d{4}")
    odd = (section != "") & ~section.rlike(r"^[A-Za-z]{1,3}\d{0,2}$")
    out = (scale != "") & ~scale.cast("int").between(200, 10000)
    name = "PYDANTIC_VALUE_ERROR"
    return [(name, "ALERTE", no_year, ["date"]), (name, "ALERTE", odd, ["section"]), (name, "ALERTE", out, ["echelle"]), (name, "ALERTE", (section != "") & (commune == "") & ~(no_year | odd | out), ["model"])]


def with_knowledge(docs: DataFrame, kb: DataFrame, score: Score = S.weighted_col, least: float = 85.0) -> DataFrame:
    """Docs with kb, the entry of their commune as a struct: by N4, else the best score from ``least``; ties by key. kb: commune, sections_connues,
    prefixes_dossier, types_plans_frequents.
    """
    own = docs.withColumn("_q", X.loose_key(_text("commune")))
    entries = kb.withColumn("_n", X.loose_key("commune")).groupBy("_n").agg(F.min(F.struct("commune", "sections_connues", "prefixes_dossier", "types_plans_frequents")).alias("kb"))
    exact = own.join(R.small(entries), F.col("_q") == F.col("_n"), "left").drop("_n")
    todo = exact.filter("kb is null and _q <> ''").select("_q").distinct()
    pairs = near(todo, entries, "_q", "_n", score, least, 1).withColumnRenamed("_score", "_s")
    best = pairs.groupBy("_q").agg(F.min(F.struct((-F.col("_s")).alias("s"), "_n"))["_n"].alias("_n")).join(R.small(entries), "_n").select(F.col("_q").alias("_f"), F.col("kb").alias("_near"))
    return exact.join(best, F.col("_q") == F.col("_f"), "left").withColumn("kb", F.coalesce("kb", "_near")).select(*docs.columns, "kb")


def knowledge_rules() -> list[tuple[str, str, Column, list[str]]]:
    """V11-V14 over with_knowledge(): an unknown section, dossier prefix or kind of plan of a known commune, and an unknown commune."""
    section, commune = F.upper(_text("section")), _text("commune")
    dossier = F.when(_text("n_ordre") != "", _text("n_ordre")).otherwise(_text("n_dossier"))
    year = X.dossier_year(F.upper(dossier))
    prefix = F.concat(F.lit("A"), X.zero_filled(F.pmod(year, F.lit(100)), 2))
    some = lambda c: F.size(F.coalesce(F.col(f"kb.{c}"), F.array().cast("array<string>"))) > 0
    known = F.transform("kb.sections_connues", F.upper)
    return [
        ("SECTION_INCONNUE_COMMUNE", "ALERTE", (section != "") & some("sections_connues") & ~F.array_contains(known, section), ["commune", "section"]),
        ("DOSSIER_PREFIXE_NOUVEAU", "INFO", year.isNotNull() & some("prefixes_dossier") & ~F.array_contains("kb.prefixes_dossier", prefix), ["n_ordre"]),
        ("TYPE_PLAN_RARE_COMMUNE", "INFO", some("types_plans_frequents") & ~F.array_contains("kb.types_plans_frequents", _text("type_plan")), ["commune"]),
        ("COMMUNE_ABSENTE_KB", "INFO", (commune != "") & F.col("kb").isNull(), ["commune"]),
    ]


def checked(docs: DataFrame, keys: list[str], kb: DataFrame | None = None, score: Score = S.weighted_col) -> DataFrame:
    """The issues of all layers in their order, each rule and fields once: V1-V8 with V5, V9, then V11-V14 if the knowledge base holds anything."""
    rules = [r for r in R.plan_rules() if not r[0].startswith("GEOMETRE")] + surveyor_rules() + schema_rules()
    if kb is None or not kb.take(1):
        return R.issues(docs, keys, rules)
    return R.issues(with_knowledge(docs, kb, score), keys, rules + knowledge_rules())


def issues_by_field(found: DataFrame) -> DataFrame:
    """Level, fields (one field a row), n, and the rules in order."""
    return found.select("level", "rule", F.explode(F.split("fields", ",")).alias("fields")).groupBy("level", "fields").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("rule")).alias("rules"))


def summary(scored: DataFrame) -> DataFrame:
    """The scored documents with ``summary``, their counts in words."""
    part = lambda c, word: F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c), F.lit(word)))
    said = F.concat_ws(", ", part("errors", "erreur(s)"), part("alerts", "alerte(s)"), part("infos", "info(s)"))
    return scored.withColumn("summary", F.when(said == "", "Aucune anomalie").otherwise(said))


# -- review ----------------------------------------------------------------------------------------------------------


def edited(edits: DataFrame, names: DataFrame | None = None, score: Score = S.token_set_col) -> DataFrame:
    """T5: edits (doc_id, column, value) with ``final``: the value as its column wants it; with names, a commune is the name that
    communes.with_code() finds from 55, and ``code`` its code.
    """
    from . import communes as C

    column, value = F.col("column"), F.col("value")
    parcels = column.isin("Parcelles", "Anciennes_Parcelles", "Nouvelles_Parcelles")
    final = F.when(column == "Section", X.format_section(value)).when(column == "Date", X.compact_date(value)).when(column == "Echelle", X.format_scale(value)).when(parcels, X.clean_parcels(value)).otherwise(value)
    out = edits.withColumn("final", F.coalesce(final, F.lit("")))
    if names is None:
        return out.withColumn("code", F.lit(None).cast("string"))
    read = F.when((column == "Commune") & (F.trim("value") != ""), value)
    found = C.with_code(out.select(read.alias("_read")).filter("_read is not null").distinct(), names, "_read", score=score)
    found = found.filter("score >= 55").select("_read", "matched", F.col("code"))
    joined = out.withColumn("_v", read).join(found, F.col("_v") == F.col("_read"), "left")
    return joined.withColumn("final", F.coalesce("matched", "final")).select(*out.columns, "code")


def prefills(rows: DataFrame) -> DataFrame:
    """The register search of a record: lu_parcelle (five numbers of all three lists), lu_annee (D1), rc_annee (day-month-year, pivot 30)."""
    every = F.concat_ws(" ", *[_text(c) for c in ("Anciennes_Parcelles", "Nouvelles_Parcelles", "Parcelles")])
    return rows.withColumns({"lu_parcelle": small.first_parcels(X.numeric_tokens(every)), "lu_annee": X.year_of_date("Date"), "rc_annee": X.search_year("Date", False), "d_annee": X.search_year("Date", True)})


def confirmed_status(rows: DataFrame, actions: DataFrame, key: str = "doc_id", status: str = "Confirmation_Status") -> DataFrame:
    """The last action of each record (save or ignore) sets its status; ``done`` tells whether it is out of the queue."""
    last = actions.groupBy(key).agg(F.max_by("action", "ts").alias("_a"))
    out = rows.join(last, key, "left")
    new = F.when(F.col("_a") == "save", VALIDATED).when(F.col("_a") == "ignore", IGNORED).otherwise(F.coalesce(status, F.lit(WAITING)))
    return out.withColumn(status, new).withColumn("done", F.col(status).isin(*DONE)).drop("_a")


def progress(rows: DataFrame, keys: list[str], done: Column) -> DataFrame:
    """Total, done and their share, of each group."""
    n = F.count(F.when(done, 1))
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), n.alias("done"), (n / F.count("*")).alias("progress"))


def recent_anchors(anchors: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` anchors of each commune, one a reading (its first), with the commune's number of readings as ``confirmed``."""
    one = anchors.withColumn("_k", F.row_number().over(W.partitionBy("commune", "ocr_text").orderBy("ts"))).filter("_k = 1").drop("_k")
    ranked = one.withColumns({"_r": F.row_number().over(W.partitionBy("commune").orderBy(F.desc("ts"))), "confirmed": F.count("*").over(W.partitionBy("commune"))})
    return ranked.filter(F.col("_r") <= n).drop("_r")


def source_documents(results: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".pdf", ".tif", ".tiff", ".jpg", ".png")) -> DataFrame:
    """Results (base) with ``source``, the file (path) of that name with the first of the extensions, whatever its case."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    kind = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1))
    rank = F.array_position(F.array(*map(F.lit, extensions)), kind)
    found = files.select(base.alias("_base"), rank.alias("_r"), "path").filter("_r > 0").groupBy("_base").agg(F.min(F.struct("_r", "path"))["path"].alias("source"))
    return results.join(found, F.col("base") == F.col("_base"), "left").drop("_base")


def result_files(docs: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("PVa", "PLa", "DMPC", "GENERIC", "PLAN", "moderne")) -> DataFrame:
    """Docs (base, type_plan) with ``json``: the file of the plan's own kind, else of the first of the kinds, else the first whose name begins with the base."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.select(F.regexp_replace(name, r"_plan_[^_]*\.json$|\.json$", "").alias("_base"), F.regexp_extract(name, r"_plan_([^_]*)\.json$", 1).alias("_kind"), "path")
    rank = F.when(F.col("_kind") == F.col("type_plan"), 0).otherwise(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, suffixes)), F.col("_kind")), F.lit(0)), F.lit(99)))
    hit = docs.join(own, F.col("base") == F.col("_base")).groupBy("base", "type_plan").agg(F.min(F.struct(rank.alias("r"), "path"))["path"].alias("json"))
    return docs.join(hit, ["base", "type_plan"], "left")


# -- lineage and places ----------------------------------------------------------------------------------------------


def parcel_key(insee: Column, section: Column, number: Column) -> Column:
    return F.struct(insee.alias("insee"), small.section_key(section).alias("section"), small.number_key(number).alias("numero"))


def in_order(parcels: Column) -> Column:
    """Parcels by commune, section and number: a number of more digits comes later, whatever it begins with."""
    keyed = F.transform(parcels, lambda x: F.struct(x["insee"].alias("insee"), x["section"].alias("section"), F.length(x["numero"]).alias("digits"), x["numero"].alias("numero"), x.alias("parcel")))
    return F.transform(F.array_sort(keyed), lambda x: x["parcel"])


def direct_children(parcels: DataFrame, edges: DataFrame) -> DataFrame:
    """Parcels (query_id, insee, section, numero) with ``children``, those of one operation, in order; none for an unknown parcel."""
    own = parcels.withColumn("parent", parcel_key(F.col("insee"), F.col("section"), F.col("numero")))
    kids = own.select("query_id", "parent").join(edges, "parent").groupBy("query_id").agg(in_order(F.collect_set("child")).alias("children"))
    return parcels.join(kids, "query_id", "left")


def replacement(leaves: DataFrame, key: str = "query_id") -> DataFrame:
    """Of each query's leaves in order: the first one's section, and the numbers of its leaves in that section, joined."""
    listed = leaves.groupBy(key).agg(in_order(F.collect_set("leaf")).alias("_l")).withColumn("section", F.col("_l")[0]["section"])
    same = F.filter("_l", lambda x: x["section"] == F.col("section"))
    return listed.select(key, "section", F.array_join(F.transform(same, lambda x: x["numero"]), ", ").alias("parcelles"))


def located(records: DataFrame, parcels: DataFrame, leaves: DataFrame, communes: DataFrame) -> DataFrame:
    """Records (doc_id, parcel) with lat, lon and ``place``: of the parcel itself; of the first of its leaves that has one (filiation); the mean of
    its section's parcels; of its commune; else the default place. parcels: parcel, lat, lon; communes: insee, lat, lon.
    """
    at = parcels.select("parcel", F.struct("lat", "lon").alias("_p")).filter("_p.lat is not null and _p.lon is not null")
    own = records.join(at, "parcel", "left")
    of_leaves = leaves.select(F.col("seed").alias("parcel"), "leaf").join(at.select(F.col("parcel").alias("leaf"), F.col("_p").alias("_f")), "leaf").groupBy("parcel").agg(F.min_by("_f", "leaf").alias("_f"))
    section = at.groupBy(F.col("parcel.insee").alias("_i"), F.col("parcel.section").alias("_s")).agg(F.struct(F.avg("_p.lat").alias("lat"), F.avg("_p.lon").alias("lon")).alias("_m"))
    town = communes.select(F.col("insee").alias("_t"), F.struct("lat", "lon").alias("_c"))
    out = own.join(of_leaves, "parcel", "left")
    out = out.join(section, (F.col("parcel.insee") == F.col("_i")) & (F.col("parcel.section") == F.col("_s")), "left").join(town, F.col("parcel.insee") == F.col("_t"), "left")
    default = F.struct(F.lit(DEFAULT_PLACE[0]).alias("lat"), F.lit(DEFAULT_PLACE[1]).alias("lon"))
    found = F.coalesce("_p", "_f", "_m", "_c", default)
    kind = F.when(F.col("_p").isNotNull(), "parcel").when(F.col("_f").isNotNull(), "filiation").when(F.col("_m").isNotNull(), "section").otherwise("commune")
    return out.select(*records.columns, found["lat"].alias("lat"), found["lon"].alias("lon"), kind.alias("place"))


def chosen_parcel(rows: DataFrame) -> DataFrame:
    """Rows (clicked, child structs of section and numero; section, numero) with final_section and final_numero: of the parcel under the click (two and
    four signs), else of the first child, else as typed.
    """
    clicked = F.col("clicked.section").isNotNull() & F.col("clicked.numero").isNotNull()
    section = F.when(clicked, X.zero_filled("clicked.section", 2)).otherwise(F.coalesce(X.zero_filled("child.section", 2), "section"))
    number = F.when(clicked, X.zero_filled("clicked.numero", 4)).otherwise(F.coalesce("child.numero", "numero"))
    return rows.withColumns({"final_section": section, "final_numero": number})
