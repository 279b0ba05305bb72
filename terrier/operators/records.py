"""Relational operators on records: lines, votes, merges, lookups, rules, lineage, review, payloads.

Every operator takes and returns DataFrames and is lazy, but for the lineage walk, which is a loop of at most eleven
levels over tables in the shared folder, and with_places, which stores the ranged rows there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as X
from .shared import remove, stored

#: Reference tables are broadcast up to so many rows (counted).
BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it was counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


# -- aggregation -----------------------------------------------------------------------------------------------------


def lines_from_words(words: DataFrame, keys: list[str], order: str, text: str, boxes: tuple[str, str, str, str], conf: str) -> DataFrame:
    """A1: the words of a line in order, joined by spaces; the box around them; the confidence's mean, cut to an integer."""
    left, top, right, bottom = boxes
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda s: s["t"]), " ")
    return words.groupBy(*keys).agg(joined.alias("line"), F.min(left).alias("x0"), F.min(top).alias("y0"), F.max(right).alias("x1"), F.max(bottom).alias("y1"), F.floor(F.avg(conf)).cast("long").alias("conf"))


def sole_owners(forms: DataFrame, form: str, owner: str) -> DataFrame:
    """A2: forms that exactly one owner has."""
    return forms.groupBy(form).agg(F.min(owner).alias(owner), F.max(owner).alias("_m")).filter(F.col(owner) == F.col("_m")).drop("_m")


def keyword_class(df: DataFrame, text: str, kinds: dict[str, tuple[str, ...]], unknown: str = "Type Inconnu", bonus: dict[str, Column] | None = None) -> DataFrame:
    """The kind with most keywords found (``bonus``: points that a kind has besides); the first of several; ``unknown`` if there are none."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    more = bonus or {}
    scores = [sum((low.contains(w).cast("int") for w in ws), F.lit(0)) + F.coalesce(more.get(kind, F.lit(0)), F.lit(0)).cast("int") for kind, ws in kinds.items()]
    best = F.greatest(*scores)
    label = reduce(lambda acc, x: acc.when(x[1] == best, x[0]), list(zip(kinds, scores, strict=True)), F.when(best == 0, unknown))
    return df.withColumns({"kind": label, "hits": best})


#: Kinds of document and the words that count for each, in order.
DOCUMENT_KINDS = {
    "Document d'Arpentage (DMPC)": ("arpentage", "dmpc", "chemise verte", "division", "document de modification", "arpentage"),
    "Plan de Bornage": ("bornage", "reconnaissance", "limites", "amiable", "pv", "procès-verbal", "borné ce jour", "reconnaissance de limites"),
    "Plan Topographique": ("topographique", "etat des lieux", "releve", "courbes de niveau", "levé topographique"),
    "Plan de Division": ("division", "lotissement", "création de lots"),
}


def document_class(df: DataFrame, text: str, order_number: str, dossier: str) -> DataFrame:
    """A8 over DOCUMENT_KINDS: a document whose order number was found, or whose dossier says dmpc, has two points more as a survey act for each."""
    act = F.when(F.coalesce(F.col(order_number), F.lit("Inconnu")) != "Inconnu", 2).otherwise(0) + F.when(F.lower(F.coalesce(dossier, F.lit(""))).contains("dmpc"), 2).otherwise(0)
    return keyword_class(df, text, DOCUMENT_KINDS, bonus={"Document d'Arpentage (DMPC)": act})


def vote(candidates: DataFrame, keys: list[str], value: str, confidence: str) -> DataFrame:
    """A10: values that agree but for case are one; the one with most votes wins, then the most confident, then the first by text."""
    votes = candidates.withColumn("_v", F.lower(value)).groupBy(*keys, "_v").agg(F.count("*").alias("votes"), F.max(confidence).alias("best"))
    first = F.min(F.struct((-F.col("votes")).alias("votes"), (-F.col("best")).alias("best"), F.col("_v").alias("value")))
    return votes.groupBy(*keys).agg(first.alias("_p")).select(*keys, "_p.value", (-F.col("_p.votes")).alias("votes"), (-F.col("_p.best")).alias("best"))


def merge_pages(fields: DataFrame, keys: list[str], page: str, field: str, value: str, last_wins: tuple[str, ...] = ("date",)) -> DataFrame:
    """Each field's first value that isn't empty, by page; for some fields the last."""
    full = fields.filter(F.col(value).isNotNull() & (F.trim(value) != ""))
    return full.groupBy(*keys, field).agg(F.when(F.col(field).isin(*last_wins), F.max_by(value, page)).otherwise(F.min_by(value, page)).alias(value))


# -- lookups ---------------------------------------------------------------------------------------------------------


def code_map(df: DataFrame, code: str, table: dict[str, str], label: str = "label") -> DataFrame:
    """Exact code, else upper-case code, else ''."""
    dim = F.broadcast(dims.two_columns(df.sparkSession, table, "_code", "_label"))
    exact = dim.withColumnsRenamed({"_code": "_c1", "_label": "_l1"})
    upper = dim.withColumnsRenamed({"_code": "_c2", "_label": "_l2"})
    out = df.join(exact, F.col(code) == F.col("_c1"), "left").join(upper, F.upper(F.trim(code)) == F.col("_c2"), "left")
    return out.withColumn(label, F.coalesce("_l1", "_l2", F.lit(""))).drop("_c1", "_l1", "_c2", "_l2")


def exact_or_prefix(probes: DataFrame, names: DataFrame, probe: str, name: str, least: int = 4) -> DataFrame:
    """J4 steps 1 and 2: the equal name, else the only name that the probe (``least`` characters or more) begins."""
    key = F.substring(F.col(name), 1, least)
    own = names.select(F.col(name).alias("_name"), key.alias("_key")).distinct()
    exact = probes.join(own.select("_name"), F.col(probe) == F.col("_name"), "left")
    todo = exact.filter("_name is null").drop("_name").filter(F.length(probe) >= least).select(probe).distinct()
    hits = todo.join(own, (F.substring(F.col(probe), 1, least) == F.col("_key")) & F.col("_name").startswith(F.col(probe)))
    only = hits.groupBy(probe).agg(F.min("_name").alias("_prefix"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return exact.join(only, probe, "left").withColumns({"matched": F.coalesce("_name", "_prefix"), "method": F.when(F.col("_name").isNotNull(), "exact").when(F.col("_prefix").isNotNull(), "prefix")}).drop("_name", "_prefix")


def filter_if_any(rows: DataFrame, query: list[str], predicate: Column) -> DataFrame:
    """Of each query's rows those that meet the predicate, or all if none does."""
    own = rows.withColumn("_p", F.coalesce(predicate, F.lit(False)))
    return own.withColumn("_any", F.max("_p").over(W.partitionBy(*query))).filter(F.col("_p") | ~F.col("_any")).drop("_p", "_any")


def cascade(rows: DataFrame, query: list[str], steps: list[Column], score: Column | None = None, least: float = 60.0, unique: bool = True, count: str | None = None) -> DataFrame:
    """Filter, score and status steps of J12-J15, on pairs already joined (their fuzzy commune step is not built): filters one after the other, each ignored where it would leave nothing; then, where several rows are left,
    those at the largest score if that reaches ``least``; each row gets its query's status. ``count``: a row stands for so many.
    """
    for step in steps:
        rows = filter_if_any(rows, query, step)
    w = W.partitionBy(*query)
    size = F.sum(count) if count else F.count("*")
    if score is not None:
        rows = rows.withColumns({"_s": score, "_n": size.over(w)}).withColumn("_top", F.max("_s").over(w))
        rows = rows.filter((F.col("_n") == 1) | F.col("_top").isNull() | (F.col("_top") < least) | (F.col("_s") == F.col("_top"))).drop("_s", "_n", "_top")
    n = size.over(w)
    return rows.withColumn("status", F.when((n == 1) & F.lit(unique), "MATCH_UNIQUE").otherwise("CANDIDATS"))


def with_unmatched(queries: DataFrame, found: DataFrame, query: list[str]) -> DataFrame:
    """found and, for queries without a row, one row of status NO_MATCH."""
    none = queries.select(*query).distinct().join(found.select(*query).distinct(), query, "left_anti").withColumn("status", F.lit("NO_MATCH"))
    return found.unionByName(none, allowMissingColumns=True)


def append_missing(own: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Own and those rows of other whose key it lacks."""
    return own.unionByName(other.join(own.select(key).distinct(), key, "left_anti").select(*own.columns))


# -- rules -----------------------------------------------------------------------------------------------------------


Rules = list[tuple[str, str, Column, list[str]]]


def _held(rules: Rules) -> Column:
    """The rules (rule, level, fields) of a row that hold, in order; of equal rule and fields the first, which is known before any row is read."""
    made, earlier = [], {}
    for name, level, condition, fields in rules:
        key, holds = (name, ",".join(sorted(fields))), F.coalesce(condition, F.lit(False))
        first = holds
        for other in earlier.get(key, []):
            first = first & ~other
        earlier.setdefault(key, []).append(holds)
        made.append(F.when(first, F.struct(F.lit(name).alias("rule"), F.lit(key[1]).alias("fields"), F.lit(level).alias("level"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def issues(df: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """A5: one row per row of df and rule (name, level, condition, fields) that holds; of equal rule and fields the first. No exchange."""
    return df.select(*keys, F.explode(_held(rules)).alias("_i")).select(*keys, "_i.rule", "_i.fields", "_i.level").select(*keys, "rule", "level", "fields")


def _scored(counted: DataFrame) -> DataFrame:
    score = F.bround(F.greatest(F.lit(0.0), 1.0 - 0.25 * F.col("errors") - 0.08 * F.col("alerts")), 2)
    return counted.withColumns({"score": score, "status": F.when(F.col("errors") > 0, "REJET").when(F.col("alerts") > 0, "ALERTE").otherwise("CONFORME")})


def scored(df: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """A5 and A6 of documents of a row each, counted within the row: keys, errors, alerts, infos, score, status."""
    own = df.select(*keys, _held(rules).alias("_i"))
    n = lambda level: F.size(F.filter("_i", lambda x: x["level"] == level)).cast("long")
    return _scored(own.select(*keys, n("ERREUR").alias("errors"), n("ALERTE").alias("alerts"), n("INFO").alias("infos")))


def coherence(docs: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A6 of issues that come from elsewhere: counts by level, score 1 - 0.25 errors - 0.08 alerts (0 at least, two decimals), status."""
    n = lambda level: F.count(F.when(F.col("level") == level, 1))
    counts = found.groupBy(*keys).agg(n("ERREUR").alias("errors"), n("ALERTE").alias("alerts"), n("INFO").alias("infos"))
    return _scored(docs.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["errors", "alerts", "infos"]))


def plan_rules() -> list[tuple[str, str, Column, list[str]]]:
    """V1-V8, F9, over the columns date, n_ordre, n_dossier, section, commune, anciens, nouveaux, geometre, echelle, type_plan."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    has = lambda c: t(c) != ""
    year = F.regexp_extract(t("date"), r"\b(\d{4})\b", 1)
    year = F.when(year != "", year.cast("int"))
    dossier = X.dossier_year(F.when(has("n_ordre"), t("n_ordre")).otherwise(t("n_dossier")))
    scale = F.regexp_extract(F.regexp_replace(t("echelle"), " ", ""), r"(\d{3,5})", 1)
    scale = F.when(scale != "", scale.cast("int"))
    proper = F.exists(F.split(t("geometre"), r"\s+"), lambda w: w.rlike("^[A-ZÀ-Ý][a-zà-ÿ]{2,}$"))
    return [
        ("DATE_HORS_PLAGE", "ERREUR", ~year.between(1900, 2030), ["date"]),
        ("DATE_FORMAT_INCONNU", "ALERTE", has("date") & year.isNull(), ["date"]),
        ("DATE_DOSSIER_INCOHERENCE", "ERREUR", year < dossier, ["date", "n_ordre"]),
        ("DATE_DOSSIER_ECART", "ALERTE", year > dossier + 3, ["date", "n_ordre"]),
        ("SECTION_SANS_COMMUNE", "ALERTE", has("section") & ~has("commune"), ["section", "commune"]),
        ("PROP_ANC_NOUV_IDENTIQUES", "ALERTE", has("nouveaux") & (F.length(t("anciens")) > 5) & (X.loose_key(t("anciens")) == X.loose_key(t("nouveaux"))), ["anciens", "nouveaux"]),
        ("GEOMETRE_TROP_COURT", "ALERTE", has("geometre") & (F.length(t("geometre")) < 5), ["geometre"]),
        ("GEOMETRE_SUSPECT", "ALERTE", (F.length(t("geometre")) >= 5) & (F.size(F.split(t("geometre"), r"\s+")) >= 3) & ~proper, ["geometre"]),
        ("ECHELLE_HORS_NORME", "ALERTE", ~scale.between(200, 10000), ["echelle"]),
        ("DOSSIER_FORMAT_INATTENDU", "INFO", (t("type_plan") == "DMPC") & F.upper(t("n_ordre")).rlike(r"^\d{1,5}[A-Z]$"), ["n_ordre"]),
        ("SECTION_CHIFFRES_SEULEMENT", "ALERTE", t("type_plan").isin("PVa", "PLa") & t("section").rlike(r"^\d+$"), ["section"]),
    ]


# -- lineage ---------------------------------------------------------------------------------------------------------


def lineage_edges(lines: DataFrame) -> DataFrame:
    """G1: edges from each mother to each daughter of an operation (insee, document, sequence), from ';' lines of 11 parts or more."""
    p = lines.select(F.split("value", ";").alias("p")).filter(F.size("p") >= 11)
    part = lambda i: F.trim(F.element_at("p", i + 1))
    parcels = p.select(X.insee(part(0), part(1)).alias("insee"), part(3).alias("doc"), part(8).alias("seq"), part(9).alias("kind"), F.explode(F.slice("p", F.lit(11), F.size("p"))).alias("raw"))
    parcels = parcels.withColumn("x", X.parcel_parts("raw")).filter("x is not null").select("insee", "doc", "seq", "kind", "x.section", "x.numero").distinct()
    side = lambda kind, name: parcels.filter(F.col("kind") == kind).select("insee", "doc", "seq", F.struct("insee", "section", "numero").alias(name))
    return side("1", "parent").join(side("2", "child"), ["insee", "doc", "seq"]).select("parent", "child").distinct()


def leaves(seeds: DataFrame, edges: DataFrame, depth: int = 10) -> DataFrame:
    """(seed, leaf): the parcels without children that each seed reaches in at most ``depth`` steps; an unknown seed is
    its own leaf, and a cycle has none. Walked from the leaves up, so that a parcel is paired with its leaves and not with all that lies between;
    breadth first, so a pair is met at its smallest depth, and only new pairs go on. Levels are tables in the shared folder, deleted at the end.
    """
    edges = stored(edges.select(F.col("parent").alias("node"), "child"), "edges")
    parents = edges.select("node").distinct()
    level = stored(edges.select(F.col("child").alias("node")).distinct().join(parents, "node", "left_anti").select("node", F.col("node").alias("leaf")), "level")
    seen, levels = level, [level]
    for _ in range(depth):
        up = edges.join(level.withColumnRenamed("node", "child"), "child").select("node", "leaf").distinct()
        level = stored(up.join(seen, ["node", "leaf"], "left_anti"), "level")
        levels.append(level)
        if not level.take(1):
            break
        seen = seen.unionByName(level)
    own = seeds.select(F.col("seed").alias("node")).distinct()
    known, alone = own.join(parents, "node", "left_semi"), own.join(parents, "node", "left_anti")
    found = known.join(seen, "node").unionByName(alone.select("node", F.col("node").alias("leaf")))
    out = stored(found.select(F.col("node").alias("seed"), "leaf"), "leaves")
    remove(edges, *levels)
    return out


# -- order ----------------------------------------------------------------------------------------------------------


def with_places(rows: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """All rows with their place (from 1) in the order. The rows are ranged by it and stored; a row's place is
    its number in its range plus the rows of the ranges before, so no task sees more than a range.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part").join(F.broadcast(sizes.select(F.col("_part").alias("_q"), "_n")), F.col("_q") < F.col("_part"), "left").groupBy("_part").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(place, (own + F.col("_before")).cast("long")).drop("_part", "_before")


# -- spatial ---------------------------------------------------------------------------------------------------------


def nearest_values(labels: DataFrame, blocks: DataFrame, page: list[str], width: Column, height: Column, own: list[str] | None = None, carried: list[str] | None = None, every: bool = False) -> DataFrame:
    """Each label's value block on its page: on the same line to the right (overlap 40 %, gap up to 60 % of the width,
    smallest gap); else below with 30 % overlap (gap up to 15 % of the height, gap + half the shift); else below anywhere (gap + twice
    the shift). Ties go to the smaller block id. Boxes are l_x0.. and x0..; ids label_id and block_id. ``own``: further keys of a label;
    ``carried``: columns of the value block that come along, in the struct b; ``every``: labels without a value block, too, their b is null.
    """
    others = blocks.withColumnsRenamed({c: f"_p_{c}" for c in page})
    overlap = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.least(F.col(a1), F.col(b1)) - F.greatest(F.col(a0), F.col(b0)))
    gap_x, gap_y = F.col("x0") - F.col("l_x1"), F.col("y0") - F.col("l_y1")
    shift = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("l_x0") + F.col("l_x1")) / 2)
    same = overlap("l_y0", "l_y1", "y0", "y1") >= 0.4 * F.least(F.col("l_y1") - F.col("l_y0"), F.col("y1") - F.col("y0"))
    near = (gap_y >= 0) & (gap_y <= 0.15 * height)
    under = overlap("l_x0", "l_x1", "x0", "x1") >= 0.3 * F.least(F.col("l_x1") - F.col("l_x0"), F.col("x1") - F.col("x0"))
    tier = F.when(same & (gap_x >= 0) & (gap_x <= 0.6 * width), 1).when(near & under, 2).when(near, 3)
    score = F.when(tier == 1, gap_x).when(tier == 2, gap_y + 0.5 * shift).otherwise(gap_y + 2 * shift)
    order = F.struct(tier.alias("tier"), score.alias("score"), "block_id", *(carried or []))
    on = (F.col("block_id") != F.col("label_block")) & tier.isNotNull()
    for c in page:
        on = on & (F.col(c) == F.col(f"_p_{c}"))
    pairs = labels.join(others, on, "left" if every else "inner")
    best = pairs.groupBy(*page, "label_id", *(own or [])).agg(F.min(F.when(F.col("block_id").isNotNull(), order)).alias("b"))
    return best if carried else best.select(*page, "label_id", *(own or []), "b.block_id", "b.tier")


def in_zone(x0: str, y0: str, x1: str, y1: str, width: Column, height: Column, zone: tuple[float, float, float, float]) -> Column:
    """the box's centre lies in a zone of page fractions, borders included."""
    cx, cy = (F.col(x0) + F.col(x1)) / 2 / width, (F.col(y0) + F.col(y1)) / 2 / height
    return cx.between(zone[0], zone[2]) & cy.between(zone[1], zone[3])


# -- review and publication ------------------------------------------------------------------------------------------


def overlay(rows: DataFrame, edits: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """The last edit of each key replaces the column's value."""
    last = edits.groupBy(key).agg(F.max_by("new_value", order).alias("_new"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


#: The fields whose corrections are learned.
LEARNED_FIELDS = ("Geometre", "Commune", "Section", "Indication", "Nature_Acte_Geofoncier", "Signataires")


def learn_corrections(log: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """Of each (field, normalised reading) the last correction and how often one was made; readings of three signs or more, that the
    correction changes. ``fields``: only these (LEARNED_FIELDS in the review).
    """
    keyed = log.withColumn("ocr_norm", X.learned_key("ocr_value")).filter((F.length("ocr_norm") >= 3) & (F.trim("correction") != "") & (F.col("ocr_norm") != X.learned_key("correction")))
    own = keyed.filter(F.col("field").isin(*fields)) if fields else keyed
    return own.groupBy("field", "ocr_norm").agg(F.max_by("correction", "ts").alias("correction"), F.count("*").alias("count"))


def payload(records: DataFrame, holder: str = "", surveyor: str = "", firms: dict[str, str] | None = None, as_of: Column | None = None) -> DataFrame:
    """doc_id, payload (the JSON that the publication service takes) and status, of ref_dossier, geometre, commune, code_insee,
    date_dossier, annee_full, enr_statut, section, parcelles, n_ordre, op_code (array), lat and lon.

    ``firms``: the creating firm of each surveyor, else ``holder``; the last five signs of the firm name its surveyor, else
    ``surveyor``. Empty lists are left out. Without a reference there is no payload. ``as_of`` dates records without a date.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in (firms or {"": ""}).items() for x in kv]), F.upper(text("geometre")))
    firm = F.coalesce(F.when(named != "", named), F.lit(holder))
    reference = F.translate(F.substring(text("ref_dossier"), 1, 15), " ", "_")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in dims.STATUS_CODES.items() for x in kv]), F.coalesce(F.col("enr_statut"), F.lit("Achevé")))
    east, north = X.lambert93("lat", "lon")
    place = F.struct(F.round(east, 2).alias("loc_coord_est"), F.round(north, 2).alias("loc_coord_nord"))
    act = F.when(F.lower(text("n_ordre")).isin("nan", "none", ""), None).otherwise(X.act_number("n_ordre", text("code_insee")))
    some = lambda a: F.when(F.size(a) > 0, a)
    body = F.struct(
        firm.alias("enr_cab_createur"), reference.alias("enr_ref_dossier"), F.lit(holder).alias("enr_cab_detenteur"),
        F.when(F.length(firm) >= 5, F.substring(firm, -5, 5)).otherwise(surveyor).alias("enr_ge_createur"), text("code_insee").alias("enr_code_insee"),
        X.iso_date("date_dossier", "annee_full", as_of).alias("enr_date_dossier"), F.coalesce("op_code", F.array().cast("array<string>")).alias("op_code"), F.lit(False).alias("enr_visible"),
        F.coalesce(known, F.lit("achevé")).alias("enr_statut"), F.concat(F.lit("Archive importée automatiquement. Commune: "), text("commune")).alias("enr_memo"),
        some(X.format_cadastre("section", "parcelles")).alias("cadastre"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.array(place)).alias("localisant"),
        some(F.filter(F.array(act), lambda x: x.isNotNull())).alias("dmpc_ref"),
    )
    ok = reference != ""
    return records.select("doc_id", F.when(ok, F.to_json(body)).alias("payload"), F.when(ok, "OK").otherwise("ECHEC - ref_dossier manquante").alias("status"))
