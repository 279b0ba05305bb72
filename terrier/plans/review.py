"""Checks, review, files, lineage and places over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import small
from ..functions import text as X
from ..operators import records as R
from ..operators import review as V
from ..operators import search as P3
from ..operators.registers import edit_score
from .base import query, table


def _pick(key, n, values):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % n).cast("int"))


#: Six documents that break the rules in different ways, by the order's key.
_DOCS = {
    "date": ("12/03/1899", "sans annee", "14/10/1997", "2005", "14/10/1997", "01/01/2001"),
    "n_ordre": ("A09032", "", "A99001", "12A", "677J", ""),
    "n_dossier": ("", "A00-1", "", "", "", ""),
    "section": ("AB", "12", "B", "A B C", "C", ""),
    "commune": ("Nation 1", "", "Natio 2", "ailleurs", "NATION_3", "Nation 4"),
    "anciens": ("M. Roche", "", "Mme Élan", "x", "", ""),
    "nouveaux": ("m roche", "", "MME ELAN", "x", "", ""),
    "geometre": ("Privas", "Rac", "PLAN DU BUREAU", "M. Jean Roche expert", "Racat", ""),
    "echelle": ("1/100", "1/1000", "1/25000", "", "1/2 500", ""),
    "type_plan": ("DMPC", "PVa", "PLa", "DMPC", "DMPC", "PVa"),
}
_RULES = """(0, 'DATE_HORS_PLAGE', 'ERREUR', 'date'), (0, 'DATE_DOSSIER_INCOHERENCE', 'ERREUR', 'date,n_ordre'), (0, 'GEOMETRE_EST_VILLE', 'ERREUR', 'geometre'), (0, 'ECHELLE_HORS_NORME', 'ALERTE', 'echelle'), (0, 'PYDANTIC_VALUE_ERROR', 'ALERTE', 'echelle'),
(1, 'DATE_FORMAT_INCONNU', 'ALERTE', 'date'), (1, 'SECTION_SANS_COMMUNE', 'ALERTE', 'commune,section'), (1, 'GEOMETRE_TROP_COURT', 'ALERTE', 'geometre'), (1, 'SECTION_CHIFFRES_SEULEMENT', 'ALERTE', 'section'), (1, 'PYDANTIC_VALUE_ERROR', 'ALERTE', 'date'), (1, 'PYDANTIC_VALUE_ERROR', 'ALERTE', 'section'),
(2, 'DATE_DOSSIER_INCOHERENCE', 'ERREUR', 'date,n_ordre'), (2, 'PROP_ANC_NOUV_IDENTIQUES', 'ALERTE', 'anciens,nouveaux'), (2, 'GEOMETRE_SUSPECT', 'ALERTE', 'geometre'), (2, 'ECHELLE_HORS_NORME', 'ALERTE', 'echelle'), (2, 'PYDANTIC_VALUE_ERROR', 'ALERTE', 'echelle'),
(3, 'DOSSIER_FORMAT_INATTENDU', 'INFO', 'n_ordre'), (3, 'PYDANTIC_VALUE_ERROR', 'ALERTE', 'section'), (4, 'DOSSIER_FORMAT_INATTENDU', 'INFO', 'n_ordre')"""
#: What the knowledge base says of nations 1 to 4, with sections, prefixes and kinds.
_KNOWN = """(0, 'SECTION_INCONNUE_COMMUNE', 'ALERTE', 'commune,section'), (0, 'TYPE_PLAN_RARE_COMMUNE', 'INFO', 'commune'), (2, 'DOSSIER_PREFIXE_NOUVEAU', 'INFO', 'n_ordre'), (2, 'TYPE_PLAN_RARE_COMMUNE', 'INFO', 'commune'),
(3, 'COMMUNE_ABSENTE_KB', 'INFO', 'commune'), (4, 'TYPE_PLAN_RARE_COMMUNE', 'INFO', 'commune')"""


def _documents(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return o.select("o_orderkey", *[_pick(F.col("o_orderkey"), 6, v).alias(c) for c, v in _DOCS.items()])


@query(f"SELECT o_orderkey, rule, level, fields FROM orders JOIN (VALUES {_RULES}) r(i, rule, level, fields) ON o_orderkey % 6 = i")
def document_rules(spark, d):
    """V1-V9, V15, K15, K16, A5 over fixture documents."""
    return V.checked(_documents(spark, d), ["o_orderkey"]).select("o_orderkey", "rule", "level", "fields")


@query(f"""SELECT o_orderkey, rule, level, fields FROM orders JOIN (VALUES {_RULES}, {_KNOWN}) r(i, rule, level, fields) ON o_orderkey % 6 = i""")
def knowledge_base_rules(spark, d):
    """The communes' keys are the nations' names; one is misread by a letter."""
    n = table(spark, d, "nation").filter(F.col("n_nationkey").between(1, 4))  # the fixture's knowledge base has four communes
    none = F.array().cast("array<string>")
    kb = n.select(F.col("n_name").alias("commune"), F.when(F.col("n_nationkey") == 1, F.array(F.lit("c"))).otherwise(none).alias("sections_connues"), F.when(F.col("n_nationkey") == 2, F.array(F.lit("A98"))).otherwise(none).alias("prefixes_dossier"), F.when(F.col("n_nationkey") == 4, none).otherwise(F.array(F.lit("Esquisse"))).alias("types_plans_frequents"))
    return V.checked(_documents(spark, d), ["o_orderkey"], kb, edit_score).select("o_orderkey", "rule", "level", "fields")


@query(f"""WITH i AS (SELECT o_orderkey, rule, level, fields FROM orders JOIN (VALUES {_RULES}) r(i, rule, level, fields) ON o_orderkey % 6 = i), u AS (SELECT level, rule, unnest(string_split(fields, ',')) AS fields FROM i)
SELECT level, fields, count(*) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM u GROUP BY 1, 2""")
def rules_by_field(spark, d):
    """A7."""
    found = V.checked(_documents(spark, d), ["o_orderkey"])
    return V.issues_by_field(found).select("level", "fields", "n", F.array_join("rules", ",").alias("rules"))


@query(f"""WITH i AS (SELECT o_orderkey, level FROM orders JOIN (VALUES {_RULES}) r(i, rule, level, fields) ON o_orderkey % 6 = i), c AS (SELECT o_orderkey, count(*) FILTER (level = 'ERREUR') AS e, count(*) FILTER (level = 'ALERTE') AS a, count(*) FILTER (level = 'INFO') AS f FROM orders LEFT JOIN i USING (o_orderkey) GROUP BY 1)
SELECT o_orderkey, CASE WHEN e + a + f = 0 THEN 'Aucune anomalie' ELSE concat_ws(', ', CASE WHEN e > 0 THEN e || ' erreur(s)' END, CASE WHEN a > 0 THEN a || ' alerte(s)' END, CASE WHEN f > 0 THEN f || ' info(s)' END) END AS summary FROM c""")
def document_summary(spark, d):
    """A6."""
    docs = _documents(spark, d)
    return V.summary(R.coherence(docs, V.checked(docs, ["o_orderkey"]), ["o_orderkey"])).select("o_orderkey", "summary")


@query("""WITH v(i, col, final, code) AS (VALUES (0, 'Section', 'AB', NULL), (1, 'Date', '12/03/2005', NULL), (2, 'Echelle', '1/1000', NULL), (3, 'Parcelles', '12-15, AB 7, 8', NULL), (4, 'Commune', 'NATION_7', '07007'), (5, 'Commune', 'ailleurs', NULL), (6, 'Indication', ' x ', NULL))
SELECT c_custkey AS doc_id, col AS column, final, code FROM customer JOIN v ON i = c_custkey % 7""")
def edit_buffer(spark, d):
    """T5, C4-C6, D7, J7."""
    k = F.col("c_custkey")
    column = ("Section", "Date", "Echelle", "Parcelles", "Commune", "Commune", "Indication")
    value = ("a.b c", "vers le 12.3.2005 (a)", " 1 : 1000", "12 a 15;AB 7 et 8", "nation 7", "ailleurs", " x ")
    names = table(spark, d, "nation").select(F.col("n_name").alias("officiel"), F.concat(F.lit("07"), X.zero_filled("n_nationkey", 3)).alias("code"), F.col("n_nationkey").alias("pos"))
    edits = table(spark, d, "customer").select(k.alias("doc_id"), _pick(k, 7, column).alias("column"), _pick(k, 7, value).alias("value"))
    return V.edited(edits, names, edit_score).select("doc_id", "column", "final", "code")


@query("""SELECT o_orderkey, '12, 13, ' || (1 + o_orderkey % 50 + 13) || ', 99, 98' AS lu_parcelle, year(o_orderdate) % 100 AS lu_annee, year(o_orderdate) AS rc_annee, year(o_orderdate) AS d_annee FROM orders""")
def search_prefill(spark, d):
    """T5, D1, D10, W11."""
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("12 13").alias("Anciennes_Parcelles"), (1 + F.col("o_orderkey") % 50 + 13).cast("string").alias("Nouvelles_Parcelles"), F.lit("12 99;98 97").alias("Parcelles"), F.date_format("o_orderdate", "d.M.yyyy").alias("Date"))
    out = V.prefills(rows)
    return out.select("o_orderkey", "lu_parcelle", F.col("lu_annee").cast("long").alias("lu_annee"), F.col("rc_annee").cast("long").alias("rc_annee"), F.col("d_annee").cast("long").alias("d_annee"))


@query("""WITH a AS (SELECT user_id AS doc_id, arg_max(event_type, event_id) AS a FROM events GROUP BY 1) SELECT c_custkey AS doc_id, CASE WHEN a = 'click' THEN 'Validé par l''humain' WHEN a = 'error' THEN 'Ignoré (Vide)' WHEN c_custkey % 2 = 0 THEN 'Corrigé automatiquement' ELSE 'À valider' END AS status, coalesce(a IN ('click', 'error'), false) OR c_custkey % 2 = 0 AS done
FROM customer LEFT JOIN a ON doc_id = c_custkey""")
def confirmation_status(spark, d):
    """T6, F4."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "save").when(F.col("event_type") == "error", "ignore").otherwise("open")
    actions = e.select(F.col("user_id").alias("doc_id"), action.alias("action"), F.col("event_id").alias("ts"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, "Corrigé automatiquement").alias("status"))
    return V.confirmed_status(rows, actions, status="status").select("doc_id", "status", "done")


@query("""WITH o AS (SELECT user_id AS commune, value, event_id, row_number() OVER (PARTITION BY user_id, value ORDER BY event_id) AS k FROM events), u AS (SELECT commune, event_id, count(*) OVER (PARTITION BY commune) AS confirmed, row_number() OVER (PARTITION BY commune ORDER BY event_id DESC) AS r FROM o WHERE k = 1)
SELECT commune, event_id, confirmed FROM u WHERE r <= 10""")
def latest_anchors(spark, d):
    """W10, A17."""
    e = table(spark, d, "events").select(F.col("user_id").alias("commune"), F.col("value").alias("ocr_text"), F.col("event_id").alias("ts"))
    return V.recent_anchors(e).select("commune", F.col("ts").alias("event_id"), "confirmed")


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'in/d' || c_custkey || '.PDF' WHEN 1 THEN 'in/d' || c_custkey || '.tif' END AS source, CASE c_custkey % 3 WHEN 0 THEN 'out/d' || c_custkey || '_plan_PVa.json' WHEN 1 THEN 'out/d' || c_custkey || '_plan_DMPC.json' END AS json FROM customer""")
def document_files(spark, d):
    """The image and the result file of each document."""
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(k.alias("id"), F.concat(F.lit("d"), k.cast("string")).alias("base"), F.lit("PVa").alias("type_plan"))
    named = lambda folder, ends: F.explode(F.array(*[F.concat(F.lit(folder), "base", F.lit(x)) for x in ends]))
    kind = F.col("id") % 3
    files = own.filter(kind == 0).select(named("in/", (".jpg", ".PDF")).alias("path")).unionByName(own.filter(kind == 1).select(named("in/", (".tif", ".txt", ".jpg")).alias("path")))
    out = own.filter(kind == 0).select(named("out/", ("_plan_DMPC.json", "_plan_PVa.json")).alias("path")).unionByName(own.filter(kind == 1).select(named("out/", ("_plan_GENERIC.json", "_plan_DMPC.json", "_autre.json")).alias("path")))
    return V.result_files(V.source_documents(own, files), out).select("id", "source", "json")


_EDGES = """SELECT p.c_custkey AS parent, c.c_custkey AS child FROM customer p JOIN customer c ON p.c_custkey > 0 AND c.c_custkey // 3 = p.c_custkey AND c.c_custkey % 3 < 2"""
_FOUR = "CASE WHEN {0} < 1000 THEN lpad(CAST({0} AS VARCHAR), 4, '0') ELSE CAST({0} AS VARCHAR) END"


def _parcel(number):
    return F.struct(F.lit("07001").alias("insee"), F.lit("A").alias("section"), X.zero_filled(number, 4).alias("numero"))


def _edges(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    kids = c.filter("k % 3 < 2 and k >= 3")
    return kids.select(_parcel(F.floor(F.col("k") / 3)).alias("parent"), _parcel(F.col("k")).alias("child"))


@query(f"""WITH e AS ({_EDGES}), k AS (SELECT parent, string_agg({_FOUR.format('child')}, ',' ORDER BY child) AS children FROM e GROUP BY 1) SELECT c_custkey AS query_id, children FROM customer LEFT JOIN k ON parent = c_custkey""")
def direct_children(spark, d):
    """Each parcel's daughters, asked for with a zero before the section."""
    parcels = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.lit("07001").alias("insee"), F.lit(" 0a").alias("section"), F.col("c_custkey").cast("string").alias("numero"))
    out = V.direct_children(parcels, _edges(spark, d))
    return out.select("query_id", F.array_join(F.transform("children", lambda x: x["numero"]), ",").alias("children"))


@query(f"""WITH e AS ({_EDGES}), k AS (SELECT parent AS query_id, string_agg({_FOUR.format('child')}, ', ' ORDER BY child) AS parcelles FROM e GROUP BY 1) SELECT query_id, 'A' AS section, parcelles FROM k""")
def lineage_replacement(spark, d):
    """The daughters stand in for a parcel that is gone."""
    e = _edges(spark, d).select(F.col("parent.numero").cast("long").alias("query_id"), F.col("child").alias("leaf"))
    return V.replacement(e)


@query("""WITH p AS (SELECT c_custkey, c_acctbal AS lat, c_acctbal / 2 AS lon, 's' || c_nationkey % 20 AS section, CASE WHEN c_nationkey % 20 < 10 THEN 'x' ELSE 'y' END AS insee, c_custkey % 5 = 0 AS has FROM customer), s AS (SELECT insee, section, avg(lat) AS lat, avg(lon) AS lon FROM p WHERE has GROUP BY 1, 2),
f AS (SELECT p.c_custkey, arg_min(q.lat, q.c_custkey) AS lat, arg_min(q.lon, q.c_custkey) AS lon FROM p JOIN p q ON q.c_custkey IN (p.c_custkey + 3, p.c_custkey + 4) AND q.has WHERE p.c_custkey % 2 = 0 GROUP BY 1)
SELECT p.c_custkey AS doc_id, round(CASE WHEN has THEN p.lat ELSE coalesce(f.lat, s.lat, CASE p.insee WHEN 'x' THEN 1.5 END, 44.7356) END, 6)::DOUBLE AS lat, round(CASE WHEN has THEN p.lon ELSE coalesce(f.lon, s.lon, CASE p.insee WHEN 'x' THEN 2.5 END, 4.5990) END, 6)::DOUBLE AS lon,
CASE WHEN has THEN 'parcel' WHEN f.lat IS NOT NULL THEN 'filiation' WHEN s.lat IS NOT NULL THEN 'section' ELSE 'commune' END AS place FROM p LEFT JOIN f USING (c_custkey) LEFT JOIN s ON s.insee = p.insee AND s.section = p.section""")
def located_records(spark, d):
    """G5, M11."""
    k = F.col("c_custkey")
    part = F.col("c_nationkey") % 20
    key = F.struct(F.when(part < 10, "x").otherwise("y").alias("insee"), F.concat(F.lit("s"), part.cast("string")).alias("section"), X.zero_filled(k, 9).alias("numero"))
    own = table(spark, d, "customer").select(k.alias("doc_id"), key.alias("parcel"), F.col("c_acctbal").alias("lat"), (F.col("c_acctbal") / 2).alias("lon"))
    known = own.filter("doc_id % 5 = 0").select("parcel", "lat", "lon")
    later = own.select((F.col("doc_id")).alias("_id"), F.col("parcel").alias("leaf"))
    seeds = own.filter("doc_id % 2 = 0").select(F.col("parcel").alias("seed"), F.explode(F.array(F.col("doc_id") + 3, F.col("doc_id") + 4)).alias("_id"))
    towns = spark.createDataFrame([("x", 1.5, 2.5)], "insee string, lat double, lon double")
    out = V.located(own.select("doc_id", "parcel"), known, seeds.join(later, "_id").drop("_id"), towns)
    return out.select("doc_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "place")


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '0B' WHEN 1 THEN '0C' ELSE 'AB' END AS section, CASE c_custkey % 3 WHEN 0 THEN '0012' WHEN 1 THEN '77' ELSE '5' END AS numero FROM customer""")
def confirmed_parcel(spark, d):
    """K18."""
    k = F.col("c_custkey")
    place = lambda ok, s, n: F.struct(F.when(ok, F.lit(s)).alias("section"), F.when(ok, F.lit(n)).alias("numero"))
    rows = table(spark, d, "customer").select(k.alias("id"), place(k % 3 == 0, "B", "12").alias("clicked"), place(k % 3 == 1, "C", "77").alias("child"), F.lit("AB").alias("section"), F.lit("5").alias("numero"))
    return V.chosen_parcel(rows).select("id", F.col("final_section").alias("section"), F.col("final_numero").alias("numero"))


@query("""SELECT o_orderkey, round(o_totalprice / 2 + 1, 6) AS lat, round(o_totalprice + 1, 6) AS lon, o_totalprice AS x0, o_totalprice + 2 AS x1, o_totalprice / 2 + 1 AS cy FROM orders""")
def polygon_centres(spark, d):
    """M10, M12, K14."""
    p = F.col("o_totalprice")
    ring = F.array(*[F.array(p + a, p / 2 + b) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    out = table(spark, d, "orders").select("o_orderkey", small.centroid(F.array(F.array(ring))).alias("c"), small.box(ring).alias("b"))
    return out.select("o_orderkey", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"), "b.x0", "b.x1", "b.cy")


@query("""SELECT o_orderkey, o_orderpriority AS commune FROM orders WHERE o_orderstatus = 'F'""")
def validated_export(spark, d):
    """Validated rows, and of the wanted columns those that there are."""
    from ..sources import tables as T

    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("commune"), F.when(F.col("o_orderstatus") == "F", V.VALIDATED).otherwise(V.WAITING).alias("Confirmation_Status"))
    return T.export_validated(rows, ["o_orderkey", "commune", "absent"])


@query("""SELECT o_orderkey, trim(regexp_replace(regexp_replace(regexp_replace(upper(replace(o_orderpriority, '-', ' ')), '\\bSTE\\b', 'SAINTE', 'g'), '\\bST\\b', 'SAINT', 'g'), '\\s+', ' ', 'g')) AS interface_key, lower(o_orderpriority) AS archive_key, upper(o_orderpriority) AS archive_name, 'SAINT ' || replace(o_orderpriority, '-', ' ') AS match_key FROM orders""")
def other_keys(spark, d):
    """N1, N5, N11."""
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.trim(F.regexp_replace(X.interface_key(p), r"\s+", " ")).alias("interface_key"), X.archive_key(p).alias("archive_key"), X.archive_name(p).alias("archive_name"), X.match_key(F.concat(F.lit("St. "), p)).alias("match_key"))


@query("""SELECT o_orderkey, 1989 AS d4, strftime(o_orderdate, '%d/%m/') || year(o_orderdate) AS d6, strftime(o_orderdate, '%d/%m/%Y') AS d7, year(o_orderdate) AS d9, '22.06.97' AS d7_short FROM orders""")
def years_and_dates(spark, d):
    """The parted date comes first, two-digit years stay in D7, dates are found inside a text."""
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", X.serret_year(F.concat(F.lit("30/7/89 (plan de "), F.year(o).cast("string"), F.lit(")"))).cast("long").alias("d4"), X.full_year(F.date_format(o, "dd/MM/yy")).alias("d6"),
        X.compact_date(F.concat(F.lit("vers le "), F.date_format(o, "d.M.yyyy"), F.lit(" a peu pres"))).alias("d7"), X.any_year(F.date_format(o, "d.M.yyyy")).cast("long").alias("d9"), X.compact_date(F.lit("22.06.97")).alias("d7_short"),
    )


@query("""SELECT o_orderkey, ['12-15, AB 7, 8', '1, 2', 'A, B, 12', '12, A'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS parcelles FROM orders""")
def parcel_lists(spark, d):
    """C6."""
    raw = _pick(F.col("o_orderkey"), 4, ("12 à 15; AB 7 et 8", " 1 |+ 2 ,", "A B / 12", "12 A,"))
    return table(spark, d, "orders").select("o_orderkey", X.clean_parcels(raw).alias("parcelles"))


@query("""SELECT lower(event_type) AS ocr_norm, 'Commune' AS field, arg_max('Corrigé ' || user_id, event_id) AS correction, count(*) AS count FROM events WHERE event_id % 2 = 0 GROUP BY 1""")
def review_corrections(spark, d):
    """T4: fields that aren't learned and corrections that change only signs leave nothing."""
    e = table(spark, d, "events")
    field = F.when(F.col("event_id") % 2 == 0, "Commune").otherwise("Date")
    own = e.select(field.alias("field"), F.col("event_type").alias("ocr_value"), F.concat(F.lit("Corrigé "), F.col("user_id").cast("string")).alias("correction"), F.col("event_id").alias("ts"))
    same = e.select(F.lit("Commune").alias("field"), F.col("event_type").alias("ocr_value"), F.upper("event_type").alias("correction"), (F.col("event_id") + 1000000000).alias("ts"))
    return R.learn_corrections(own.unionByName(same), R.LEARNED_FIELDS)


@query("""SELECT o_orderkey, ['Document d''Arpentage (DMPC)', 'Plan de Bornage', 'Type Inconnu', 'Document d''Arpentage (DMPC)', 'Plan de Division'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS kind, [4, 2, 0, 2, 2][CAST(o_orderkey % 5 AS INTEGER) + 1]::INTEGER AS hits FROM orders""")
def document_kind(spark, d):
    """A8 with the points of the order number and the dossier."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", _pick(k, 5, ("Division dmpc", "Bornage amiable", "rien", "reconnaissance", "division en lotissement")).alias("text"), _pick(k, 5, ("677", "Inconnu", "Inconnu", "Inconnu", "Inconnu")).alias("ordre"),
        _pick(k, 5, ("", "", "", "x DMPC 2", "")).alias("dossier"),
    )
    return R.document_class(rows, "text", "ordre", "dossier").select("o_orderkey", "kind", F.col("hits").cast("int").alias("hits"))


@query("""SELECT o_orderkey, o_orderstatus AS enr_statut FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1993-03-01' AND o_orderdate <= DATE '1997-06-30' AND o_totalprice > 50000 AND o_orderkey % 3 <> 0 AND o_orderkey % 4 > 0 AND lower(o_orderpriority) = '1-urgent'""")
def filtered_records(spark, d):
    """States, days of both forms, a flag, a filled column, a list and a field of the further information; every match."""
    k = F.col("o_orderkey")
    records = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("enr_statut"), F.col("o_orderdate").cast("date").alias("enr_date_dossier"), (F.col("o_totalprice") > 50000).alias("enr_visible"), F.when(k % 3 != 0, "memo").alias("enr_memo"),
        F.when(k % 4 > 0, F.array_repeat(F.lit("x"), (k % 4).cast("int"))).otherwise(F.array().cast("array<string>")).alias("dmpc"), F.create_map(F.lit("priorite"), F.col("o_orderpriority")).alias("enr_extra"),
    )
    params = {"enr_statut": ["F", "O"], "enr_date_min": "1993-03-01", "enr_date_max": "30-06-1997", "enr_visible": "true", "enr_memo": True, "dmpc": "true", "enr_extra": "priorite:1-URGENT"}
    return P3.matching(records, params).select("o_orderkey", "enr_statut")
