"""Functions and small operators over the driver's tables: values chosen by key, the answers written down by hand or worked out in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import communes as C
from ..operators import extraction as E
from ..sources import tables as T
from .base import query, table


def _pick(key, values):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))


def _list(values, key: str = "c_custkey") -> str:
    said = ["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in values]
    return "[" + ", ".join(said) + f"][CAST({key} % {len(values)} AS INTEGER) + 1]"


_KEYS = ("St-Andéol  d'Été", "N°12 – Vals", "n' 5’b", "ab")
_LOOSE, _SPATIAL = ("ST ANDEOL  D ETE", "N 12   VALS", "N  5 B", "AB"), ("st andeol d ete", "n 12 vals", "n 5 b", "ab")
_UNIFIED, _LEARNED = ("St-Andéol  d'Été", "N°12 - Vals", "n' 5'b", "ab"), ("standoldt", "n12vals", "n5b", "ab")


@query(f"SELECT c_custkey AS id, {_list(_LOOSE)} AS loose, {_list(_SPATIAL)} AS spatial, {_list(_UNIFIED)} AS unified, {_list(_LEARNED)} AS learned FROM customer")
def more_keys(spark, d):
    """N4, N7, N8, N10."""
    own = _pick(F.col("c_custkey"), _KEYS)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.loose_key(own).alias("loose"), X.spatial_key(own).alias("spatial"), X.unify_signs(own).alias("unified"), X.learned_key(own).alias("learned"))


@query(f"""SELECT c_custkey AS id, '12,34,' || (c_custkey % 90 + 100) AS runs, {_list(('A', 'AB', None))} AS section, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE lpad(CAST(c_custkey % 100 AS VARCHAR), 4, '0') END AS numero, {_list(('07289', '2A289', '971289'))} AS insee,
{_list(('DIVISION_PARCELLAIRE', 'BORNAGE', 'AUTRE'))} AS nature, {_list(('070', '2A0', '970'))} AS dmpc FROM customer""")
def parcel_values(spark, d):
    """C8, C10, C11, C15, C16."""
    k = F.col("c_custkey")
    digits = X.zero_filled(k % 100, 2)
    token = F.when(k % 3 == 0, F.concat(F.lit(" a"), digits)).when(k % 3 == 1, F.concat(F.lit("AB "), digits)).otherwise("XYZ")
    parts, dept = X.parcel_parts(token), _pick(k, ("070", "2A0", "971"))
    insee = X.insee(dept, F.lit("289"))
    return table(spark, d, "customer").select(
        k.alias("id"), F.array_join(X.numeric_tokens(F.concat(F.lit("n12x34a0b"), (k % 90 + 100).cast("string")), 99999, whole_words=False), ",").alias("runs"), parts["section"].alias("section"), parts["numero"].alias("numero"),
        insee.alias("insee"), X.act_nature(_pick(k, ("Division en deux", "plan de bornage et division", "vente"))).alias("nature"), X.act_number(F.lit("12"), insee)["dmpc_prefixe"].alias("dmpc"),
    )


@query(f"""SELECT c_custkey AS id, {_list(("Ucel", "Vals", "12"))} AS answer, {_list((True, False, True))}::BOOLEAN AS signatory, 1950 + c_custkey % 50 AS year, {_list(("Département de la Commune", "Section OI", "Echelle 1/1000"))} AS text FROM customer""")
def readings(spark, d):
    """C1, C17, C19, D5."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), E.plain_answer(_pick(k, ("Le texte est : 'Ucel'.", "je vois Vals", '"12"'))).alias("answer"), E.is_signatory(_pick(k, ("M. Jean DURAND", "SECTION", "Roche Paul"))).alias("signatory"),
        X.year_in_text(F.concat(F.lit("vu le 3.4."), (1950 + k % 50).cast("string"), F.lit(" puis 2001"))).cast("long").alias("year"), E.cadastral_rules(_pick(k, ("DEpartement de la c0mmune", "Section 01", "Echelle l/IOOO"))).alias("text"),
    )


@query("""WITH p AS (SELECT c_custkey, radians(44 + c_custkey % 10 / 10.0) AS f, 4 + c_custkey % 7 / 10.0 AS l, 0.0818191910428158 AS e, 0.7256077650532670 AS n, 11754255.426096 AS c, 12655612.049876 AS ys FROM customer),
q AS (SELECT *, ln(tan(pi() / 4 + f / 2) * pow((1 - e * sin(f)) / (1 + e * sin(f)), e / 2)) AS iso, n * radians(l - 3) AS g FROM p)
SELECT c_custkey AS id, round(700000 + c * exp(-n * iso) * sin(g), 1) AS x, round(ys - c * exp(-n * iso) * cos(g), 1) AS y FROM q""")
def projected(spark, d):
    """M9: against the projection's published constants."""
    k = F.col("c_custkey")
    x, y = X.lambert93(44 + k % 10 / 10.0, 4 + k % 7 / 10.0)
    return table(spark, d, "customer").select(k.alias("id"), F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS annee, c_name AS commune FROM customer WHERE c_custkey % 3 = 0""")
def numeric_rows(spark, d):
    """A sheet without a header; titles and notes between the rows go."""
    k = F.col("c_custkey")
    sheet = table(spark, d, "customer").select(F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, "Année").alias("_c0"), F.col("c_name").alias("_c1"))
    return T.numeric_sheet(sheet, ["annee", "commune"], "annee")


@query(f"""SELECT c_custkey AS id, {_list(("12 (Nouveau),14a (Nouveau),56 (Nouveau)", "34 (Nouveau),7 (Ancien)", ""))} AS parcelles, {_list(("représentés par Jean Roche (2°)", "dispensés de signer (3°)", "soussignés (1°)"))} AS certification FROM customer""")
def parcels_and_signing(spark, d):
    """X19, X21."""
    k = F.col("c_custkey")
    docs = table(spark, d, "customer").select(k.alias("id"), _pick(k, ("parcelles n° 12, 14a", "sections ci-apres\n 34\n1950", "rien")).alias("text"), F.when(k % 3 == 0, F.array(F.lit("56"), F.lit("12"))).alias("new"), F.when(k % 3 == 1, F.array(F.lit("7"))).alias("old"))
    blocks = table(spark, d, "customer").select(k.alias("id"), F.lit(1).alias("block_id"), _pick(k, ("représentés par Jean Roche", "DISPENSÉ de signer", "x")).alias("text"), F.lit(0.9).alias("prob"))
    return E.parcel_lists(docs, ["id"], "text", "new", "old").join(E.certification(docs, blocks, ["id"]), "id").select("id", F.array_join("parcelles", ",").alias("parcelles"), "certification")


@query("""SELECT c_custkey // 4 AS doc, string_agg('M. Jean DURAND ' || chr(CAST(65 + c_custkey % 4 AS INTEGER)), ',' ORDER BY c_custkey) AS signataires FROM customer WHERE c_custkey % 4 <> 2 GROUP BY 1""")
def signatory_lists(spark, d):
    """Four blocks are a document; one names nobody."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 2, "SECTION").otherwise(F.concat(F.lit("M. Jean DURAND "), F.get(F.array(*map(F.lit, "ABCD")), (k % 4).cast("int"))))
    out = E.signatories(table(spark, d, "customer").select(F.floor(k / 4).alias("doc"), k.alias("block_id"), name.alias("text")), ["doc"], ["block_id"])
    return out.select("doc", F.array_join("signataires", ",").alias("signataires"))


@query("""WITH r(i, rule, level, fields) AS (VALUES (0, 'COMMUNE_VIDE', 'ERREUR', 'commune'), (0, 'NUMEROS_VIDES', 'ALERTE', 'n_dossier,n_ordre'), (0, 'GEOMETRE_SUSPECT', 'ALERTE', 'geometre'), (2, 'GEOMETRE_VIDE', 'ALERTE', 'geometre'), (2, 'SECTION_VIDE', 'INFO', 'section'), (2, 'NATURE_INCONNUE', 'INFO', 'nature'))
SELECT c_custkey AS fichier, rule, level, fields FROM customer JOIN r ON i = c_custkey % 3""")
def output_audit(spark, d):
    """A16."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        F.concat(k.cast("string"), F.when(k % 3 == 0, "_dmpc").otherwise("_b")).alias("fichier"), _pick(k, (None, "UCEL", "VALS")).alias("commune"), _pick(k, ("1", "2", "3")).alias("n_ordre"), _pick(k, (None, "3", "4")).alias("n_dossier"),
        _pick(k, ("Cabinet Géomètre", "Durand", "None")).alias("geometre"), _pick(k, ("A", "B", "")).alias("section"), _pick(k, ("DMPC", "DMPC", "AUTRE")).alias("nature"),
    )
    return E.output_audit(rows, ["fichier"]).select(F.regexp_extract("fichier", r"^\d+", 0).cast("long").alias("fichier"), "rule", "level", "fields")


@query("""SELECT 'C' || c_custkey AS commune, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code_insee, CASE WHEN c_custkey % 3 = 0 THEN '07' ELSE '00' END AS departement, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'A,B' WHEN c_custkey % 3 = 0 THEN 'A' WHEN c_custkey % 2 = 0 THEN 'B' ELSE '' END AS sections FROM customer""")
def knowledge_base(spark, d):
    """A third of the communes are known; sections of validated documents are added."""
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("nom"), X.zero_filled("c_custkey", 9).alias("code"), "c_custkey")
    none = F.array().cast("array<string>")
    kb = c.filter("c_custkey % 3 = 0").select(F.col("nom").alias("commune"), F.lit("").alias("code_insee"), F.lit("07").alias("departement"), F.array(F.lit("A")).alias("sections_connues"), none.alias("prefixes_dossier"), none.alias("types_plans_frequents"))
    seen = c.filter("c_custkey % 2 = 0").select(F.col("nom").alias("commune"), F.lit(" b").alias("section"))
    return E.kb_enriched(E.kb_bootstrap(kb, c.select("nom", "code")), seen).select("commune", "code_insee", "departement", F.array_join("sections_connues", ",").alias("sections"))


@query(f"""SELECT c_custkey AS id, {_list((True, True, False, True))}::BOOLEAN AS veto, {_list(("10,40", "20", "", "5,30"))} AS lines FROM customer""")
def vetoes_and_lines(spark, d):
    """F8, W9."""
    k = F.col("c_custkey")
    veto = C.commune_veto(_pick(k, ("Section", "ab", "Ucel", "Vals")), ("section", "commune"), F.when(k % 4 == 3, 40.0).otherwise(90.0))
    lines = F.when(k % 4 == 0, F.array(F.lit(40), F.lit(10))).when(k % 4 == 1, F.array(F.lit(24), F.lit(17))).when(k % 4 == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(30), F.lit(5)))
    return table(spark, d, "customer").select(k.alias("id"), veto.alias("veto"), F.array_join(F.transform(E.merged_lines(lines), lambda x: x.cast("string")), ",").alias("lines"))
