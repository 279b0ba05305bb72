"""Kinds of documents and fields of running text over the driver's tables; the texts are chosen by key, the answers written down by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import composed as P
from ..operators import documents as D
from ..operators import layout as Y
from ..operators.registers import edit_score
from ..operators.shared import spread
from .base import query, table


def _pick(key, values):
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"][CAST(o_orderkey % {len(values)} AS INTEGER) + 1]"


_TEXTS = ("Direction générale des Finances Publiques", "un DMPC", "Procès-Verbal de bornage", "lotissement des Pins", "rien", "document d'arpentage")
_READ = ("Extrait du plan cadastral", "proces verbal", "un piquota", "Division en deux", "rien de connu", "croquis")


@query(f"""SELECT o_orderkey, {_list(("MODERN_DGFIP", "DMPC", "PVa", "PLa", "GENERIC", "DMPC"))} AS by_text, {_list(("GENERIC", "PVa", "DMPC", "PLa", None, "CROQUIS"))} AS by_reading,
{_list(("true", "false", "true", "false", "true", "false"))}::BOOLEAN AS is_plan FROM orders""")
def plan_kind(spark, d):
    """X23; the fuzzy signals are tested by hand-derived values, since SQL lacks the score."""
    k = F.col("o_orderkey")
    none = lambda a, b: F.lit(0.0)
    path = _pick(k, ("in/1992C100001.pdf", "in/x.pdf", "in/plan_da12", "in/y.pdf", "in/z.pdf", "in/w.pdf"))
    page = _pick(k, ("", "rien", "rien", None, "plan de Bornage", "x"))
    kind = D.kind_of_reading(F.when(k % 6 == 0, "MODERN_DGFIP").otherwise("GENERIC"), _pick(k, _READ), _pick(k, _READ), none)
    return table(spark, d, "orders").select("o_orderkey", D.kind_of_text(_pick(k, _TEXTS)).alias("by_text"), kind.alias("by_reading"), D.is_plan_file(path, page).alias("is_plan"))


@query("""SELECT o_orderkey // 8 AS page, CASE WHEN count(*) FILTER (o_orderkey % 8 = 1) > 0 THEN 'SAINT-PRIVAT (289)' END AS commune, CASE WHEN count(*) FILTER (o_orderkey % 8 = 1) > 0 THEN '289' END AS code_insee, CASE WHEN count(*) FILTER (o_orderkey % 8 = 2) > 0 THEN '891-A' END AS n_ordre,
CASE WHEN count(*) FILTER (o_orderkey % 8 = 3) > 0 THEN '12/03/2015' END AS date, CASE WHEN count(*) FILTER (o_orderkey % 8 = 4) > 0 THEN 'BARRIAL' END AS geometre, CASE WHEN count(*) FILTER (o_orderkey % 8 = 5) > 0 THEN 'AH' END AS section,
CASE WHEN count(*) FILTER (o_orderkey % 8 = 6) > 0 THEN '000 AH 01' END AS feuille, CASE WHEN count(*) FILTER (o_orderkey % 8 = 7) > 0 THEN '1/1000' END AS echelle FROM orders GROUP BY 1""")
def extract_fields(spark, d):
    """X11: eight spans are a page; the commune stands below its label."""
    k = F.col("o_orderkey")
    text = _pick(k, ("Commune :", "SAINT-PRIVAT (289)", "Numéro d'ordre du document d'arpentage : 891-A", "Document vérifié le 12/03/2015", "Dressé par BARRIAL Géomètre-Expert", "Section      : AH", "Feuille(s)   :  000 AH 01", "Echelle d'origine  : 1/1000"))
    spans = table(spark, d, "orders").select(F.floor(k / 8).alias("page"), text.alias("text"), F.when(k % 8 < 5, 10.0).otherwise(600.0).alias("x0"), (k % 8).cast("double").alias("y0"))
    return D.extract_fields(spans, ["page"], F.lit(1000.0), edit_score).select("page", "commune", "code_insee", "n_ordre", "date", "geometre", "section", "feuille", "echelle")


@query(f"""SELECT o_orderkey, {_list(("Vals les Bains", "Privas", None))} AS commune, {_list(("12/03/1985", "3/4/1990", None))} AS date, {_list(("AB", None, "C"))} AS section FROM orders""")
def textual_fields(spark, d):
    """X18."""
    k = F.col("o_orderkey")
    text = _pick(k, ("Territoire de la commune de Vals les Bains section AB, dressé le 12/03/85", "Fait à Privas, le 3/4/1990", "Section C du plan"))
    return D.textual_fields(table(spark, d, "orders").select("o_orderkey", text.alias("full_text"))).select("o_orderkey", "commune", "date", "section")


@query(f"""SELECT o_orderkey, {_list(("AB", "D", None))} AS section, {_list(("12", "2", None))} AS feuille, {_list(("bornage contradictoire entre voisins", "vente", "LOTISSEMENT"))} AS indication, {_list(("3 mars 1987", "1/1/1990", None))} AS date FROM orders""")
def text_fallbacks(spark, d):
    """X22."""
    k = F.col("o_orderkey")
    text = _pick(k, ("section AB, feuille n°12 bornage contradictoire entre voisins. le 01/02/1985 puis 3 mars 1987", "rien", "section Indications LOTISSEMENT"))
    pages = table(spark, d, "orders").select("o_orderkey", text.alias("full_text"), _pick(k, (None, "D", None)).alias("section"), _pick(k, (None, "2", None)).alias("feuille"), _pick(k, ("", "vente", None)).alias("indication"), _pick(k, ("", "1/1/1990", None)).alias("date"))
    return D.with_fallbacks(pages).select("o_orderkey", "section", "feuille", "indication", "date")


@query(f"""SELECT o_orderkey, {_list(("false", "true", "false", "true", "false", "true", "true", "true"))}::BOOLEAN AS suspect FROM orders""")
def suspect_values(spark, d):
    """X25, T28."""
    k = F.col("o_orderkey")
    field = _pick(k, ("commune", "commune", "indication", "indication", "geometre", "geometre", "geometre", "date"))
    value = _pick(k, ("Ucel", "", "d'après un plan", "vente", "RACAT", "EXPERTS BP", "le présent soussigné Jean", "1/2/1990"))
    return table(spark, d, "orders").select("o_orderkey", D.is_suspect(field, value, F.when(k % 8 == 7, 0.5).otherwise(0.9)).alias("suspect"))


_PLACE = "'Saint-' || translate(lpad(CAST({0} AS VARCHAR), 2, '0'), '0123456789', 'ABEFLMNORT') || ' le Haut'"


@query(f"""WITH d AS (SELECT c_custkey AS k, {_PLACE.format('c_nationkey')} AS place, 2000 + c_custkey % 20 AS year, c_custkey % 20 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS filed FROM customer)
SELECT k AS doc_id, 'CROQUIS' AS kind, CASE WHEN k % 3 = 2 THEN 'Zzyx Wvut' ELSE place END AS commune, 'A' || lpad(CAST(filed AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS n_dossier, 'B' || chr(CAST(65 + k % 26 AS INTEGER)) AS section,
CAST(1 + k % 90 AS VARCHAR) AS feuille, place || ', le ' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '/' || year AS date, '1/' || (500 * (1 + k % 4)) AS echelle, CASE WHEN k % 2 = 0 THEN 'RACAT' ELSE 'BARRIAL' END AS geometre,
CASE WHEN k % 4 = 1 THEN 'bornage contradictoire ' || k END AS indication, CASE WHEN k % 4 = 1 THEN 'BORNAGE' ELSE '' END AS nature, CASE WHEN k % 5 = 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS score, CASE WHEN k % 5 = 0 THEN 'REJET' ELSE 'CONFORME' END AS coherence FROM d""")
def document_run(spark, d):
    """X27, X12 with X26, X23, A12, X3, X7, X14, X15, X17, X18, C18, J5, J6, F8, X24, X25, W8, A6: customers are documents of two pages, every value on them made of the row. A third
    names an unknown commune, which stays unsure; the closing words of the second page give the place and the date.
    """
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    place = lambda c: F.concat(F.lit("Saint-"), F.translate(X.zero_filled(c, 2), "0123456789", "ABEFLMNORT"), F.lit(" le Haut"))
    filed = k % 20 + F.when(k % 5 == 0, 1).otherwise(0)
    day = F.concat_ws("/", X.zero_filled(1 + k % 28, 2), X.zero_filled(1 + k % 12, 2), text(2000 + k % 20))
    line = lambda page, at, t: F.struct(F.lit(page).alias("page"), F.lit(at).alias("block_id"), t.alias("text"))
    lines = [
        line(1, 1, F.concat(F.lit("Commune : "), F.when(k % 3 == 2, "Zzyx Wvut").otherwise(place(F.col("c_nationkey"))))), line(1, 2, F.concat(F.lit("Section : B"), F.call_function("chr", 65 + k % 26))), line(1, 3, F.concat(F.lit("Feuille : "), text(1 + k % 90))),
        line(1, 4, F.concat(F.lit("Echelle : 1/"), text(500 * (1 + k % 4)))), line(1, 5, F.concat(F.lit("N° de dossier : A"), X.zero_filled(filed, 2), F.lit("-"), X.zero_filled(k % 10000, 4))),
        line(1, 6, F.when(k % 4 == 1, F.concat(F.lit("Objet : bornage contradictoire "), text(k))).otherwise("(x)")), line(2, 1, F.when(k % 2 == 0, "Géomètre : RACAT").otherwise("Cabinet BARRIAL")), line(2, 2, F.concat(F.lit("Fait à "), place(F.col("c_nationkey")), F.lit(", le "), day)),
    ]
    blocks = spread(table(spark, d, "customer"), "c_custkey", rows=15_000).select(k.alias("doc_id"), F.explode(F.array(*lines)).alias("b")).select("doc_id", "b.*")
    blocks = blocks.select("doc_id", "page", "block_id", "text", F.lit(50.0).alias("x0"), F.lit(250.0).alias("x1"), (F.col("block_id") * 40.0).alias("y0"), (F.col("block_id") * 40.0 + 15).alias("y1"), F.lit(0.9).alias("prob"))
    names = table(spark, d, "nation").select(place(F.col("n_nationkey")).alias("officiel"), F.concat(F.lit("07"), X.zero_filled("n_nationkey", 3)).alias("code"), F.col("n_nationkey").alias("pos"))
    out = P.document_fields(blocks, names, F.lit(1000.0), F.lit(1400.0), score=edit_score, surveyor=edit_score)
    return out.select("doc_id", "kind", "commune", "n_dossier", "section", "feuille", "date", "echelle", "geometre", "indication", "nature", F.col("score").cast("double").alias("score"), "coherence")


@query(f"""WITH d AS (SELECT c_custkey AS k, {_PLACE.format('c_nationkey')} AS place FROM customer)
SELECT k AS doc_id, place AS commune, 100 AS commune_score, CASE WHEN k % 2 = 0 THEN 'RACAT ' || k ELSE 'Inconnu' END AS geometre, 'A' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS n_dossier,
CASE WHEN k % 4 = 0 THEN '1/' || (500 * (1 + k % 5)) ELSE '1/2500' END AS echelle, CASE WHEN k % 5 = 0 THEN 'B' || chr(CAST(65 + k % 26 AS INTEGER)) ELSE 'Inconnu' END AS cadastre_section FROM d""")
def layout_fields(spark, d):
    """Customers are documents; the commune behind its word, below it or on a line of its own, other fields behind '|', to the right, below, on the next line or by their shape in the text."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    place = F.concat(F.lit("Saint-"), F.translate(X.zero_filled(F.col("c_nationkey"), 2), "0123456789", "ABEFLMNORT"), F.lit(" le Haut"))
    line = lambda at, t, x, y: F.struct(F.lit(at).alias("line_id"), t.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"))
    lines = [
        line(1, F.when(k % 3 == 0, F.concat(F.lit("Commune de "), place)).when(k % 3 == 1, "Commune :").otherwise("xx"), 50, 100), line(2, F.when(k % 3 == 0, "(xx)").otherwise(place), 60, 140),
        line(3, F.when(k % 2 == 0, F.concat(F.lit("Cabinet | RACAT "), text(k))).otherwise("zz"), 600, 400), line(4, F.lit("Dossier n°"), 50, 800), line(5, F.concat(F.lit("A"), X.zero_filled(k % 100, 2)), 300, 802),
        line(6, F.when(k % 4 == 0, F.concat(F.lit("Echelle : 1/"), text(500 * (1 + k % 5)))).otherwise("plan au 1 / 2500 du lieu"), 700, 1200), line(7, F.when(k % 5 == 0, F.concat(F.lit("Section | B"), F.call_function("chr", 65 + k % 26))).otherwise("--"), 50, 1600),
        line(8, F.lit("fin"), 50, 2400),
    ]
    own = spread(table(spark, d, "customer"), "c_custkey").select(k.alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(*lines)).alias("l")).select("doc_id", "page", "l.*").withColumns({"x1": F.col("x0") + 150, "y1": F.col("y0") + 20})
    names = table(spark, d, "nation").select(F.concat(F.lit("Saint-"), F.translate(X.zero_filled(F.col("n_nationkey"), 2), "0123456789", "ABEFLMNORT"), F.lit(" le Haut")).alias("officiel"), F.concat(F.lit("07"), X.zero_filled("n_nationkey", 3)).alias("code"), F.col("n_nationkey").alias("pos"))
    out = Y.layout_values(own, names, edit_score, edit_score, edit_score)
    return out.select("doc_id", "commune", "commune_score", "geometre", "n_dossier", "echelle", "cadastre_section")
