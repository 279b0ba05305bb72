"""Register lookups over the driver's tables: customers are the plans, suppliers the register, nations the communes.

A commune's name is made of a digest of its nation's, so that names are far apart; a quarter of the plans misread its first
letter. The score is of edits, which SQL has too.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registers as G
from .base import query, table

_SCORE = "100.0 * (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})))"
_Q = """SELECT c_custkey AS query_id, CASE WHEN c_custkey % 4 = 0 THEN 'Z' ELSE upper(substr(md5(n_name), 1, 1)) END || upper(substr(md5(n_name), 2, 11)) AS q_name, substr(c_mktsegment, 1, 2) AS q_section, [CAST(c_custkey % 50 AS INTEGER), CAST(c_custkey % 7 AS INTEGER)] AS parcels,
CAST(c_custkey % 9 AS INTEGER) AS k, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_R = """SELECT s_suppkey AS pos, upper(substr(md5(n_name), 1, 12)) AS r_name, CASE s_suppkey % 3 WHEN 0 THEN 'AU' WHEN 1 THEN 'BU' ELSE 'MA' END AS section, CAST(s_suppkey % 50 AS INTEGER) AS parcelle,
CAST(s_suppkey % 9 AS INTEGER) AS k, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _cascade(least: int, steps: list[str], section: bool, more: str = "") -> str:
    """SQL of the pairs that are left, as table e."""
    parts = [f"q AS ({_Q}), r AS ({_R}), c0 AS (SELECT *, {_SCORE.format('q_name', 'r_name')} AS score{more} FROM q JOIN (SELECT pos, r_name, section, parcelle, k AS rk, s_name FROM r) ON {_SCORE.format('q_name', 'r_name')} >= {least})"]
    for i, step in enumerate(steps, 1):
        parts.append(f"c{i} AS (SELECT * EXCLUDE (p, a) FROM (SELECT *, bool_or(p) OVER (PARTITION BY query_id) AS a FROM (SELECT *, coalesce({step}, false) AS p FROM c{i - 1})) WHERE p OR NOT a)")
    n = len(steps)
    if section:
        parts.append(f"w AS (SELECT *, max(ss) OVER (PARTITION BY query_id) AS top, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT *, {_SCORE.format('q_section', 'section')} AS ss FROM c{n}))")
        parts.append("e AS (SELECT * FROM w WHERE n = 1 OR top < 60 OR ss = top)")
    else:
        parts.append(f"e AS (SELECT * FROM c{n})")
    return "WITH " + ", ".join(parts)


_PICK = """SELECT q.query_id, coalesce(g.status, 'NO_MATCH') AS status, coalesce(g.nb, 0) AS nb, coalesce(g.refs, '') AS refs FROM q LEFT JOIN
(SELECT query_id, {status} AS status, count(*) AS nb, string_agg({ref}, ',' ORDER BY {order}) AS refs FROM e GROUP BY query_id) g USING (query_id)"""
_ONE = "CASE WHEN count(*) = 1 THEN 'MATCH_UNIQUE' ELSE 'CANDIDATS' END"


def _plans(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        k.alias("query_id"), F.concat(F.when(k % 4 == 0, "z").otherwise(F.substring(F.md5("n_name"), 1, 1)), F.substring(F.md5("n_name"), 2, 11)).alias("commune"), F.substring("c_mktsegment", 1, 2).alias("section"), (k % 9).cast("int").alias("k"),
        F.concat(F.lit("['"), (k % 50).cast("string"), F.lit("', 'x1', '"), (k % 7).cast("string"), F.lit("', '99999']")).alias("parcelles"), F.col("c_custkey").alias("key"),
    )


def _register(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    section = F.when(k % 3 == 0, "AU").when(k % 3 == 1, "BU").otherwise("MA")
    return s.select(k.alias("pos"), F.upper(F.substring(F.md5("n_name"), 1, 12)).alias("commune"), section.alias("section"), (k % 50).cast("int").alias("parcelle"), (k % 9).cast("int").alias("k"), "s_name")


def _picked(found):
    return found.select("query_id", "status", "nb", F.coalesce("candidats", F.lit("")).alias("refs"))


@query(_cascade(75, ["list_contains(list_filter(parcels, lambda x: x >= 1), parcelle)", "rk = k"], True) + _PICK.format(status=_ONE, ref="lpad(CAST(90 + rk AS VARCHAR), 2, '0') || CASE WHEN pos < 1000 THEN lpad(CAST(pos AS VARCHAR), 3, '0') ELSE CAST(pos AS VARCHAR) END", order="pos"))
def register_hb(spark, d):
    """J12, K6, C7, C12, C13."""
    q = _plans(spark, d).withColumn("annee_2ch", F.col("k") + 90)
    r = _register(spark, d).withColumns({"annee": F.col("k") + 1990, "n_seq": F.col("pos"), "op_code": F.lit("DA"), "prop_anciens": F.col("s_name"), "prop_nouveaux": F.col("s_name")})
    return _picked(G.find_hb(q, r, G.edit_score, G.edit_score, "ref_dossier"))


_RC = _PICK.format(status=_ONE, ref="CAST(50 + rk AS VARCHAR) || '/' || pos", order="pos").replace("coalesce(g.status, 'NO_MATCH') AS status", "CASE WHEN k = 8 THEN 'HORS_REPERTOIRE' ELSE coalesce(g.status, 'NO_MATCH') END AS status").replace("FROM e GROUP", "FROM e WHERE k < 8 GROUP")


@query(_cascade(75, ["list_has_any(parcels, list_filter([parcelle, parcelle + 1], lambda x: x >= 1)) AND list_has_any(list_filter(parcels, lambda x: x >= 1), [parcelle, parcelle + 1])", "list_has_any(list_filter(parcels, lambda x: x >= 1), [parcelle, parcelle + 1, parcelle + 2, parcelle + 3])", "rk = k"], True) + _RC)
def register_rc(spark, d):
    """Plans of the ninth year are of 1965, which the register doesn't cover."""
    year = F.when(F.col("k") == 8, 1965).otherwise(F.col("k") + 1950)
    q = _plans(spark, d).withColumns({"annee": year, "mois": F.lit(None).cast("int")})
    p = F.col("parcelle")
    r = _register(spark, d).withColumns({
        "annee": F.col("k") + 1950, "n_registre": F.col("pos"), "date_cadastre": F.lit(None).cast("string"), "parc_acq": F.array(p, p + 1), "parc_orig": F.array(p + 2), "parc_vend": F.array(p + 3),
        "vendeur": F.col("s_name"), "acquereur": F.col("s_name"), "notaire": F.lit(""),
    })
    return _picked(G.find_rc(q, r, G.edit_score, G.edit_score, "ref_dossier"))


_NAMES = "trim(regexp_replace(upper(s_name || ' ' || s_name), '[^A-Z0-9]+', ' ', 'g'))"
_BY_OWNER = f"CAST(floor({_SCORE.format('hint', _NAMES)}) AS INTEGER) DESC, CAST(floor(score) AS INTEGER) DESC, rk, pos"


@query(_cascade(70, ["rk = k"], False, ", 'SUPPLIER 00000000' || CAST(c_custkey % 10 AS VARCHAR) AS hint") + _PICK.format(status="'CANDIDATS'", ref="CAST(70 + rk AS VARCHAR) || pos", order=_BY_OWNER))
def register_d(spark, d):
    """J14, K8."""
    q = _plans(spark, d).withColumns({"annee": F.col("k") + 1970, "hint_anciens": F.concat(F.lit("Supplier#00000000"), (F.col("key") % 10).cast("string")), "hint_nouveaux": F.lit("")})
    r = _register(spark, d).withColumns({"annee": F.col("k") + 1970, "n_dossier": F.concat(F.lit("00"), "pos"), "prop_anciens": F.col("s_name"), "prop_nouveaux": F.col("s_name"), "notes": F.lit("")})
    return _picked(G.find_d(q, r, G.edit_score, G.edit_score, "ref_dossier"))


@query(_cascade(65, ["abs(rk - k - 8) <= 2", "rk = k + 8"], False) + _PICK.format(status="'CANDIDATS'", ref="s_name", order="CAST(floor(score) AS INTEGER) DESC, pos"))
def register_s(spark, d):
    """The plan's year is eight years on, so that some plans find it, some two years around it, and most neither."""
    q = _plans(spark, d).withColumns({"annee": F.col("k") + 1978, "hint_affaire": F.lit(""), "hint_client": F.lit(None).cast("string")})
    r = _register(spark, d).withColumns({"annee": F.col("k") + 1970, "n_dossier": F.col("s_name"), "date": F.lit("30/7/89"), "affaire": F.lit("x"), "client": F.col("s_name"), "notes": F.lit("")})
    return _picked(G.find_s(q, r, G.edit_score, G.edit_score, "ref_dossier"))


@query("""SELECT c_custkey AS doc_id, CASE g WHEN 0 THEN 'HB' WHEN 1 THEN 'RC' WHEN 2 THEN 'D' WHEN 3 THEN 'S' ELSE 'MANUEL' END AS register, 'R' || c_custkey AS ref_dossier, CASE WHEN g < 2 THEN 'B' ELSE 'AU' END AS section,
CASE g WHEN 0 THEN 12 WHEN 1 THEN 7 END AS parcelle, CASE g WHEN 0 THEN 'Eb' ELSE 'Em' END AS op_code_gf, CASE g WHEN 1 THEN '1962-01-01' WHEN 2 THEN '1975-01-01' WHEN 3 THEN '1989-07-30' END AS date_cadastre, 'Achevé' AS enr_statut
FROM (SELECT c_custkey, c_custkey % 5 AS g FROM customer)""")
def unified_record(spark, d):
    """J25, J27."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    names = F.array(*map(F.lit, ("Harrois Gervais", "CEYTE", " dupuy Roger", "Serret Fernand", "LACOUR Jacques")))
    plans = c.select("doc_id", F.get(names, (F.col("doc_id") % 5).cast("int")).alias("geometre"), F.lit(" au").alias("section"))
    ref, string = F.concat(F.lit("R"), "doc_id").alias("ref_dossier"), F.lit(None).cast("string")
    hb = c.select("doc_id", ref, F.lit("c").alias("commune"), F.lit("B").alias("section"), F.lit(12).alias("parcelle"), F.lit("Eb").alias("op_code_gf"), F.lit("DB").alias("op_code_excel"), F.lit(1997).alias("annee_full"), F.lit("").alias("prop_anciens"), F.lit("").alias("prop_nouveaux"))
    rc = c.select("doc_id", ref, F.lit("c").alias("commune"), F.lit("B").alias("section"), F.array(F.lit(7), F.lit(8)).alias("parcelle_acq"), F.lit(1962).alias("annee"), string.alias("date_cadastre"), F.lit("").alias("vendeur"), F.lit("").alias("acquereur"))
    dd = c.select("doc_id", ref, F.lit("c").alias("commune"), F.lit(1975).alias("annee"), F.lit("").alias("prop_anciens"), F.lit("").alias("prop_nouveaux"))
    ss = c.select("doc_id", ref, F.lit("c").alias("commune"), F.lit(1989).alias("annee"), F.lit("30/7/89").alias("date"), F.lit("").alias("client"))
    out = G.unified(plans, hb, rc, dd, ss, c.select("doc_id", ref))
    return out.select("doc_id", "register", "ref_dossier", "section", "parcelle", "op_code_gf", "date_cadastre", "enr_statut")
