"""Matching of names over the driver's tables: nations are the names, customers' readings are made of them. The score is of edits, which SQL has too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import communes as C
from ..operators import matching as M
from ..operators.registers import edit_score
from .base import query, table

_SCORE = "100.0 * (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1))"
_N = """n AS (SELECT n_nationkey AS pos, 'Saint-' || n_name || ' le Haut' AS officiel, '07' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code, 'SAINT ' || replace(n_name, '_', ' ') || ' LE HAUT' AS k FROM nation)"""
_T = """t AS (SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'Saint-' || n_name || ' le Haut' WHEN 1 THEN 'SAINT ' || n_name || ' HAUT' WHEN 2 THEN '07' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') WHEN 3 THEN lpad(CAST(n_nationkey + 20 AS VARCHAR), 3, '0')
WHEN 4 THEN 'abc' WHEN 5 THEN 'PLAN DE SAINT ' || n_name WHEN 6 THEN 'saint ' || replace(n_name, '_', ' ') WHEN 7 THEN 'Sxint ' || replace(n_name, '_', ' ') || ' le haut (289)' END AS text, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_K = "trim(regexp_replace(upper(text), '[^A-Z0-9]', ' ', 'g'))"
_SQUEEZED = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"


def _names(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.concat(F.lit("Saint-"), "n_name", F.lit(" le Haut")).alias("officiel"), F.concat(F.lit("07"), X.zero_filled("n_nationkey", 3)).alias("code"), F.col("n_nationkey").alias("pos"))


def _readings(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    plain, name = F.replace("n_name", F.lit("_"), F.lit(" ")), F.col("n_name")
    kinds = [
        F.concat(F.lit("Saint-"), name, F.lit(" le Haut")), F.concat(F.lit("SAINT "), name, F.lit(" HAUT")), F.concat(F.lit("07"), X.zero_filled("n_nationkey", 3)), X.zero_filled(F.col("n_nationkey") + 20, 3),
        F.lit("abc"), F.concat(F.lit("PLAN DE SAINT "), name), F.concat(F.lit("saint "), plain), F.concat(F.lit("Sxint "), plain, F.lit(" le haut (289)")),
    ]
    return c.select(F.col("c_custkey").alias("id"), F.get(F.array(*kinds), (F.col("c_custkey") % 8).cast("int")).alias("text"))


@query(f"""WITH {_N}, {_T}, q AS (SELECT id, text, {_K} AS q, CASE WHEN regexp_full_match(trim(text), '(07)?[0-9]{{3}}') THEN CASE WHEN length(trim(text)) = 5 THEN trim(text) ELSE '07' || trim(text) END END AS c FROM t),
n2 AS (SELECT *, trim(regexp_replace(upper(officiel), '[^A-Z0-9]', ' ', 'g')) AS nk FROM n),
s AS (SELECT q, officiel, pos, {_SCORE.format('q', 'nk')} AS score FROM (SELECT DISTINCT q FROM q WHERE c IS NULL AND length(q) >= 4) JOIN n2 ON {_SCORE.format('q', 'nk')} >= 80),
b AS (SELECT q, officiel FROM s WHERE length(q) >= 6 OR score >= 90 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) = 1)
SELECT id, CASE WHEN c IS NOT NULL THEN coalesce(n.officiel, text) WHEN length(q.q) < 4 THEN text ELSE coalesce(b.officiel, text) END AS matched FROM q LEFT JOIN n ON n.code = c LEFT JOIN b ON b.q = q.q""")
def name_by_code_or_score(spark, d):
    """J5, K19."""
    return C.match_name(_readings(spark, d), _names(spark, d), score=edit_score, tie=edit_score).select("id", "matched")


@query(f"""WITH {_N}, {_T}, q AS (SELECT id, text, {_K} AS q FROM t), n2 AS (SELECT *, trim(regexp_replace(upper(officiel), '[^A-Z0-9]', ' ', 'g')) AS nk FROM n),
b AS (SELECT q, officiel, {_SCORE.format('q', 'nk')} AS score FROM (SELECT DISTINCT q FROM q) JOIN n2 ON true QUALIFY row_number() OVER (PARTITION BY q ORDER BY {_SCORE.format('q', 'nk')} DESC, pos) = 1)
SELECT id, CASE WHEN e.officiel IS NOT NULL THEN e.officiel WHEN score >= 78 THEN b.officiel ELSE text END AS matched, round(CASE WHEN e.officiel IS NOT NULL THEN 100.0 ELSE score END, 6)::DOUBLE AS score, e.officiel IS NOT NULL OR score >= 78 AS known
FROM q LEFT JOIN n e ON lower(e.officiel) = lower(text) LEFT JOIN b ON b.q = q.q""")
def name_score(spark, d):
    """J6."""
    return C.score_name(_readings(spark, d), _names(spark, d), score=edit_score).select("id", "matched", F.round("score", 6).alias("score"), "known")


@query(f"""WITH {_N}, {_T}, q AS (SELECT id, text, {_K} AS q, CASE WHEN regexp_full_match(trim(text), '(07)?[0-9]{{3}}') THEN CASE WHEN length(trim(text)) = 5 THEN trim(text) ELSE '07' || trim(text) END END AS c FROM t),
n2 AS (SELECT *, trim(regexp_replace(upper(officiel), '[^A-Z0-9]', ' ', 'g')) AS nk FROM n),
s AS (SELECT q, nk, officiel, code, {_SCORE.format('q', 'nk')} AS score, row_number() OVER (PARTITION BY q ORDER BY {_SCORE.format('q', 'nk')} DESC, pos) AS k FROM (SELECT DISTINCT q FROM q) JOIN n2 ON {_SCORE.format('q', 'nk')} >= 80),
b AS (SELECT * FROM s WHERE k <= 5 QUALIFY row_number() OVER (PARTITION BY q ORDER BY abs(length(nk) - length(q)), k) = 1)
SELECT id, coalesce(n.officiel, b.officiel, text) AS matched, round(CASE WHEN n.officiel IS NOT NULL THEN 100.0 ELSE coalesce(score, 0) END, 6)::DOUBLE AS score, CASE WHEN n.officiel IS NOT NULL THEN c ELSE coalesce(b.code, '') END AS code
FROM q LEFT JOIN n ON n.code = c LEFT JOIN b ON b.q = q.q""")
def name_and_code(spark, d):
    """J7."""
    return C.with_code(_readings(spark, d), _names(spark, d), score=edit_score).select("id", "matched", F.round("score", 6).alias("score"), "code")


@query(f"""WITH {_N}, {_T}, w AS (SELECT id // 10 AS page, id, trim(regexp_replace(text, '[^A-Za-zÀ-ÿ\\s\\-]', ' ', 'g')) AS l FROM t), q AS (SELECT page, id, trim(regexp_replace(upper(l), '[^A-Z0-9 ]', ' ', 'g')) AS q FROM w WHERE length(l) >= 4),
f AS (SELECT * FROM q WHERE NOT list_contains(string_split(q, ' '), 'PLAN')),
b AS (SELECT q, officiel FROM (SELECT DISTINCT q FROM f) JOIN n ON {_SCORE.format('q', 'k')} >= 85 QUALIFY row_number() OVER (PARTITION BY q ORDER BY {_SCORE.format('q', 'k')} DESC, pos) = 1)
SELECT page, min(id) AS id, arg_min(officiel, id) AS officiel FROM f JOIN b USING (q) GROUP BY page""")
def name_in_blocks(spark, d):
    """Ten readings are a page."""
    blocks = _readings(spark, d).withColumn("page", F.floor(F.col("id") / 10))
    return C.scan_blocks(blocks, _names(spark, d), ["page"], "id", score=edit_score)


_ADJ = "least(100, s + CASE WHEN starts_with(k, q) THEN 10 ELSE 0 END) * greatest(0.2, exp(-0.5 * pow((ln(nn / nq) - ln(1.3)) / CASE WHEN nn > nq THEN 1.3 ELSE 0.45 END, 2)))"


@query(f"""WITH {_N}, {_T}, q AS (SELECT id, text, regexp_extract(text, '\\(([0-9]{{3,5}})\\)', 1) AS inside, {_SQUEEZED.format("regexp_replace(text, '\\([0-9]{3,5}\\).*$', '')")} AS q FROM t),
e AS (SELECT q.q, officiel, code FROM (SELECT DISTINCT q FROM q) q JOIN n ON q.q = k), p AS (SELECT q.q, min(officiel) AS officiel, min(code) AS code FROM (SELECT DISTINCT q FROM q WHERE length(q) >= 4 AND q NOT IN (SELECT q FROM e)) q JOIN n ON starts_with(k, q.q) GROUP BY 1 HAVING count(*) = 1),
s AS (SELECT q.q, k, officiel, code, pos, {_SCORE.format('q.q', 'k')} AS s FROM (SELECT DISTINCT q FROM q WHERE q <> '' AND q NOT IN (SELECT q FROM e) AND q NOT IN (SELECT q FROM p)) q, n),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, pos) AS rk, length(regexp_replace(k, '[^A-Z]', '', 'g')) AS nn, length(regexp_replace(q, '[^A-Z]', '', 'g')) AS nq FROM s QUALIFY rk <= 5),
a AS (SELECT *, CASE WHEN nq = 0 THEN least(100, s) * exp(-0.5 * pow(ln(1.3) / 0.45, 2)) ELSE {_ADJ} END AS adj FROM r), b AS (SELECT q, officiel, code, adj FROM a QUALIFY row_number() OVER (PARTITION BY q ORDER BY adj DESC, rk) = 1 AND adj >= 45)
SELECT id, coalesce(e.officiel, p.officiel, b.officiel, text) AS valeur, round(CASE WHEN e.q IS NOT NULL THEN 1 WHEN p.q IS NOT NULL THEN 0.9 WHEN b.q IS NOT NULL THEN least(1, adj / 100) ELSE 0.2 END, 6)::DOUBLE AS confiance,
CASE WHEN e.q IS NOT NULL THEN 'exact' WHEN p.q IS NOT NULL THEN 'prefixe' WHEN b.q IS NOT NULL THEN 'fuzzy' ELSE 'echec' END AS methode, e.q IS NOT NULL OR p.q IS NOT NULL OR coalesce(adj >= 70, false) AS valide,
CASE WHEN b.q IS NOT NULL AND inside <> '' THEN inside ELSE coalesce(e.code, p.code, b.code) END AS code FROM q LEFT JOIN e ON e.q = q.q LEFT JOIN p ON p.q = q.q LEFT JOIN b ON b.q = q.q""")
def commune_corrected(spark, d):
    """J4, C20 for communes."""
    out = C.corrected_commune(_readings(spark, d), _names(spark, d), score=edit_score)
    return out.select("id", "valeur", F.round("confiance", 6).alias("confiance"), "methode", "valide", "code")


@query("""WITH k AS (SELECT DISTINCT p_name AS officiel, trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS k FROM part), w AS (SELECT officiel, k, list_filter(string_split(k, ' '), lambda x: length(x) >= 3) AS w FROM k),
f AS (SELECT k AS forme, officiel FROM w UNION ALL SELECT w[1], officiel FROM w WHERE length(w[1]) >= 4 UNION ALL SELECT w[1] || ' ' || w[2], officiel FROM w WHERE len(w) >= 2)
SELECT forme, min(officiel) AS officiel FROM f GROUP BY forme HAVING count(DISTINCT officiel) = 1""")
def abbreviations(spark, d):
    """X29, A2."""
    return C.short_forms(table(spark, d, "part").select("p_name").distinct(), "p_name")


@query("""WITH k AS (SELECT DISTINCT trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS forme, p_name AS officiel FROM part), h AS (SELECT p_partkey // 7 AS cell_id, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN '[COL_COMMUNE] -> ' || upper(p_name) ELSE p_name || 'x' END AS text FROM part),
j AS (SELECT cell_id, pos, text, officiel FROM h JOIN k ON forme = trim(regexp_replace(upper(replace(text, '[COL_COMMUNE] -> ', '')), '[^A-Z0-9]+', ' ', 'g')))
SELECT cell_id, arg_min(officiel, pos) AS officiel, arg_min(text, pos) AS brut, 100.0::DOUBLE AS score FROM j GROUP BY 1""")
def abbreviation_lookup(spark, d):
    """The first of a cell's readings that is a short form."""
    p = table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("[COL_COMMUNE] -> "), F.upper("p_name"))).otherwise(F.concat("p_name", F.lit("x")))
    readings = p.select(F.floor(F.col("p_partkey") / 7).alias("cell_id"), F.col("p_partkey").alias("pos"), text.alias("text"))
    return C.by_short_form(readings, C.short_forms(p.select("p_name").distinct(), "p_name"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'RACAT' WHEN 1 THEN 'CEYTE' WHEN 2 THEN 'BARRIAL' WHEN 3 THEN 'RACAT' ELSE 'CEYTE' END WHEN c_custkey % 3 = 1 THEN NULL ELSE 'BARRIAL' END AS surveyor FROM customer""")
def surveyor_matched(spark, d):
    """Misread by a letter, words around it only, or inside a longer text."""
    k = F.col("c_custkey")
    near = F.get(F.array(*map(F.lit, ("Dressé par RACAT", "le soussigné CEYTF", "géomètre-expert BARRIAL", "cabinet RACTT", "M. CEYTE"))), (k % 5).cast("int"))
    text = F.when(k % 3 == 0, near).when(k % 3 == 1, "Cabinet géomètre expert").otherwise("qui demeure chez xBARRIALx ici")
    return C.surveyor_name(table(spark, d, "customer").select(k.alias("id"), text.alias("text")), known=("RACAT", "CEYTE", "BARRIAL"), score=edit_score).select("id", "surveyor")


@query("""WITH c AS (SELECT lower(event_type) AS k, arg_max(CAST(user_id AS VARCHAR), event_id) AS correction FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT event_id, correction FROM events LEFT JOIN c ON k = lower(event_type)""")
def learned_lookup(spark, d):
    """Every event's kind, in other signs, against what was learned."""
    e = table(spark, d, "events")
    log = e.filter("event_type <> 'error'").select(F.lit("type").alias("field"), F.lower("event_type").alias("ocr_norm"), F.col("user_id").cast("string").alias("correction"), "event_id")
    corrections = log.groupBy("field", "ocr_norm").agg(F.max_by("correction", "event_id").alias("correction"))
    readings = e.select("event_id", F.lit("type").alias("field"), F.concat(F.upper("event_type"), F.lit(" !")).alias("text"))
    return C.learned(readings, corrections).select("event_id", "correction")


@query(f"""WITH {_T} SELECT id, length(q) < 2 OR q IN ('PLAN', 'DATE') OR length(regexp_replace(q, '[^0-9]', '', 'g')) >= 0.6 * length(q) AS noise FROM (SELECT id, {_SQUEEZED.format("CASE WHEN id % 7 = 0 THEN 'Plan.' WHEN id % 7 = 1 THEN '?' ELSE text END")} AS q FROM t)""")
def noise_readings(spark, d):
    """F5."""
    text = F.when(F.col("id") % 7 == 0, "Plan.").when(F.col("id") % 7 == 1, "?").otherwise(F.col("text"))
    return _readings(spark, d).select("id", C.is_noise(X.register_key(text)).alias("noise"))


@query("""WITH g AS (SELECT user_id AS cell_id, upper(event_type) AS k, arg_min(event_type, event_id) AS text, max(value) AS prob, min(event_id) AS p FROM events GROUP BY 1, 2) SELECT cell_id, text, prob, row_number() OVER (PARTITION BY cell_id ORDER BY prob DESC, p) AS rank FROM g""")
def hypotheses_merged(spark, d):
    """A11."""
    e = table(spark, d, "events").select(F.col("user_id").alias("cell_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("text"), F.col("value").alias("prob"))
    return C.distinct_hypotheses(e).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH s AS (SELECT c_custkey AS id, c_acctbal / 100 + CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 12 ELSE -8 END + CASE WHEN c_custkey % 5 = 0 THEN 10 ELSE 0 END AS a, c_custkey FROM customer),
b AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN least(a, 45) ELSE a END AS b FROM s), c AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN least(b, 60) ELSE b END AS c FROM b), e AS (SELECT *, CASE WHEN c_custkey % 13 = 0 THEN least(c, 40) ELSE c END AS e FROM c)
SELECT id, round(CASE WHEN e > 45 THEN least(e, 100) END, 6)::DOUBLE AS score FROM e""")
def first_letter_bonus(spark, d):
    """X30."""
    k = F.col("c_custkey")
    seen = F.when(k % 3 == 1, "s").when(k % 3 == 2, "x")
    out = C.letter_adjusted(F.col("c_acctbal") / 100, seen, F.lit("Saint-Paul"), k % 5 == 0, k % 11 == 0, k % 7 == 0, k % 13 == 0)
    return table(spark, d, "customer").select(k.alias("id"), F.round(out.cast("double"), 6).alias("score"))


@query(f"""WITH n AS (SELECT upper(p_name) AS name, min(p_partkey) AS pos FROM part GROUP BY 1), q AS (SELECT DISTINCT translate(upper(p_name), 'AEO', '4E0') AS probe FROM part)
SELECT probe, name, round({_SCORE.format('probe', 'name')}, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY probe ORDER BY {_SCORE.format('probe', 'name')} DESC, pos) AS rank FROM q JOIN n ON true QUALIFY rank <= 3""")
def edits_topk(spark, d):
    """Misread names against all names, the three of the best score, ties by the names' order."""
    p = table(spark, d, "part").select(F.upper("p_name").alias("name"), F.col("p_partkey").alias("pos"))
    probes = p.select(F.translate("name", "AEO", "4E0").alias("probe"))
    out = M.top_k(probes, p, "probe", "name", 3, edit_score, pos="pos")
    return out.select("probe", "name", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_LETTERS = "regexp_replace(lower(q), '[^a-z]', '', 'g')"


@query(f"""WITH {_N}, {_T}, h AS (SELECT id // 3 AS cell_id, id AS pos, text, 0.4 + (id % 6) / 10 AS prob, {_SQUEEZED.format('text')} AS q FROM t),
j AS (SELECT cell_id, arg_min(officiel, h.pos) AS official, arg_min(code, h.pos) AS code, arg_min(text, h.pos) AS brut FROM h JOIN n ON q = k GROUP BY 1), c AS (SELECT * FROM h WHERE cell_id NOT IN (SELECT cell_id FROM j)),
f AS (SELECT DISTINCT q FROM c WHERE length(q) >= 2 AND length(regexp_replace(q, '[^0-9]', '', 'g')) < 0.6 * length(q)),
s AS (SELECT q, k, officiel, code, {_SCORE.format('q', 'k')} AS s, row_number() OVER (PARTITION BY q ORDER BY {_SCORE.format('q', 'k')} DESC, pos) AS place FROM f JOIN n ON true QUALIFY place <= 15),
b AS (SELECT *, CASE WHEN length(q) >= 4 AND starts_with(k, q) THEN least(100, s + 10) ELSE s END AS sw, CASE WHEN length(q) >= 4 AND starts_with(k, q) THEN 'prefixe' ELSE 'fuzzy' END AS methode FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY sw DESC, place) = 1),
l AS (SELECT q, {_LETTERS} AS l, list_transform(list_distinct(string_split({_LETTERS}, '')), lambda x: (length({_LETTERS}) - length(replace({_LETTERS}, x, ''))) / length({_LETTERS})) AS p FROM f),
m AS (SELECT q, length(l) AS nq, 0.4 * least(1, length(l) / 5) + 0.6 * CASE WHEN len(p) > 1 THEN -list_sum(list_transform(p, lambda x: x * log2(x))) / log2(len(p)) ELSE 0 END AS info FROM l),
e AS (SELECT c.*, officiel, code, methode, (0.7 * sw + 30 * prob) * info * greatest(0.05, exp(-0.5 * pow((ln(length(regexp_replace(k, '[^A-Z]', '', 'g')) / nq) - ln(1.3)) / 0.65, 2))) AS s FROM c JOIN b USING (q) JOIN m USING (q)),
g AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, pos) = 1), o AS (SELECT cell_id, arg_min(text, pos) AS brut FROM c GROUP BY 1)
SELECT cell_id, official, code, 100 AS score, 'abreviation' AS methode, brut FROM j UNION ALL
SELECT o.cell_id, CASE WHEN s >= 45 THEN officiel ELSE 'Non identifiée' END, CASE WHEN s >= 45 THEN code ELSE '' END, CASE WHEN s >= 45 THEN floor(s)::INT ELSE 0 END, CASE WHEN s >= 45 THEN methode ELSE 'aucun' END, CASE WHEN s >= 45 THEN text ELSE o.brut END FROM o LEFT JOIN g USING (cell_id)""")
def commune_hypotheses(spark, d):
    """Three readings are a cell's hypotheses."""
    own = _readings(spark, d).select(F.floor(F.col("id") / 3).alias("cell_id"), F.col("id").alias("pos"), "text", (0.4 + F.col("id") % 6 / 10).alias("prob"))
    out = M.match_hypotheses(own, _names(spark, d), name="officiel", code="code", pos="pos", name_pos="pos", weighted=edit_score, sort=edit_score, align=edit_score)
    return out.drop("hypotheses")


@query()
def unknown_commune(spark, d):
    """J3, M4. No SQL: informativeness and alignment are our own."""
    corrections = spark.createDataFrame([("commune", "abc", "Saint-NATION_3 le Haut")], "field string, ocr_norm string, correction string")
    return C.resolve_unknown(_readings(spark, d), _names(spark, d), corrections).select("id", "officiel", "code", "score", "methode")
