"""Registered queries of the record engine over the driver's tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import extraction as E
from ..operators import matching as M
from ..operators import records as R
from ..operators import review as V
from ..operators.shared import shared_folder
from .base import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES", "flagship"]

# DuckDB's upper() keeps ß, so both sides write ss first.
_PLAIN = "upper(strip_accents(replace({0}, 'ß', 'ss')))"
_KEY = "trim(regexp_replace(" + _PLAIN + ", '[^A-Z0-9]+', ' ', 'g'))"
_SAINTS = "trim(regexp_replace(regexp_replace(regexp_replace(" + _PLAIN + r", '\bST\b', 'SAINT', 'g'), '\bSTE\b', 'SAINTE', 'g'), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_KEY.format('text')} AS key, length({_KEY.format('text')}) AS n, {_SAINTS.format('text')} AS corrector_key FROM documents")
def normalize_text(spark, d):
    """N2, N3."""
    key = X.register_key("text")
    return table(spark, d, "documents").select("doc_id", key.alias("key"), F.length(key).cast("long").alias("n"), X.corrector_key("text").alias("corrector_key"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def normalize_label(spark, d):
    """N6."""
    return table(spark, d, "documents").select("doc_id", X.label_key("text").alias("key"))


@query("SELECT doc_id, text AS repaired FROM documents")
def mojibake_repair(spark, d):
    """Texts read in the wrong encoding are repaired to what they were."""
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", X.repair_mojibake(damaged).alias("repaired"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\b[0-9]+\b') AS w FROM (SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', 'x', 'g') AS text FROM documents)),
u AS (SELECT doc_id, list_filter(list_transform(list_filter(w, lambda x: length(regexp_replace(x, '^0+', '')) <= 9), lambda x: CAST(x AS INTEGER)), lambda n: n BETWEEN 1 AND 9999) AS n FROM t)
SELECT doc_id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS numbers FROM u""")
def numeric_tokens(spark, d):
    """C7."""
    return table(spark, d, "documents").select("doc_id", F.array_join(X.numeric_tokens("text"), ",").alias("numbers"))


@query("""SELECT o_orderkey, CASE WHEN y <= 7 THEN 2000 ELSE 1900 END + y AS d2, CASE WHEN y <= 30 THEN 2000 ELSE 1900 END + y AS d4, CASE WHEN y <= 49 THEN 2000 ELSE 1900 END + y AS d7,
CASE WHEN y <= 35 THEN 2000 ELSE 1900 END + y AS d8 FROM (SELECT o_orderkey, year(o_orderdate) % 100 AS y FROM orders)""")
def two_digit_year_pivot(spark, d):
    """The pivot that D2, D4, D7 and D8 have in common; the functions themselves are in years_and_dates."""
    y = F.year("o_orderdate") % 100
    return table(spark, d, "orders").select("o_orderkey", *[X.pivot(y, k).cast("long").alias(n) for n, k in (("d2", 7), ("d4", 30), ("d7", 49), ("d8", 35))])


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%d/%m/%Y') AS compact, year(o_orderdate) % 100 AS year2 FROM orders""")
def date_formats(spark, d):
    """Dates written in three ways and read again."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", X.iso_date(F.date_format("o_orderdate", "d.M.yyyy")).alias("iso"), X.compact_date(F.date_format("o_orderdate", "ddMMyyyy")).alias("compact"), X.year_of_date(F.date_format("o_orderdate", "dd/MM/yyyy")).cast("long").alias("year2"))


@query("""SELECT o_orderkey, lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey < 100 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS hb,
lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '/' || o_orderkey AS rc, lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || o_orderkey AS dupuy FROM orders""")
def reference_build(spark, d):
    """C13."""
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", X.reference_hb(y % 100, "o_orderkey").alias("hb"), X.reference_rc(y, "o_orderkey").alias("rc"), X.reference_dupuy(y, F.concat(F.lit("00"), "o_orderkey")).alias("dupuy"))


_SEGMENTS = {"AUTOMOBILE": "Em", "BUILDING": "Eb", "MACHINERY": "Hb"}


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Em' WHEN 'BUILDING' THEN 'Eb' WHEN 'MACHINERY' THEN 'Hb' ELSE '' END AS label FROM customer""")
def code_map(spark, d):
    """C12, J24."""
    return R.code_map(table(spark, d, "customer").withColumn("_k", F.lower("c_mktsegment")), "_k", _SEGMENTS).select("c_custkey", "label")


@query("""WITH names AS (SELECT DISTINCT p_name AS n FROM part), probes AS (SELECT DISTINCT substr(p_name, 1, CAST(6 + p_partkey % 20 AS INTEGER)) AS probe FROM part),
pre AS (SELECT probe, min(n) AS n FROM probes JOIN names ON starts_with(n, probe) WHERE length(probe) >= 4 GROUP BY probe HAVING count(*) = 1)
SELECT p.probe, coalesce(e.n, pre.n) AS matched, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN pre.n IS NOT NULL THEN 'prefix' END AS method FROM probes p LEFT JOIN names e ON e.n = p.probe LEFT JOIN pre ON pre.probe = p.probe""")
def exact_prefix_match(spark, d):
    """J4, the first two steps."""
    part = table(spark, d, "part")
    return R.exact_or_prefix(part.select(F.expr("substr(p_name, 1, cast(6 + p_partkey % 20 as int))").alias("probe")).distinct(), part, "probe", "p_name")


@query("""WITH j AS (SELECT o_orderkey, l_linenumber, l_suppkey % 3 = o_custkey % 3 AS p1, year(l_shipdate) = year(o_orderdate) AS p2, CAST(l_quantity AS BIGINT) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
a AS (SELECT * FROM (SELECT *, bool_or(p1) OVER (PARTITION BY o_orderkey) AS any1 FROM j) WHERE p1 OR NOT any1),
b AS (SELECT * FROM (SELECT *, bool_or(p2) OVER (PARTITION BY o_orderkey) AS any2 FROM a) WHERE p2 OR NOT any2),
c AS (SELECT *, max(q) OVER (PARTITION BY o_orderkey) AS top, count(*) OVER (PARTITION BY o_orderkey) AS n FROM b),
e AS (SELECT o_orderkey, l_linenumber FROM c WHERE n = 1 OR top < 20 OR q = top)
SELECT o_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, CASE WHEN count(*) OVER (PARTITION BY o_orderkey) = 1 THEN 'MATCH_UNIQUE' ELSE 'CANDIDATS' END AS status FROM e
UNION ALL SELECT o_orderkey, NULL, 'NO_MATCH' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def lookup_cascade(spark, d):
    """The filters of J12, W2: filters that are ignored where they would leave nothing, then the best score, then a status."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", (F.col("l_suppkey") % 3 == F.col("o_custkey") % 3).alias("p1"), (F.year("l_shipdate") == F.year("o_orderdate")).alias("p2"), F.col("l_quantity").cast("long").alias("q"))
    found = R.cascade(rows, ["o_orderkey"], [F.col("p1"), F.col("p2")], F.col("q"), 20).select("o_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "status")
    return R.with_unmatched(o, found, ["o_orderkey"])


@query("""WITH j AS (SELECT c_custkey, o_orderkey, abs(year(o_orderdate) - (1992 + c_custkey % 7)) AS gap FROM customer JOIN orders ON o_custkey = c_custkey),
m AS (SELECT *, min(gap) OVER (PARTITION BY c_custkey) AS least FROM j)
SELECT c_custkey, o_orderkey FROM m WHERE CASE WHEN least = 0 THEN gap = 0 WHEN least <= 2 THEN gap <= 2 ELSE true END""")
def lookup_range_year(spark, d):
    """J15's year step: the year, else two years around it, else all."""
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", F.abs(F.year("o_orderdate") - (1992 + F.col("c_custkey") % 7)).alias("gap"))
    return R.cascade(j, ["c_custkey"], [F.col("gap") <= 2, F.col("gap") == 0]).select("c_custkey", "o_orderkey")


@query("""SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS line, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey) AS x1, max(l_suppkey) AS y1, CAST(floor(avg(l_quantity)) AS BIGINT) AS conf FROM lineitem GROUP BY l_orderkey""")
def lines_from_words(spark, d):
    """A1."""
    li = table(spark, d, "lineitem").withColumn("t", F.concat("l_returnflag", "l_linestatus"))
    return R.lines_from_words(li, ["l_orderkey"], "l_linenumber", "t", ("l_partkey", "l_suppkey", "l_partkey", "l_suppkey"), "l_quantity")


@query("""SELECT p_name || ' ' || p_size AS form, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1""")
def ambiguous_forms(spark, d):
    """A2."""
    return R.sole_owners(table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("form"), "p_brand"), "form", "p_brand")


@query("""WITH b AS (SELECT s_suppkey // 20 AS page, s_suppkey AS block_id, CAST(s_suppkey * 37 % 800 AS DOUBLE) AS x0, CAST(s_suppkey * 53 % 900 AS DOUBLE) AS y0 FROM supplier),
j AS (SELECT l.page, l.block_id AS label_id, v.block_id, v.x0 - (l.x0 + 80) AS gx, v.y0 - (l.y0 + 20) AS gy, greatest(0, least(l.y0, v.y0) + 20 - greatest(l.y0, v.y0)) AS oy, greatest(0, least(l.x0, v.x0) + 80 - greatest(l.x0, v.x0)) AS ox, abs(v.x0 - l.x0) AS s
FROM b l JOIN b v ON l.page = v.page AND l.block_id <> v.block_id WHERE l.block_id % 4 = 0),
t AS (SELECT *, CASE WHEN oy >= 8 AND gx >= 0 AND gx <= 600 THEN 1 WHEN gy >= 0 AND gy <= 150 AND ox >= 24 THEN 2 WHEN gy >= 0 AND gy <= 150 THEN 3 END AS tier FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY page, label_id ORDER BY tier, CASE tier WHEN 1 THEN gx WHEN 2 THEN gy + 0.5 * s ELSE gy + 2 * s END, block_id) AS k FROM t WHERE tier IS NOT NULL)
SELECT page, label_id, block_id, tier FROM r WHERE k = 1""")
def nearest_value(spark, d):
    """Each label's nearest value block."""
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select(F.floor(k / 20).alias("page"), k.alias("block_id"), (k * 37 % 800).cast("double").alias("x0"), (k * 53 % 900).cast("double").alias("y0"))
    b = b.withColumns({"x1": F.col("x0") + 80, "y1": F.col("y0") + 20})
    labels = b.filter("block_id % 4 = 0").select("page", F.col("block_id").alias("label_id"), F.col("block_id").alias("label_block"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    return R.nearest_values(labels, b, ["page"], F.lit(1000.0), F.lit(1000.0))


@query("""SELECT p_partkey FROM (SELECT p_partkey, (p_partkey * 31 % 1000 + 25) / 1000.0 AS cx, (p_partkey * 17 % 1000 + 10) / 1000.0 AS cy FROM part) WHERE cx BETWEEN 0.1 AND 0.6 AND cy BETWEEN 0.25 AND 0.75""")
def zone_filter(spark, d):
    """F2, M12."""
    k = F.col("p_partkey")
    b = table(spark, d, "part").withColumns({"x0": k * 31 % 1000, "y0": k * 17 % 1000}).withColumns({"x1": F.col("x0") + 50, "y1": F.col("y0") + 20})
    return b.filter(R.in_zone("x0", "y0", "x1", "y1", F.lit(1000), F.lit(1000), (0.1, 0.25, 0.6, 0.75))).select("p_partkey")


@query("""WITH v AS (SELECT user_id, lower(event_type) AS value, count(*) AS votes, max(value) AS best FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, best DESC, value) AS k FROM v)
SELECT user_id, value, votes, best FROM r WHERE k = 1""")
def vote(spark, d):
    """A10."""
    return R.vote(table(spark, d, "events").withColumnRenamed("value", "conf"), ["user_id"], "event_type", "conf")


@query("""SELECT conv_id, role, CASE WHEN role = 'assistant' THEN arg_max(text, turn) ELSE arg_min(text, turn) END AS text FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id, role""")
def page_merge(spark, d):
    """First page wins, for one field the last. A turn that is given twice counts once."""
    c = table(spark, d, "conversations").groupBy("conv_id", "role", "turn").agg(F.min("text").alias("text"))
    return R.merge_pages(c, ["conv_id"], "turn", "role", "text", ("assistant",))


def _order_rules():
    c = F.col
    return [
        ("PRIX_HORS_PLAGE", "ERREUR", c("o_totalprice") > 400000, ["prix"]),
        ("PRIORITE_ABSENTE", "ALERTE", c("o_orderpriority").contains("NOT"), ["priorite"]),
        ("DATE_TARDIVE", "ALERTE", F.year("o_orderdate") >= 1998, ["date"]),
        ("PRIX_HORS_PLAGE", "ALERTE", c("o_totalprice") > 300000, ["prix"]),
        ("STATUT_PARTIEL", "INFO", c("o_orderstatus") == "P", ["statut"]),
    ]


_ISSUES = """SELECT o_orderkey, 'PRIX_HORS_PLAGE' AS rule, 'prix' AS fields, CASE WHEN o_totalprice > 400000 THEN 'ERREUR' ELSE 'ALERTE' END AS level FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT o_orderkey, 'PRIORITE_ABSENTE', 'priorite', 'ALERTE' FROM orders WHERE contains(o_orderpriority, 'NOT')
UNION ALL SELECT o_orderkey, 'DATE_TARDIVE', 'date', 'ALERTE' FROM orders WHERE year(o_orderdate) >= 1998
UNION ALL SELECT o_orderkey, 'STATUT_PARTIEL', 'statut', 'INFO' FROM orders WHERE o_orderstatus = 'P'"""


@query(_ISSUES)
def rules_issues(spark, d):
    """A5, by rules on orders; V1-V8 are plan_rules()."""
    return R.issues(table(spark, d, "orders"), ["o_orderkey"], _order_rules())


@query(f"""WITH i AS ({_ISSUES}), n AS (SELECT o_orderkey, count(*) FILTER (level = 'ERREUR') AS errors, count(*) FILTER (level = 'ALERTE') AS alerts, count(*) FILTER (level = 'INFO') AS infos FROM i GROUP BY 1),
a AS (SELECT o_orderkey, coalesce(errors, 0) AS errors, coalesce(alerts, 0) AS alerts, coalesce(infos, 0) AS infos FROM orders LEFT JOIN n USING (o_orderkey))
SELECT *, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - 0.25::DOUBLE * errors - 0.08::DOUBLE * alerts), 2) AS score, CASE WHEN errors > 0 THEN 'REJET' WHEN alerts > 0 THEN 'ALERTE' ELSE 'CONFORME' END AS status FROM a""")
def coherence_score(spark, d):
    """A6."""
    o = table(spark, d, "orders")
    return R.scored(o, ["o_orderkey"], _order_rules())


@query("""SELECT level, fields, count(*) AS n FROM (SELECT level, unnest(string_split(fields, ',')) AS fields FROM (""" + _ISSUES + """)) GROUP BY ALL""")
def issues_by_field(spark, d):
    """A7."""
    i = R.issues(table(spark, d, "orders"), ["o_orderkey"], _order_rules())
    return V.issues_by_field(i).select("level", "fields", "n")


@query("""SELECT page_id, greatest(a, b, c) AS hits, CASE WHEN greatest(a, b, c) = 0 THEN 'Type Inconnu' WHEN a = greatest(a, b, c) THEN 'list' WHEN b = greatest(a, b, c) THEN 'table' ELSE 'links' END AS kind FROM (SELECT page_id,
contains(lower(html), '<li')::INT + contains(lower(html), '<ul')::INT AS a, contains(lower(html), '<table')::INT + contains(lower(html), '<td')::INT AS b, contains(lower(html), '<a ')::INT + contains(lower(html), 'href')::INT AS c FROM pages)""")
def keyword_class(spark, d):
    """A8."""
    kinds = {"list": ("<li", "<ul"), "table": ("<table", "<td"), "links": ("<a ", "href")}
    return R.keyword_class(table(spark, d, "pages"), "html", kinds).select("page_id", "hits", "kind")


@query("""SELECT DISTINCT w AS word, levenshtein(w, 'commune') AS distance FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE levenshtein(w, 'commune') <= 6""")
def edit_distance_label(spark, d):
    """M6."""
    w = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return M.within_edits(w, "word", "commune", 6).withColumn("distance", F.col("distance").cast("long"))


@query("""WITH f AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), first AS (SELECT min(vec_id) AS v FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, f WHERE vec_id <> (SELECT v FROM first) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 10""")
def cosine_topk(spark, d):
    """The ten vectors nearest to the first; one row is broadcast."""
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("_v"), F.col("embedding").alias("_q"))
    s = e.join(F.broadcast(first), F.col("vec_id") != F.col("_v")).withColumn("s", X.cosine("embedding", "_q"))
    return s.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


def _lines(spark, d):
    """Operations as lines: customer k is a mother of customers 3k and 3k + 1 of its nation's code, as far as there are such."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = c.agg(F.max("k").alias("n"))
    line = lambda kind, parcels: F.concat_ws(";", F.lit("070"), F.lit("001"), F.lit(""), F.col("k").cast("string"), *[F.lit("")] * 4, F.lit("1"), F.lit(kind), *parcels)
    parcel = lambda k: F.concat(F.lit("A"), k.cast("string"))
    own = c.join(F.broadcast(n)).filter("k > 0 and 3 * k <= n")
    two = [parcel(F.col("k") * 3), F.when(F.col("k") * 3 + 1 <= F.col("n"), parcel(F.col("k") * 3 + 1))]
    return own.select(line("1", [parcel(F.col("k"))]).alias("value")).unionByName(own.select(line("2", two).alias("value")))


_EDGES = """SELECT p.c_custkey AS parent, c.c_custkey AS child FROM customer p JOIN customer c ON p.c_custkey > 0 AND c.c_custkey // 3 = p.c_custkey AND c.c_custkey % 3 < 2 WHERE 3 * p.c_custkey <= (SELECT max(c_custkey) FROM customer)"""
_NUMBER = "CASE WHEN {0} < 1000 THEN lpad(CAST({0} AS VARCHAR), 4, '0') ELSE CAST({0} AS VARCHAR) END"


@query(f"SELECT '07001' AS insee, 'A' AS section, {_NUMBER.format('parent')} AS parent, {_NUMBER.format('child')} AS child FROM ({_EDGES})")
def lineage_edges(spark, d):
    """Parsing, and the join of mothers and daughters of an operation."""
    return R.lineage_edges(_lines(spark, d)).select("parent.insee", "parent.section", F.col("parent.numero").alias("parent"), F.col("child.numero").alias("child"))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT c_custkey AS seed, c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT seed, child, depth + 1 FROM w JOIN e ON node = parent WHERE depth < 10)
SELECT DISTINCT {_NUMBER.format('seed')} AS seed, {_NUMBER.format('node')} AS leaf FROM w WHERE node NOT IN (SELECT parent FROM e)""")
def lineage_leaves(spark, d):
    """The parcels in force that each parcel became."""
    edges = R.lineage_edges(_lines(spark, d))
    seeds = table(spark, d, "customer").select(F.struct(F.lit("07001").alias("insee"), F.lit("A").alias("section"), X.zero_filled(F.col("c_custkey"), 4).alias("numero")).alias("seed"))
    return R.leaves(seeds, edges).select(F.col("seed.numero").alias("seed"), F.col("leaf.numero").alias("leaf"))


@query("""SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey % 2 = 0) UNION ALL SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0)""")
def anti_append(spark, d):
    """Own rows and those of another table whose key is missing."""
    own = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select("s_nationkey", "s_suppkey")
    return R.append_missing(own, table(spark, d, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.col("c_custkey").alias("s_suppkey")), "s_nationkey")


@query("""WITH e AS (SELECT user_id, arg_max(event_type, event_id) AS new FROM events GROUP BY 1) SELECT c_custkey, coalesce(new, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN e ON user_id = c_custkey""")
def edit_overlay(spark, d):
    """The last edit of a key replaces its value."""
    edits = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("new_value"), "event_id")
    return R.overlay(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), edits, "c_custkey", "c_mktsegment", "event_id")


@query("""SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'F') / count(*) AS progress FROM orders GROUP BY 1""")
def review_progress(spark, d):
    """A15."""
    return V.progress(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("""SELECT lower(event_type) AS ocr_norm, 'type' AS field, arg_max(CAST(user_id AS VARCHAR), event_id) AS correction, count(*) AS count FROM events GROUP BY 1""")
def learned_corrections(spark, d):
    """T3."""
    log = table(spark, d, "events").select(F.lit("type").alias("field"), F.col("event_type").alias("ocr_value"), F.col("user_id").cast("string").alias("correction"), F.col("event_id").alias("ts"))
    return R.learn_corrections(log)


@query("""SELECT 'type' AS field, lower(event_type) AS ocr_norm, arg_max(CAST(user_id AS VARCHAR), event_id) AS correction, count(*) AS count FROM events GROUP BY 2""")
def learned_stream(spark, d):
    """T3 as a stream with state: the events are read as a stream of corrections until none is left."""
    from ..streaming import corrections as L

    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet")  # a pattern, as a stream takes no single file
    log = source.select(F.lit("type").alias("field"), F.col("event_type").alias("ocr_value"), F.col("user_id").cast("string").alias("correction"), F.col("event_id").alias("ts"))
    folder = shared_folder(spark)

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/learned")

    L.learned(log).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/learned").groupBy("field", "ocr_norm").agg(F.max_by(F.struct("correction", "count"), "batch").alias("b"))
    return found.select("field", "ocr_norm", "b.correction", "b.count")


def _statut():
    return F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "OK (sans document)").otherwise("ECHEC")


@query("""SELECT row_number() OVER (ORDER BY upper(o_orderpriority), o_orderdate, o_orderkey) AS place, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'OK (sans document)' ELSE 'ECHEC' END AS statut FROM orders""")
def register_sorted(spark, d):
    """Every row of the sorted register with its place and status."""
    o = table(spark, d, "orders").select(F.upper("o_orderpriority").alias("_priority"), "o_orderdate", "o_orderkey", _statut().alias("statut"))
    return R.with_places(o, [F.col("_priority"), F.col("o_orderdate"), F.col("o_orderkey")]).select("place", "o_orderkey", "statut")


@query("""SELECT c_custkey, CASE WHEN length(s) = 0 THEN NULL ELSE s END AS section FROM (SELECT c_custkey, substr(regexp_replace(upper(c_mktsegment), '[^A-Z0-9]', '', 'g'), 1, 2) AS s FROM customer)""")
def section_format(spark, d):
    """C4."""
    return table(spark, d, "customer").select("c_custkey", X.format_section("c_mktsegment").alias("section"))


@query("""SELECT p_partkey, (SELECT arg_min(s, abs(p_size * 100 - s) * 100000::BIGINT + s) FROM (VALUES (200), (500), (1000), (1250), (2000), (2500), (5000), (10000), (25000)) t(s)) AS scale, '1/' || (p_size * 10 + 100) AS written FROM part""")
def scale_format(spark, d):
    """C5, C21."""
    n = F.col("p_size") * 10 + 100
    return table(spark, d, "part").select("p_partkey", X.nearest_scale(F.col("p_size") * 100).alias("scale"), X.format_scale(F.concat(F.lit("1 : "), n.cast("string"))).alias("written"))


@query("""SELECT part.p_partkey, part.p_name, first.p_partkey AS first_partkey FROM part JOIN (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1) first USING (p_name)""")
def first_by_position(spark, d):
    """The first row of equal names."""
    p = table(spark, d, "part")
    return p.select("p_partkey", "p_name", F.min("p_partkey").over(W.partitionBy("p_name")).alias("first_partkey"))


@query()
def fuzzy_topk(spark, d):
    """Brand-like probes against part types. No SQL: the score is our own."""
    p = table(spark, d, "part")
    probes = p.select(F.translate(F.upper("p_type"), "AEO", "4E0").alias("probe")).distinct()
    return M.top_k(probes, p.select(F.upper("p_type").alias("name")), "probe", "name", 3)


@query()
def alignment_score(spark, d):
    """M1, K2. No SQL: the recurrence is our own."""
    p = table(spark, d, "part").select("p_partkey", F.upper("p_type").alias("name"), F.upper("p_name").alias("probe"))
    return p.withColumn("alignment", S.alignment_col(F.col("probe"), F.col("name")))


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS a, length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS n, length(regexp_replace(p_type || ' 12', '[^A-Za-z]', '', 'g')) AS m, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS w FROM part),
c AS (SELECT p_partkey, unnest(string_split(w, '')) AS ch FROM (SELECT DISTINCT ON (p_partkey) p_partkey, w FROM p) WHERE w <> ''), f AS (SELECT p_partkey, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY 1, 2), h AS (SELECT p_partkey, sum(k) AS t, count(*) AS u FROM f GROUP BY 1),
e AS (SELECT p_partkey, -sum(k / t * log2(k / t)) AS e FROM f JOIN h USING (p_partkey) GROUP BY 1)
SELECT p.p_partkey, round(0.4 * least(1, t / 5) + 0.6 * CASE WHEN u > 1 THEN e / log2(u) ELSE 0 END, 6)::DOUBLE AS informativeness, round(greatest(0.05, exp(-0.5 * pow((ln(m / n) - ln(1.3)) / 0.65, 2))), 6)::DOUBLE AS coherence FROM p JOIN h USING (p_partkey) JOIN e USING (p_partkey)""")
def reading_quality(spark, d):
    """M2, M3."""
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(X.informativeness("p_name"), 6).alias("informativeness"), F.round(X.length_coherence("p_name", F.concat("p_type", F.lit(" 12"))), 6).alias("coherence"))


@query()
def label_match(spark, d):
    """Blocks that contain or resemble a label."""
    p = table(spark, d, "part")
    return M.label_matches(p.select("p_partkey", F.col("p_name").alias("text")), p.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("label")).distinct())


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE '{"enr_cab_createur":"' || CASE WHEN c_custkey % 2 = 0 THEN '1965I002702' ELSE '2000X00001' END || '","enr_ref_dossier":"97_' || c_custkey || '","enr_cab_detenteur":"2000X00001","enr_ge_createur":"' || CASE WHEN c_custkey % 2 = 0 THEN '02702' ELSE '00001' END
|| '","enr_code_insee":"07186","enr_date_dossier":"1997-06-22","op_code":["Em"],"enr_visible":false,"enr_statut":"en production","enr_memo":"Archive importée automatiquement. Commune: ' || c_name || '"' || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE ',"cadastre":[{"cad_prefixe":"000","cad_section":"' || substr(c_mktsegment, 1, 2) || '","cad_parcelle":' || c_custkey || '},{"cad_prefixe":"000","cad_section":"' || substr(c_mktsegment, 1, 2) || '","cad_parcelle":' || c_nationkey || '}]' END
|| ',"dmpc_ref":[{"dmpc_prefixe":"070","dmpc_ref":"' || c_custkey || 'J"}]}' END AS payload, CASE WHEN c_custkey % 10 = 9 THEN 'ECHEC - ref_dossier manquante' ELSE 'OK' END AS status FROM customer""")
def publication_payload(spark, d):
    """Records without a reference have no payload, those without a section no parcels."""
    c, none = table(spark, d, "customer"), F.lit(None).cast("double")
    rows = c.select(
        F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 10 != 9, F.concat(F.lit("97 "), "c_custkey")).alias("ref_dossier"), F.when(F.col("c_custkey") % 2 == 0, "dupuy").otherwise("x").alias("geometre"),
        F.col("c_name").alias("commune"), F.lit("07186").alias("code_insee"), F.lit("22.06.97").alias("date_dossier"), F.lit(1999).alias("annee_full"), F.lit("En cours").alias("enr_statut"),
        F.when(F.col("c_mktsegment") != "BUILDING", X.format_section("c_mktsegment")).alias("section"), F.concat_ws(" & ", "c_custkey", "c_nationkey").alias("parcelles"), F.concat(F.lit("00"), "c_custkey", F.lit("j")).alias("n_ordre"),
        F.array(F.lit("Em")).alias("op_code"), none.alias("lat"), none.alias("lon"),
    )
    return R.payload(rows, "2000X00001", firms={"DUPUY": "1965I002702"})


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER w = 1 THEN 'all' WHEN l_linenumber = 1 THEN 'entete' WHEN l_linenumber = count(*) OVER w THEN 'signatures' ELSE 'corps' END AS role FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def page_role(spark, d):
    """X26."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.page_role("l_linenumber", F.count("*").over(W.partitionBy("l_orderkey"))).alias("role"))


@query("""WITH t AS (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n, greatest(3, CAST(floor(count(*) OVER (PARTITION BY user_id) * 0.3) AS BIGINT)) AS line FROM events)
SELECT event_id, CAST(CASE WHEN n >= line THEN greatest(0, 75 - least(40, (n - line + 1) * 10)) ELSE 75 END AS DOUBLE) AS score FROM t""")
def frequency_penalty(spark, d):
    """A14."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.lit(75).alias("score"))
    return E.frequency_penalty(e, ["user_id"], "event_type").select("event_id", "score")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1993-01-01' AND '1996-06-30' ORDER BY o_orderkey LIMIT 50 OFFSET 20""")
def record_search(spark, d):
    """The third page of a search."""
    o = table(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return E.search(o, {"o_orderstatus": "F"}, "day", "1993-01-01", "1996-06-30", ("o_orderkey",), 20, 50).select("o_orderkey", "o_totalprice")


@query("""WITH m AS (SELECT user_id AS o_orderkey, min(event_type) AS r FROM events WHERE trim(event_type) <> '' GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'MATCH_UNIQUE' WHEN r IS NULL THEN 'NO_MATCH' ELSE 'MANUEL' END AS status,
CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority ELSE r END AS reference, CASE WHEN o_orderstatus <> 'F' THEN 'Em' WHEN r IS NOT NULL THEN 'Da' END AS op_code FROM orders LEFT JOIN m USING (o_orderkey)""")
def manual_reference(spark, d):
    """Typed references stand in for missing matches."""
    hit = F.col("o_orderstatus") != "F"
    found = table(spark, d, "orders").select("o_orderkey", F.when(hit, "MATCH_UNIQUE").otherwise("NO_MATCH").alias("status"), F.when(hit, F.col("o_orderpriority")).alias("reference"), F.when(hit, "Em").alias("op_code"))
    typed = table(spark, d, "events").select(F.col("user_id").alias("o_orderkey"), F.col("event_type").alias("reference"), F.lit("Da").alias("op_code"))
    return E.manual_references(found, typed, ["o_orderkey"])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Register matches of coherent orders."""
    return lookup_cascade(spark, d).withColumnRenamed("status", "match").join(coherence_score(spark, d), "o_orderkey")



from . import communes, documents, fields, registers, review, scalars  # noqa: E402, F401  these register their queries
