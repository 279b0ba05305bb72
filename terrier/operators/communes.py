"""Which commune, or which surveyor, a reading means.

Names are a table (officiel, code, pos), ``pos`` being their order, which breaks ties. Every matcher holds the distinct keys
of the readings against those of the names by candidates.near, so the rule is the same at any number of names; a score is a
function of two key columns that has a batch form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import similarity as S
from ..functions import text as X
from . import matching as M
from . import records as R
from .candidates import near

Score = Callable[[Column, Column], Column]
#: Articles and prepositions that short forms leave out.
ARTICLES = ("LA", "LE", "LES", "DE", "DU", "DES", "EN", "SUR", "SOUS", "ET", "L", "D", "AU", "AUX", "PAR", "ST", "STE")
#: Readings of a commune's cell that name no commune.
NO_COMMUNE = (
    "COMMUNE", "COMMUNES", "COMMUNE DE", "LA COMMUNE", "NOM DE LA COMMUNE", "DESIGNATION", "DONNEUR D ORDRE", "DATE", "DOSSIER", "PRIX", "FACTURATION",
    "LOTISSEMENT", "CHEMIN", "PARCELLE", "DIVISION", "PLAN", "TOPO", "BORNAGE",
)
#: Words of a block that rule out a commune's name.
NO_NAME = ("PLAN", "DOCUMENT", "MODIFICATIF", "PARCELLAIRE", "EXTRAIT", "ECHELLE", "SECTION", "FEUILLE", "DATE", "OBJET", "DOSSIER", "NUMERO", "NORD", "ARRET", "VENTE")
#: Words around a surveyor's name.
AROUND_SURVEYOR = (
    "expert", "cabinet", "geometre", "géomètre", "dresse", "dressé", "par", "le", "soussigne", "soussigné", "géomètre-expert", "geometre-expert", "m.", "mr.", "mme", "mme.",
    "inspecteur", "finances", "publiques", "publique", "des", "la", "et", "soussignée",
)
#: Marks that a reading may begin with.
READING_MARKS = ("[COL_COMMUNE] -> ", "[COL_COMMUNE]", "-> ")


def short_forms(names: DataFrame, name: str = "officiel") -> DataFrame:
    """(forme, officiel): each name's key, its first significant word (four letters or more) and its first two; forms of
    several names are left out. Words of three letters or more that are no articles are significant; SAINT and SAINTE are not.
    """
    key = X.match_key(name)
    words = F.filter(F.transform(F.split(key, " "), lambda w: F.when(w == "SAINT", "ST").when(w == "SAINTE", "STE").otherwise(w)), lambda w: ~w.isin(*ARTICLES) & (F.length(w) >= 3))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    forms = F.array(key, F.when(F.length(first) >= 4, first), F.when(second.isNotNull(), F.concat_ws(" ", first, second)))
    long = names.select(F.explode(F.filter(forms, lambda f: f.isNotNull())).alias("forme"), F.col(name).alias("officiel"))
    return R.sole_owners(long, "forme", "officiel")


def reading_key(c: Column | str) -> Column:
    """N1 of a reading without the marks in front."""
    out = X.col(c)
    for mark in READING_MARKS:
        out = F.regexp_replace(out, rf"(?s)^\Q{mark}\E\s*(.*?)\s*$", "$1")
    return X.match_key(out)


def by_short_form(readings: DataFrame, forms: DataFrame, cell: str = "cell_id", pos: str = "pos", text: str = "text") -> DataFrame:
    """The first reading of each cell that is a short form: cell, officiel, brut, score 100."""
    hit = readings.withColumn("_k", reading_key(text)).join(R.small(forms), F.col("_k") == F.col("forme"))
    return hit.groupBy(cell).agg(F.min_by(F.struct("officiel", F.col(text).alias("brut")), pos).alias("b")).select(cell, "b.officiel", "b.brut", F.lit(100.0).alias("score"))


def is_noise(key: Column) -> Column:
    """keys under two signs, keys that name no commune, keys of which 60 % are digits."""
    return (F.length(key) < 2) | key.isin(*NO_COMMUNE) | (F.length(F.regexp_replace(key, "[^0-9]", "")) >= 0.6 * F.length(key))


def ranked(readings: DataFrame, names: DataFrame, reading: Column, name: Column, least: float, score: Score, k: int | None = None) -> DataFrame:
    """(_q, _n, _score, officiel, code, _pos): each distinct reading key with the names that score ``least`` or more; with k, with the k best at least."""
    q = readings.select(reading.alias("_q")).filter("_q <> ''").distinct()
    n = names.select(name.alias("_n"), "officiel", "code", F.col("pos").alias("_pos")).filter("_n <> ''")
    return near(q, n, "_q", "_n", score, least, k).join(R.small(n), "_n")


def _best(pairs: DataFrame, *order: Column) -> DataFrame:
    """The first name of each reading key."""
    return pairs.withColumn("_k", F.row_number().over(W.partitionBy("_q").orderBy(*order))).filter("_k = 1").drop("_k")


def _by_code(readings: DataFrame, names: DataFrame, text: str, pattern: str) -> Column:
    code = F.when(F.trim(text).rlike(pattern), F.when(F.length(F.trim(text)) == 5, F.trim(text)).otherwise(F.concat(F.lit("07"), F.trim(text))))
    return code


def match_name(readings: DataFrame, names: DataFrame, text: str = "text", score: Score = S.token_set_col, tie: Score = S.ratio_col) -> DataFrame:
    """Readings with ``matched``: the name of an INSEE code (five digits, or three of department 07); a reading that is a code but of
    no name stays; keys under four signs stay; the equal name; the best score from 80, ties by ``tie``, then order (short keys, under
    six, need 90); else the reading.
    """
    own = readings.withColumns({"_code": _by_code(readings, names, text, r"^(?:07)?\d{3}$"), "_q": X.loose_key(text)})
    n = names.withColumn("_key", X.loose_key("officiel"))
    first = lambda key: n.groupBy(key).agg(F.min_by("officiel", "pos").alias("_name"))
    out = own.join(R.small(first("code").withColumnsRenamed({"code": "_c", "_name": "_by_code"})), F.col("_code") == F.col("_c"), "left")
    out = out.join(R.small(first("_key").withColumnsRenamed({"_key": "_e", "_name": "_exact"})), F.col("_q") == F.col("_e"), "left")
    todo = out.filter("_code is null and _exact is null and length(_q) >= 4")
    pairs = ranked(todo, names, F.col("_q"), X.loose_key("officiel"), 80, score, 1)
    top = pairs.withColumn("_top", F.max("_score").over(W.partitionBy("_q"))).filter((F.col("_score") == F.col("_top")) & ((F.length("_q") >= 6) | (F.col("_top") >= 90)))
    fuzzy = _best(top.withColumn("_tie", tie(F.col("_q"), F.col("_n"))), F.desc("_tie"), F.col("_pos")).select(F.col("_q").alias("_f"), F.col("officiel").alias("_fuzzy"))
    out = out.join(fuzzy, F.col("_q") == F.col("_f"), "left")
    matched = F.when(F.col("_code").isNotNull(), F.coalesce("_by_code", text)).when(F.length("_q") < 4, F.col(text)).otherwise(F.coalesce("_exact", "_fuzzy", text))
    return out.withColumn("matched", matched).select(*readings.columns, "matched")


def score_name(readings: DataFrame, names: DataFrame, text: str = "text", least: float = 78, score: Score = S.token_set_col) -> DataFrame:
    """Readings with ``matched``, ``score`` and ``known``: the equal name but for case (100), else the best score; below ``least`` the reading itself, not known."""
    n = names.groupBy(F.lower("officiel").alias("_l")).agg(F.min_by("officiel", "pos").alias("_exact"))
    out = readings.withColumn("_q", X.loose_key(text)).join(R.small(n), F.lower(text) == F.col("_l"), "left")
    pairs = ranked(out.filter("_exact is null"), names, F.col("_q"), X.loose_key("officiel"), 0, score, 1)
    best = _best(pairs, F.desc("_score"), F.col("_pos")).select(F.col("_q").alias("_f"), F.col("officiel").alias("_fuzzy"), F.col("_score").alias("_s"))
    out = out.join(best, F.col("_q") == F.col("_f"), "left")
    exact, near = F.col("_exact").isNotNull(), F.coalesce(F.col("_s") >= least, F.lit(False))
    found = {"matched": F.when(exact, F.col("_exact")).when(near, F.col("_fuzzy")).otherwise(F.col(text)), "score": F.when(exact, 100.0).otherwise(F.coalesce("_s", F.lit(0.0))), "known": exact | near}
    return out.withColumns(found).select(*readings.columns, *found)


def with_code(readings: DataFrame, names: DataFrame, text: str = "text", short_codes: bool = True, score: Score = S.token_set_col) -> DataFrame:
    """Readings with ``matched``, ``score`` and ``code``: by INSEE code (``short_codes``: also three digits of department 07), else of the
    five best scores from 80 the name nearest in length; else the reading, 0 and ''.
    """
    key = X.interface_key if short_codes else X.loose_key
    pattern = r"^(?:07)?\d{3}$" if short_codes else r"^\d{5}$"
    out = readings.withColumns({"_code": _by_code(readings, names, text, pattern), "_q": key(text)})
    codes = names.groupBy(F.col("code").alias("_c")).agg(F.min_by("officiel", "pos").alias("_by_code"))
    out = out.join(R.small(codes), F.col("_code") == F.col("_c"), "left")
    pairs = ranked(out.filter("_by_code is null"), names, F.col("_q"), key("officiel"), 80, score, 5)
    five = pairs.withColumn("_rank", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("_score"), "_pos"))).filter("_rank <= 5")
    best = _best(five, F.abs(F.length("_n") - F.length("_q")), F.col("_rank")).select(F.col("_q").alias("_f"), F.col("officiel").alias("_fuzzy"), F.col("_score").alias("_s"), F.col("code").alias("_fc"))
    out = out.join(best, F.col("_q") == F.col("_f"), "left")
    hit = F.col("_by_code").isNotNull()
    found = {"matched": F.coalesce("_by_code", "_fuzzy", text), "score": F.when(hit, 100.0).otherwise(F.coalesce("_s", F.lit(0.0))), "code": F.when(hit, F.col("_code")).otherwise(F.coalesce("_fc", F.lit("")))}
    return out.withColumns(found).select(*readings.columns, *found)


def scan_blocks(blocks: DataFrame, names: DataFrame, page: list[str], order: str, text: str = "text", least: float = 85, score: Score = S.token_set_col) -> DataFrame:
    """The first block of each page whose best name scores ``least`` or more: page, order, officiel. Blocks under four signs of letters, spaces
    and hyphens, or with a word of NO_NAME, are left out; names are compared by N1.
    """
    letters = F.trim(F.regexp_replace(text, r"[^A-Za-zÀ-ÿ\s\-]", " "))
    key = F.trim(F.regexp_replace(F.upper(letters), "[^A-Z0-9 ]", " "))
    own = blocks.withColumn("_q", F.when((F.length(letters) >= 4) & ~F.arrays_overlap(F.split(key, " "), F.array(*map(F.lit, NO_NAME))), key)).filter("_q <> ''")
    best = _best(ranked(own, names, F.col("_q"), X.match_key("officiel"), least, score, 1), F.desc("_score"), F.col("_pos")).select("_q", "officiel")
    return own.join(best, "_q").groupBy(*page).agg(F.min_by(F.struct(F.col(order), "officiel"), order).alias("b")).select(*page, f"b.{order}", "b.officiel")


def corrected_commune(readings: DataFrame, names: DataFrame, text: str = "text", score: Score = S.weighted_col) -> DataFrame:
    """Readings with valeur, confiance, methode, valide, code: an INSEE code in brackets is taken off; the equal name (1.0), the only name
    that begins with a key of four signs or more (0.9), else of the five best scores the best after +10 for a prefix and a log-normal
    factor of the lengths (0.2 at least; wide where the name is longer), from 45, valid from 70; else the reading (0.2).
    """
    inside = F.regexp_extract(text, r"\((\d{3,5})\)", 1)
    bare = F.when(inside != "", F.trim(F.regexp_replace(text, r"(?s)\(\d{3,5}\).*$", ""))).otherwise(F.col(text))
    own = readings.withColumns({"_inside": inside, "_q": X.corrector_key(bare)})
    n = names.withColumn("_n", X.match_key("officiel"))
    exact = n.groupBy(F.col("_n").alias("_e")).agg(F.max_by(F.struct("officiel", "code"), "pos").alias("_exact"))
    out = own.join(R.small(exact), F.col("_q") == F.col("_e"), "left")
    todo = out.filter("_exact is null").select("_q").filter("_q <> ''").distinct()
    begun = todo.filter(F.length("_q") >= 4).withColumn("_head", F.substring("_q", 1, 4)).join(R.small(n.withColumn("_head", F.substring("_n", 1, 4))), "_head").filter(F.col("_n").startswith(F.col("_q")))
    only = begun.groupBy(F.col("_q").alias("_p")).agg(F.min(F.struct("officiel", "code")).alias("_prefix"), F.count("*").alias("_hits")).filter("_hits = 1").drop("_hits")
    out = out.join(only, F.col("_q") == F.col("_p"), "left")
    pairs = ranked(out.filter("_exact is null and _prefix is null"), names, F.col("_q"), X.match_key("officiel"), 0, score, 5)
    five = pairs.withColumn("_rank", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("_score"), "_pos"))).filter("_rank <= 5")
    n_q, n_n = (F.length(F.regexp_replace(c, r"\P{L}", "")) for c in ("_q", "_n"))
    sigma = F.when((n_q > 0) & (n_n > n_q), 1.3).otherwise(0.45)
    z = (F.when(n_q == 0, 0.0).when(n_n == 0, -10.0).otherwise(F.log(n_n / n_q)) - F.log(F.lit(1.3))) / sigma
    raised = F.when(F.col("_n").startswith(F.col("_q")), F.least(F.lit(100.0), F.col("_score") + 10)).otherwise(F.col("_score"))
    five = five.withColumn("_adj", raised * F.greatest(F.lit(0.2), F.exp(-0.5 * z * z)))
    best = _best(five, F.desc("_adj"), F.col("_rank")).filter("_adj >= 45").select(F.col("_q").alias("_f"), F.struct("officiel", "code").alias("_fuzzy"), "_adj")
    out = out.join(best, F.col("_q") == F.col("_f"), "left")
    is_exact, is_prefix, is_fuzzy = (F.col(c).isNotNull() for c in ("_exact", "_prefix", "_fuzzy"))
    pick = lambda name: F.coalesce(F.col(f"_exact.{name}"), F.col(f"_prefix.{name}"), F.col(f"_fuzzy.{name}"))
    found = {
        "valeur": F.coalesce(pick("officiel"), F.col(text)),
        "confiance": F.when(is_exact, 1.0).when(is_prefix, 0.9).when(is_fuzzy, F.least(F.lit(1.0), F.col("_adj") / 100)).otherwise(0.2),
        "methode": F.when(is_exact, "exact").when(is_prefix, "prefixe").when(is_fuzzy, "fuzzy").otherwise("echec"),
        "valide": is_exact | is_prefix | F.coalesce(F.col("_adj") >= 70, F.lit(False)),
        "code": F.when(is_fuzzy & (F.col("_inside") != ""), F.col("_inside")).otherwise(pick("code")),
    }
    return out.withColumns(found).select(*readings.columns, *found)


def surveyor_name(readings: DataFrame, text: str = "text", known: tuple[str, ...] = dims.SURVEYORS, least: float = 75, score: Score = S.weighted_col, around: tuple[str, ...] = AROUND_SURVEYOR) -> DataFrame:
    """Readings with ``surveyor``: the words around a name taken off, the best known name from ``least``, else the first known name that the
    reading contains; null otherwise. The known names are few, so each is a column.
    """
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: (w != "") & ~w.isin(*around))
    key = F.trim(F.regexp_replace(F.upper(F.array_join(words, " ")), r"[^A-Z0-9 \-]", " "))
    names = readings.sparkSession.createDataFrame([(i, k) for i, k in enumerate(known)], "_i int, _name string")
    own = readings.withColumn("_q", F.when(F.size(words) > 0, key))
    pairs = own.select("_q").filter(F.length("_q") >= 3).distinct().join(F.broadcast(names))  # len(known) rows a reading
    scored = pairs.withColumn("_s", score(F.col("_q"), F.upper("_name"))).filter(F.col("_s") >= least)
    best = scored.groupBy(F.col("_q").alias("_f")).agg(F.min(F.struct((-F.col("_s")).alias("s"), "_i", "_name")).alias("_b")).select("_f", F.col("_b._name").alias("_fuzzy"))
    inside = F.lit(None).cast("string")
    for name in reversed(known):
        inside = F.when(F.lower(text).contains(name.lower()), name).otherwise(inside)
    out = own.join(best, F.col("_q") == F.col("_f"), "left").withColumn("surveyor", F.when(F.size(words) > 0, F.coalesce("_fuzzy", inside)))
    return out.select(*readings.columns, "surveyor")


def learned(readings: DataFrame, corrections: DataFrame, field: str = "field", text: str = "text") -> DataFrame:
    """Readings with ``correction``, what was learned for their field and learned key, null if nothing."""
    own = readings.withColumn("_k", X.learned_key(text))
    c = R.small(corrections.select(F.col("field").alias("_field"), F.col("ocr_norm").alias("_norm"), "correction"))
    return own.join(c, (F.col(field) == F.col("_field")) & (F.col("_k") == F.col("_norm")), "left").select(*readings.columns, "correction")


def quality(raw: Column, reading: Column, name: Column) -> Column:
    """M4: a score times the reading's informativeness and the coherence of lengths."""
    return raw * X.informativeness(reading) * X.length_coherence(reading, name)


def resolve_unknown(readings: DataFrame, names: DataFrame, corrections: DataFrame, text: str = "text", align: Score = S.alignment_col, sets: Score = S.token_set_col, partial: Score = S.partial_col) -> DataFrame:
    """Readings with officiel, code, score, methode. A learned correction that is a name, unless the reading is far shorter (92); the only
    name that begins with the reading, or with its first word, if the reading is long enough and 85 times M4 is 45 or more; else of
    the names that begin so (of half to five times its letters), or of all that have 0.4 times its letters, the best of the
    alignment and of the mean of two fuzzy scores, times M4, from 40; else null.
    """
    own = readings.withColumn("_q", X.match_key(text))
    n = names.select(X.match_key("officiel").alias("_n"), "officiel", "code", F.col("pos").alias("_pos")).filter("_n <> ''")
    letters = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
    c = corrections.filter(F.col("field") == "commune").select(F.col("ocr_norm").alias("_norm"), F.col("correction").alias("_learned"))
    known = n.groupBy(F.col("officiel").alias("_o")).agg(F.min_by("code", "_pos").alias("_learned_code"))
    out = own.join(R.small(c), X.learned_key(text) == F.col("_norm"), "left").join(R.small(known), F.col("_learned") == F.col("_o"), "left")
    out = out.withColumn("_is_learned", F.col("_o").isNotNull() & (letters(F.col("_q")) >= F.greatest(F.lit(3), F.floor(letters(F.col("_learned")) * 0.35))))
    q = out.filter("not _is_learned and length(_q) >= 2").select("_q").distinct()
    first = lambda x: F.split(x, " ")[0]
    head = q.withColumn("_head", F.substring("_q", 1, 2)).join(R.small(n.withColumn("_head", F.substring("_n", 1, 2))), "_head")
    begun = head.filter(F.col("_n").startswith(F.col("_q")) | ((F.length("_q") >= 4) & (first(F.col("_n")) == first(F.col("_q"))))).drop("_head")
    begun = begun.withColumn("_hits", F.count("*").over(W.partitionBy("_q")))
    long_enough = (letters(F.col("_q")) >= 5) | (letters(F.col("_q")) >= 0.45 * letters(F.col("_n")))
    sole = begun.filter((F.col("_hits") == 1) & long_enough).withColumn("_s", quality(F.lit(85.0), F.col("_q"), F.col("_n"))).filter("_s >= 45")
    sole = sole.select("_q", "officiel", "code", "_s", F.lit("prefixe_unique").alias("_m"))
    rest = q.join(sole.select("_q"), "_q", "left_anti")
    fits = letters(F.col("_n")).between(0.5 * letters(F.col("_q")), 5.0 * letters(F.col("_q")))
    some = begun.withColumn("_fits", (F.col("_hits") > 1) & fits).withColumn("_any", F.max("_fits").over(W.partitionBy("_q"))).filter(F.col("_fits") | ~F.col("_any"))
    near = rest.join(some.select("_q", "_n", "officiel", "code", "_pos"), "_q").withColumn("_m", F.lit("sw_prefixe"))
    others = rest.join(begun.select("_q").distinct(), "_q", "left_anti")
    # 100 times M4 is under 40 where a name has under 0.53 or over 3.2 times the reading's letters, so only lengths between are looked up
    n_q, n_n = (F.length(F.regexp_replace(c, r"\P{L}", "")) for c in ("_q", "_n"))
    spread = others.withColumn("_size", F.explode(F.sequence(F.floor(0.53 * n_q).cast("int"), F.ceil(3.2 * n_q).cast("int") + 1)))
    wide = spread.join(R.small(n.withColumn("_size", n_n)), "_size").drop("_size").filter(letters(F.col("_n")) >= F.floor(0.4 * letters(F.col("_q"))))
    both = near.unionByName(wide.withColumn("_m", F.lit("sw_longueur")))
    a, b = F.col("_q"), F.col("_n")
    both = both.withColumn("_raw", F.least(F.lit(100.0), F.greatest(align(a, b), (sets(a, b) + partial(a, b)) / 2)))
    both = both.withColumn("_s", quality(F.col("_raw"), a, b)).filter("_s >= 40")
    top = _best(both, F.desc("_s"), F.col("_pos")).select("_q", "officiel", "code", "_s", "_m")
    found = sole.unionByName(top).withColumnRenamed("_q", "_f")
    out = out.join(found, F.col("_q") == F.col("_f"), "left")
    is_learned = F.col("_is_learned")
    values = {"officiel": F.when(is_learned, F.col("_learned")).otherwise(F.col("officiel")), "code": F.when(is_learned, F.col("_learned_code")).otherwise(F.col("code")), "score": F.when(is_learned, 92).otherwise(F.col("_s").cast("int")), "methode": F.when(is_learned, "correction_apprise").otherwise(F.col("_m"))}
    return out.withColumns(values).select(*readings.columns, *values)


def distinct_hypotheses(hypotheses: DataFrame, cell: str = "cell_id", pos: str = "pos", text: str = "text", prob: str = "prob") -> DataFrame:
    """One row a cell and N1 key, the first spelling and the largest weight, with its rank by weight."""
    one = hypotheses.withColumn("_k", X.match_key(text)).filter("_k <> ''").groupBy(cell, "_k").agg(F.min_by(text, pos).alias(text), F.max(prob).alias(prob), F.min(pos).alias("_p"))
    return one.withColumn("rank", F.row_number().over(W.partitionBy(cell).orderBy(F.desc(prob), "_p"))).drop("_k", "_p")


def commune_veto(value: Column, labels: tuple[str, ...], score: Column) -> Column:
    """F8: a value that is a label, has under three signs or scores under 48 against all names is no commune."""
    return F.lower(F.trim(value)).isin(*labels) | (F.length(F.trim(value)) < 3) | F.coalesce(score < 48, F.lit(True))


def letter_adjusted(score: Column, seen: Column, official: Column, confirmed: Column, contradicted: Column, short: Column, wide: Column) -> Column:
    """+12 where the first letter seen is the name's, -8 where it isn't; +10 if confirmed; capped at 45 if contradicted, at 60 for a
    short word, at 40 for a wide box; null unless over 45.
    """
    first = F.when(seen.isNull(), 0).when(F.upper(F.substring(seen, 1, 1)) == F.substring(X.match_key(official), 1, 1), 12).otherwise(-8)
    out = score + first + F.when(confirmed, 10).otherwise(0)
    for flag, cap in ((contradicted, 45), (short, 60), (wide, 40)):
        out = F.when(flag, F.least(out, F.lit(cap))).otherwise(out)
    return F.when(out > 45, F.least(out, F.lit(100)))


def single_reading(readings: DataFrame, names: DataFrame, text: str = "text", name: str = "officiel") -> DataFrame:
    """K1: J2 for readings of one hypothesis each, of probability 1: id, official, score, methode."""
    own = readings.select(F.col("id").alias("cell_id"), F.col(text).alias("text"), F.lit(1.0).alias("prob"))
    return M.match_hypotheses(own, names.select(F.col(name).alias("name"))).select(F.col("cell_id").alias("id"), "official", "score", "methode")


def name_list(names: DataFrame, name: str = "officiel") -> DataFrame:
    """K3: the keys of all names."""
    return names.select(X.match_key(name).alias("normalise")).filter("normalise <> ''").distinct()


def propagated(cells: DataFrame, names: DataFrame, corrections: DataFrame, rounds: int = 5, certain: float = 92.0, **scores: Score) -> DataFrame:
    """Cells (cell_id, text, officiel, score) after at most ``rounds`` passes of J3 with the first letter's bonus over the cells below ``certain``:
    a better match replaces a cell's own, and what became certain is learned for the next pass; ends when nothing does. The state of a
    round is a table in the shared folder.
    """
    from .shared import stored

    state = stored(cells.select("cell_id", "text", "officiel", F.col("score").cast("double").alias("score")), "cells")
    known = stored(corrections.select("field", "ocr_norm", "correction"), "corrections")
    for _ in range(rounds):
        open_ = state.filter((F.col("score") < certain) & (F.col("text") != "[VIDE]"))
        found = resolve_unknown(open_.select("cell_id", "text"), names, known, **scores).filter("officiel is not null")
        same = F.substring(X.match_key("text"), 1, 1) == F.substring(X.match_key("officiel"), 1, 1)
        better = F.when(same, F.least(F.lit(100.0), F.col("score") + 12)).otherwise(F.greatest(F.lit(0.0), F.col("score") - 8.0))
        found = found.select("cell_id", F.col("officiel").alias("_o"), better.alias("_s"))
        nxt = state.join(found, "cell_id", "left").withColumn("_up", F.coalesce(F.col("_s") > F.col("score"), F.lit(False)))
        nxt = stored(nxt.select("cell_id", "text", F.when(F.col("_up"), F.col("_o")).otherwise(F.col("officiel")).alias("officiel"), F.when(F.col("_up"), F.col("_s")).otherwise(F.col("score")).alias("score"), (F.col("_up") & (F.col("_s") >= certain)).alias("_new")), "cells")
        state = nxt.drop("_new")
        if not nxt.filter("_new").take(1):
            break
        fresh = nxt.filter("_new").select(F.lit("commune").alias("field"), X.learned_key("text").alias("ocr_norm"), F.col("officiel").alias("correction"))
        both = known.withColumn("_k", F.lit(0)).unionByName(fresh.withColumn("_k", F.lit(1)))
        known = stored(both.groupBy("field", "ocr_norm").agg(F.max(F.struct("_k", "correction"))["correction"].alias("correction")), "corrections")
    return state
