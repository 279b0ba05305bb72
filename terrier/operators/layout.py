"""The fields of a document from its lines and their boxes: pivot words and what stands beside them, the commune also by whatever names one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from . import matching as M
from .shared import once, remove, stored

Score = Callable[[Column, Column], Column]
#: The pivot words of each field, in order, and phrases that no value holds.
PIVOTS = {
    "commune": ("commune de", "commune :", "commune:", "commue de", "commune du", "ville de", "territoire de la commune", "territoire de", "departem", "departement", "arrondissement"),
    "geometre": ("géomètre expert", "géomètre-expert", "dessiné par", "cabinet", "bureau d'études", "geometre"),
    "n_dossier": ("dossier n°", "dossier :", "n° d'inscription", "affaire n°", "n° de dossier", "référence"),
    "echelle": ("echelle", "échelle", "ech :"),
    "proprietaire": ("propriétaire", "demandeur", "propriété de", "m.", "mme", "sci"),
    "cadastre_section": ("section", "section :", "section cadastrale"),
    "cadastre_parcelle": ("parcelle n°", "parcelle :", "parcelles :", "numéro :"),
    "ordre_document": ("document d'arpentage", "d'arpentage :", "d'arpentage", "ordre :", "n° d'ordre", "document d'ordre", "numéro d'ordre"),
}
NO_VALUE = ("soussigné", "accepté", "certifie", "vu pour", "approuvé", "dument", "le présent", "opérations de", "conformément")
#: Words that name no commune.
COMMON = (
    "POUR", "DANS", "AVEC", "SANS", "SOUS", "TRES", "BIEN", "MAIS", "AUSSI", "PLUS", "TOUT", "TOUS", "CETTE", "ENTRE", "DONT", "LORS", "VOIE", "VOIES", "ROUTE", "CHEMIN", "LIEU", "LIEUX", "LIEU DIT", "PLAN", "DATE", "SIGNE", "SIGNER", "CERTIFIE",
    "APPROUVE", "VU", "LEDIT", "LADIT", "DITE", "DUDIT", "AUDIT", "AUXDITS", "SUSDITS", "PAGE", "PAGES", "NOTE", "FOLIO", "REGISTRE", "ARCHIVE", "JEAN", "PIERRE", "PAUL", "MARIE", "ANDRE", "LOUIS", "HENRI", "PREFECTURE", "DEPARTEMENT", "CANTON",
    "ARRONDISSEMENT", "PROPRIETE", "PROPRIETAIRE", "PARCELLE", "SECTION", "LIEUDIT", "ECHELLE", "DOSSIER", "REFERENCE", "NUMERO", "ORDRE", "SURFACE", "CONTENANCE", "SUPERFICIE", "MESURAGE", "BORNAGE", "ANNEXE", "TITRE", "OBJET", "TYPE", "NATURE",
    "ACTE", "ACTES", "FRANC", "FRANCS", "METRE", "METRES", "HECTARE", "ARES", "CENTIARES", "PREMIER", "DEUXIEME", "TROISIEME", "JANVIER", "FEVRIER", "MARS", "AVRIL", "JUIN", "JUILLET", "AOUT", "SEPTEMBRE", "OCTOBRE", "NOVEMBRE", "DECEMBRE", "MILLE",
    "CENTS", "VINGT",
)
#: What a field that no pivot gave looks like in the text, in order.
SHAPES = {
    "cadastre_section": (r"(?:section|sect\.?)\s*[:\-.\s]\s*([A-Z]{1,2})\b", r"\bsection\s+([A-Z]{1,2})\b", r"\b([A-Z]{1,2})\s+(?:section|sect)\.?\b"),
    "cadastre_parcelle": (r"(?:parcelle|parc\.?)\s*[n°:\-.\s]+([0-9]{1,5})", r"(?:n°|no\.?)\s*parcelle[s]?\s*[:\-]?\s*([0-9]{1,5})"),
    "echelle": (r"(?:echelle|ech\.?)\s*[:\-\s]?\s*(1\s*[/:]\s*[0-9]{2,6})", r"\b(1\s*/\s*[0-9]{3,6})\b"),
    "n_dossier": (r"(?:n[°o]\s*(?:da|dossier|d\.a\.)|dossier\s*n[°o])[\s:\-.]*([A-Z0-9][A-Z0-9\-/]{1,15})", r"(?:n[°o]\s*d['.]?(?:ordre|inscription))[\s:\-.]*([0-9]{2,8})"),
    "ordre_document": (r"(?:n[°o.]+\s*d'?ordre|d'?ordre)[\s:\-.]*([0-9]{2,8})",),
}
UNKNOWN = "Inconnu"


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def pivot_values(lines: DataFrame) -> DataFrame:
    """(doc_id, field, place, valeur) of lines (doc_id, page, line_id, text, x0, y0, x1, y1), in the order in which they are tried: for each line, by page and y, and pivot
    word in it the next part behind '|' or the rest of its own; else the nearest line below (within 300, the middles within 0.8 of the width, 50 at
    least); else the nearest to the right (within 500, the middles within 0.7 of the height, 20 at least); else the next line. None of those may hold a pivot word.
    """
    order = W.partitionBy("doc_id").orderBy("page", "y0", "line_id")
    low = F.lower("text")
    any_word = F.lit(False)
    for words in PIVOTS.values():
        for w in words:
            any_word = any_word | low.contains(w)
    own = lines.withColumns({"_at": F.row_number().over(order), "_pivot": any_word, "_t": _trimmed(F.col("text"))})
    own = own.withColumns({"_next": F.lead("text").over(order), "_next_pivot": F.lead("_pivot").over(order)})
    p = own.filter("_pivot").select("doc_id", "page", F.col("_at").alias("_label"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    others = own.filter("not _pivot").select("doc_id", "page", "_at", "_t", "x0", "y0", "x1", "y1")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    under, beside = middle("y0", "y1") - F.col("l_y1"), F.col("x0") - F.col("l_x1")
    below = (under > 0) & (under < 300) & (F.abs(middle("x0", "x1") - middle("l_x0", "l_x1")) < F.greatest((F.col("l_x1") - F.col("l_x0")) * 0.8, F.lit(50.0)))
    right = (beside > 0) & (beside < 500) & (F.abs(middle("y0", "y1") - middle("l_y0", "l_y1")) < F.greatest((F.col("l_y1") - F.col("l_y0")) * 0.7, F.lit(20.0)))
    near = p.join(others, ["doc_id", "page"]).filter(below | right)
    first = lambda on, by: F.min(F.when(on, F.struct(by.cast("double").alias("d"), "_at", "_t")))["_t"]
    near = near.groupBy("doc_id", "_label").agg(first(below, under).alias("_below"), first(right, beside).alias("_right"))
    both = own.filter("_pivot").join(near.withColumnRenamed("_label", "_at"), ["doc_id", "_at"], "left")
    each = []
    for i, (field, words) in enumerate(PIVOTS.items()):
        for j, w in enumerate(words):
            each.append(F.when(low.contains(w), F.struct(F.lit(field).alias("field"), F.lit(w).alias("word"), F.lit(100 * i + j).alias("n"))))
    found = both.withColumn("_p", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())))
    parts = F.split("text", r"\|")
    word = F.col("_p.word")
    value = lambda part, at, w: F.when(at + 1 < F.size(parts), X.bound(_trimmed(F.get(parts, at + 1)), lambda t: F.when(F.length(t) > 1, t))).otherwise(X.bound(_rest(part, w), lambda t: F.when(F.length(t) > 2, t)))
    beyond = F.coalesce(F.when(F.col("_below") != "", F.col("_below")), F.when(F.length("_right") > 1, F.col("_right")), F.when(~F.coalesce("_next_pivot", F.lit(True)), _trimmed(F.col("_next"))))
    good = lambda v: (v != "") & (F.length(v) <= 100) & ~F.lower(v).rlike("|".join(NO_VALUE))
    own_part = X.bound(word, lambda w: F.get(F.filter(F.transform(F.split("text", r"\|"), lambda part, at: F.when(F.contains(F.lower(part), w), value(part, at, w))), lambda x: x.isNotNull()), F.lit(0)))
    out = once(found, {"valeur": X.bound(F.coalesce(own_part, beyond), lambda v: F.when(good(v), v))}, F.col("valeur").isNotNull())
    return out.select("doc_id", "_p.field", F.struct("_at", "_p.n").alias("place"), "valeur")


def _rest(part: Column, word: Column) -> Column:
    """What follows the word, without colons in front."""
    at = F.call_function("position", word, F.lower(part))
    return _trimmed(F.regexp_replace(_trimmed(F.substring(part, at + F.length(word), F.length(part))), "^:+", ""))


def _lines(lines: DataFrame) -> DataFrame:
    """(doc_id, _at, _t, _head) of lines that are not empty: their order, their text and whether they stand in the first page's upper quarter with 4 to 59 signs."""
    order = W.partitionBy("doc_id").orderBy("page", "y0", "line_id")
    first = F.min("page").over(W.partitionBy("doc_id"))
    own = lines.withColumns({"_at": F.row_number().over(order), "_t": _trimmed(F.col("text")), "_first": F.col("page") == first})
    own = own.withColumn("_bottom", F.max(F.when(F.col("_first"), F.col("y1"))).over(W.partitionBy("doc_id")))
    head = F.col("_first") & ((F.col("y0") + F.col("y1")) / 2 <= F.col("_bottom") / 4) & (F.length("_t") > 3) & (F.length("_t") < 60)
    return own.select("doc_id", "_at", "_t", F.coalesce(head, F.lit(False)).alias("_head")).filter("_t <> ''")


def _readings(texts: DataFrame) -> DataFrame:
    """(_t, rank, n, valeur) of distinct texts of lines (_t, _head: whether one stands in an upper quarter): what may name the commune beyond the pivots: as rank 1 the
    text of such a line, as rank 2 each text, its words and its pairs of words.
    """
    head = texts.filter("_head").select("_t", F.lit(1).alias("rank"), F.lit(0).alias("n"), F.col("_t").alias("valeur"))
    words = F.filter(F.split("_t", r"\s+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 1, F.lit(1))), lambda k: F.when(k < F.size("_w"), F.concat_ws(" ", F.get("_w", k - 1), F.get("_w", k))))
    kinds = F.concat(F.array(F.struct(F.lit("line").alias("kind"), F.col("_t").alias("t"))), F.transform("_w", lambda w: F.struct(F.lit("word").alias("kind"), w.alias("t"))), F.transform(pairs, lambda w: F.struct(F.lit("pair").alias("kind"), w.alias("t"))))
    each = texts.select("_t", words.alias("_w")).select("_t", F.posexplode(kinds).alias("n", "x"))

    def fits(key: Column) -> Column:
        kind, size = F.col("x.kind"), F.length(key)
        return (((kind == "line") & size.between(4, 45)) | ((kind == "word") & (size >= 4)) | ((kind == "pair") & (size >= 5))) & ~key.isin(*COMMON)

    each = once(each, {"_fits": X.bound(X.match_key("x.t"), fits)}, F.col("x.t").isNotNull() & F.col("_fits"))
    return head.unionByName(each.select("_t", F.lit(2).alias("rank"), "n", F.col("x.t").alias("valeur")))


def layout_values(lines: DataFrame, names: DataFrame, weighted: Score = S.weighted_col, sort: Score = S.token_sort_col, align: Score = S.alignment_col) -> DataFrame:
    """One row a document: doc_id, commune, commune_score, commune_code and the other fields of PIVOTS, "Inconnu" where nothing gave one.

    A field is the first of pivot_values(), else the first of SHAPES in the whole text. The commune is the best match (J2) of the pivots' values, of the upper
    quarter's lines, and of all lines, words and pairs of words; of equal scores the first. Where no pivot gave one and nothing matched, all lines of 3 to 59 signs
    are matched as one text. names: officiel, code, pos.
    """
    def matched(asked: DataFrame) -> DataFrame:
        cells = asked.select(F.col("valeur").alias("cell_id"), F.col("valeur").alias("text"), F.lit(1.0).alias("prob")).distinct()
        found = M.match_hypotheses(cells, names, name="officiel", code="code", name_pos="pos", weighted=weighted, sort=sort, align=align)
        return found.select(F.col("cell_id").alias("valeur"), "score", F.struct(F.col("official").alias("commune"), F.col("code").alias("commune_code"), F.col("score").alias("commune_score")).alias("_r"))

    place = lambda at, n: F.struct(at.alias("_at"), n.alias("n")).alias("place")
    values = stored(pivot_values(lines), "pivots")
    own = stored(_lines(lines), "lines")
    readings = stored(_readings(own.groupBy("_t").agg(F.max("_head").alias("_head"))), "readings")
    pivots = values.filter("field = 'commune'").select("doc_id", F.lit(0).alias("rank"), place(F.col("place._at"), F.col("place.n")), "valeur")
    known = stored(matched(pivots.select("valeur").unionByName(readings.select("valeur"))), "matched")
    # of a text's readings of one rank the best and of equal scores the first is the best of each of its lines
    best = lambda rank: F.min(F.when(F.col("rank") == rank, F.struct((-F.col("score")).alias("s"), "n", "_r"))).alias(f"_{rank}")
    texts = readings.join(known.filter("score > 0"), "valeur").groupBy("_t").agg(best(1), best(2))
    of = lambda rank: F.when(F.col(f"_{rank}").isNotNull(), F.struct(F.col(f"_{rank}.s").alias("s"), F.lit(rank).alias("rank"), place(F.col("_at"), F.col(f"_{rank}.n")), F.col(f"_{rank}._r").alias("_r")))
    lined = own.join(texts, "_t").select("doc_id", F.least(of(2), F.when(F.col("_head"), of(1))).alias("_c"))
    pivoted = pivots.join(known, "valeur").select("doc_id", F.struct((-F.col("score")).alias("s"), "rank", "place", "_r").alias("_c"))
    given = stored(lined.unionByName(pivoted).filter("_c is not null").groupBy("doc_id").agg(F.min("_c")["_r"].alias("_r")), "given")
    full = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "line_id", _trimmed(F.col("text")).alias("t")))), lambda x: x["t"]).alias("_all"))
    whole = stored(full.select("doc_id", F.array_join("_all", " ").alias("_text"), F.array_join(F.filter("_all", lambda t: (F.length(t) > 2) & (F.length(t) < 60)), " ").alias("_lines")), "whole")
    left = stored(whole.filter("_lines <> ''").join(given, "doc_id", "left_anti").select("doc_id", F.col("_lines").alias("valeur")), "left")
    if left.take(1):  # only what no reading gave is matched as a whole
        best = given.unionByName(left.join(matched(left), "valeur").select("doc_id", "_r"))
    else:
        best = given
    best = best.select("doc_id", "_r.*")
    texts = whole.select("doc_id", "_text")
    others = [f for f in PIVOTS if f != "commune"]
    first = values.groupBy("doc_id").agg(*[F.min(F.when(F.col("field") == f, F.struct("place", "valeur")))["valeur"].alias(f) for f in others])
    out = texts.join(best, "doc_id", "left").join(first, "doc_id", "left")
    for f, shapes in SHAPES.items():
        shaped = [F.regexp_extract("_text", "(?i)" + s, 1) for s in shapes]
        value = F.coalesce(*[F.when(v != "", v) for v in shaped])
        out = out.withColumn(f, F.coalesce(f, F.upper(value) if f == "cadastre_section" else F.regexp_replace(value, r"\s+", "") if f == "echelle" else value))
    found = {"commune": F.coalesce("commune", F.lit("Commune non identifiée")), "commune_score": F.coalesce("commune_score", F.lit(0)), "commune_code": F.coalesce("commune_code", F.lit(""))} | {f: F.coalesce(f, F.lit(UNKNOWN)) for f in others}
    out = stored(out.withColumns(found).select("doc_id", "commune", "commune_score", "commune_code", *others), "layout")
    remove(values, own, readings, known, given, whole, left)
    return out
