"""From positioned text to fields: labels, values beside them, patterns, corrections, verification.

Blocks have doc_id, page, block_id, x0, y0, x1, y1 and text. Keyword and pattern tables are small literal tables that come
as dictionaries; their order is the order of preference. Labels and values meet only within a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import validators as V
from . import records as R
from .shared import once, unbroadcast

#: The keywords of each field, in order.
KEYWORDS = {
    "commune": ("commune", "commue", "c.n.e", "territoire", "ville de", "localite", "localité", "lieu dit", "lieudit"),
    "echelle": ("echelle", "échelle", "ech.", "ech :", "scale", "1/", "1 /"),
    "section": ("section", "sect.", "section cadastrale", "feuille"),
    "parcelle": ("parcelle", "parcelles", "n° parcelle", "numéro parcelle", "lot"),
    "geometre": ("géomètre", "geometre", "géomètre-expert", "cabinet", "bureau", "dessiné par", "dressé par", "établi par", "signé"),
    "dossier": ("dossier", "n° dossier", "référence", "affaire", "n° d'ordre", "ordre", "inscription", "numéro"),
    "proprietaire": ("propriétaire", "proprietaire", "demandeur", "client", "sci", "m.", "mme.", "mr.", "mlle"),
    "date": ("date", "le ", "fait à", "dressé le", "établi le", "signé le"),
    "departement": ("département", "departement", "dept", "dep."),
}
#: Lines whose labels and values a task makes, so that its memory doesn't grow with the input.
TASK_LINES = 250_000
_SEPARATORS = r"^[\s:;,|.\-–—]+"


def _key(text: str) -> str:
    import re
    import unicodedata

    plain = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return " ".join(re.sub("[^a-z0-9]+", " ", plain.lower()).split())


def _quoted(word: str) -> str:
    return "\\Q" + word + "\\E"


def field_of(c: Column | str, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """The first field with a keyword in the text; keywords of one or two signs must be words. Null if there is none."""
    rules = []
    for field, words in keywords.items():
        keys = list(dict.fromkeys(k for k in map(_key, words) if k))
        short, long = [k for k in keys if len(k) <= 2], [k for k in keys if len(k) > 2]
        rules.append((field, "|".join([*long, *([r"\b(?:" + "|".join(short) + r")\b"] if short else [])])))
    anything = "|".join(pattern for _, pattern in rules)

    def first(key: Column) -> Column:
        out = F.when(~key.rlike(anything), F.lit(None).cast("string"))
        for field, pattern in rules:
            out = out.when(key.rlike(pattern), field)
        return out

    return X.bound(X.label_key(c), first)


def after_label(c: Column | str, field: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """X4, second form: what follows the field's longest keyword that the text holds, up to a strong separator; two signs or more."""
    text = X.col(c)

    def rest(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in reversed(keywords.items()):
            own = F.lit(None).cast("string")
            for word in reversed(sorted(words, key=len, reverse=True)):  # the longest, and of several the first, is asked last
                place = F.locate(word.lower(), low)
                own = F.when(place > 0, F.substring(text, place + F.lit(len(word)), F.length(text))).otherwise(own)
            out = F.when(field == name, own).otherwise(out)
        return F.trim(F.regexp_replace(out, r"^[\s:;\-–|.]+", ""))

    def head(own: Column) -> Column:
        first = F.trim(F.regexp_extract(own, r"^(..+?)(?:[–|]|\s{3,})", 1))
        return F.when(F.length(first) > 1, first).when(F.length(own) >= 2, own)

    return X.bound(F.when(field.isNotNull(), X.bound(F.lower(text), rest)), head)


def without_label(c: Column | str, field: Column, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """X4, third form: the text without the first of each of the field's keywords; two signs or more."""
    text, out = X.col(c), F.lit(None).cast("string")
    for name, words in reversed(keywords.items()):
        own = text
        for word in sorted(words, key=len, reverse=True):
            own = F.regexp_replace(own, "(?isu)^(.*?)" + _quoted(word), "$1")
        out = F.when(field == name, own).otherwise(out)
    out = F.trim(F.regexp_replace(out, _SEPARATORS, ""))
    return F.when(F.length(out) > 1, out)


def inline_value(text: Column, label: Column) -> Column:
    """X4, first form: what follows the label (a key of the text, in its first 70 %); three signs or more, not all lower case without a digit.
    Keys and texts differ in length only by signs that keys drop, so the label is found in the text by its words.
    """
    pattern = F.concat(F.lit("(?iu)^.*?"), F.replace(F.replace(label, F.lit("."), F.lit("\\.")), F.lit(" "), F.lit("[^a-z0-9]+")))
    size = X.bound(X.strip_accents(text), lambda p: F.length(p) - F.length(F.call_function("regexp_replace", p, pattern, F.lit(""))))

    def behind(size: Column) -> Column:
        own = F.trim(F.regexp_replace(F.substring(text, size + 1, F.length(text)), _SEPARATORS, ""))
        lower = lambda o: (o == F.lower(o)) & o.rlike(r"\p{L}") & ~o.rlike(r"\d")
        return F.when(size > 0, X.bound(own, lambda o: F.when((F.length(o) >= 3) & ~lower(o), o)))

    def early(key: Column) -> Column:
        return X.bound(F.call_function("position", label, key), lambda place: (place > 0) & (place - 1 <= 0.7 * F.length(key)))

    # a text that is hardly longer than its label has no room for a value
    return F.when(F.length(text) >= F.length(label) + 3, F.when(X.bound(X.spatial_key(text), early), X.bound(size, behind)))


def without_residue(value: Column, label: Column) -> Column:
    """The last words of the label that the value begins with are cut, the most words first; then a lone short word in small letters and separators."""
    words = F.length(label) - F.length(F.replace(label, F.lit(" "), F.lit(""))) + 1
    tails = F.transform(F.sequence(words, F.lit(1), F.lit(-1)), lambda n: F.call_function("substring_index", label, F.lit(" "), -n))

    def cut(own: Column, hit: Column) -> Column:
        rest = F.when(hit.isNotNull(), F.trim(F.regexp_replace(F.trim(F.substring(own, F.length(hit) + 1, F.length(own))), _SEPARATORS, ""))).otherwise(own)
        return F.regexp_replace(F.trim(F.regexp_replace(rest, r"^[a-zà-ÿ]{1,3}\s+", "")), r"^[\s:,'\-–—]+", "")

    hit = lambda own: X.bound(X.spatial_key(own), lambda key: F.get(F.filter(tails, lambda t: F.startswith(key, t)), F.lit(0)))
    return X.bound(F.trim(value), lambda own: X.bound(hit(own), lambda h: cut(own, h)))


def label_values(blocks: DataFrame, labels: DataFrame | None, page: list[str], width: Column, height: Column) -> DataFrame:
    """X7 before any check: page, field, label, label_id, place, methode, valeur, confidence: of each label of X3 (page, label_id, field, label; None if the blocks
    have field and label, null where they are no label) the text behind it in its own block (place 0, 0.92), and its value block (1, 0.88), which must be no label's.
    """
    marks = [] if labels is not None else ["field", "label"]
    marked = blocks.filter(F.trim("text") != "").select(*page, "block_id", "x0", "y0", "x1", "y1", F.trim("text").alias("text"), *marks)
    if labels is not None:
        marked = marked.join(labels.select(*page, F.col("label_id").alias("block_id"), "field", "label"), [*page, "block_id"], "left")
        parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // TASK_LINES))
        marked = marked.repartition(parts, *page)
    tagged = once(marked.filter("field is not null"), {"_own": inline_value(F.col("text"), F.col("label"))}, F.lit(True))
    boxes = tagged.select(*page, F.col("block_id").alias("label_id"), F.col("block_id").alias("label_block"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")], "field", "label", "_own")
    others = marked.withColumn("_marked", F.col("field").isNotNull()).drop("field", "label")
    # a label comes through once, with its own text and its neighbour: after the join nothing is shuffled but by the page
    beside = R.nearest_values(unbroadcast(boxes), others, page, width, height, ["field", "label", "_own"], ["text", "_marked"], every=True)
    inside = F.struct(F.lit(0).alias("place"), F.col("_own").alias("_raw"))
    near = F.struct(F.lit(1).alias("place"), F.when(~F.col("b._marked"), F.trim(F.regexp_replace(F.col("b.text"), _SEPARATORS, ""))).alias("_raw"))
    raw = beside.select(*page, "field", "label", "label_id", F.explode(F.array(inside, near)).alias("r")).select(*page, "field", "label", "label_id", "r.place", "r._raw").filter("_raw is not null")
    kept = ((F.col("place") == 0) & (F.col("valeur") != "")) | (F.length("valeur") >= 3)
    both = once(raw, {"valeur": without_residue(F.col("_raw"), F.col("label"))}, kept)
    first = F.col("place") == 0
    return both.select(*page, "field", "label", "label_id", "place", F.when(first, "graph_inline").otherwise("graph_neighbor").alias("methode"), "valeur", F.when(first, 0.92).otherwise(0.88).alias("confidence"))


def page_values(blocks: DataFrame, labels: DataFrame | None, page: list[str], width: Column, height: Column, check: Callable[[str, Column], Column] | None = None) -> DataFrame:
    """One value a page and field: page, field, valeur, methode, confidence, label: of label_values() that pass the check (C18, or None) the longest
    label's, then the smaller block's, its own text before its neighbour's.
    """
    found = label_values(blocks, labels, page, width, height)
    if check is not None:
        known = blocks.filter("field is not null") if labels is None else labels
        names = [r[0] for r in known.select("field").distinct().collect()]  # a row a field of the keyword table
        parts = [found.filter(F.col("field") == name).withColumn("valeur", check(name, F.col("valeur"))) for name in names]
        found = parts[0].filter("valeur <> ''") if parts else found
        for part in parts[1:]:
            found = found.unionByName(part.filter("valeur <> ''"))
    row = F.struct((-F.length("label")).alias("k"), "label_id", "place", "valeur", "methode", "confidence", "label")
    return found.groupBy(*page, "field").agg(F.min(row).alias("_b")).select(*page, "field", "_b.valeur", "_b.methode", "_b.confidence", "_b.label")


def line_pairs(lines: DataFrame, page: list[str], keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> DataFrame:
    """Distinct (page, field, valeur, line_id, methode) of lines (page, line_id, text, x0, y0, x1, y1): the text behind a label, else of the
    lines to the right (within 150, y between -15 and 20) the nearest, else of those below (within 150, aligned) the nearest; that line must
    be no label; values of commune need three letters, those of n_ordre a digit, no month and 20 signs at most.
    """
    tagged = once(lines, {"field": field_of("text", keywords)}, F.col("field").isNotNull())
    tagged = once(tagged, {"valeur": X.bound(after_label("text", F.col("field"), keywords), lambda v: F.when((F.col("field") != "n_ordre") | v.rlike(r"\d"), v))}, F.lit(True))
    left = tagged.select(*page, F.col("field").alias("_field"), F.col("valeur").alias("_own"), F.col("line_id").alias("_label"), *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")])
    others = lines.select(*[F.col(c).alias(f"_p_{c}") for c in page], "line_id", "text", "x0", "y0", "x1", "y1")
    dy, dx = F.col("y0") - F.col("l_y0"), F.col("x0") - F.col("l_x1")
    overlap = F.least("l_x1", "x1") - F.greatest("l_x0", "x0")
    aligned = (overlap > -50) | (F.abs(F.col("l_x0") - F.col("x0")) < 100) | (F.abs((F.col("l_x0") + F.col("l_x1")) / 2 - (F.col("x0") + F.col("x1")) / 2) < 100)
    right, below = (dy > -15) & (dy < 20) & (dx > 0) & (dx < 150), (dy > 0) & (dy < 150) & aligned
    on = F.col("_own").isNull() & (F.col("line_id") != F.col("_label")) & (right | below)
    for c in page:
        on = on & (F.col(c) == F.col(f"_p_{c}"))
    # a label with a value of its own meets no line and comes through once, so that labels and values are made in one pass
    near = F.struct(F.when(right, 1).otherwise(2).alias("_t"), F.when(right, dx).otherwise(2 * dy).cast("double").alias("s"), "line_id", "text")
    best = left.join(others, on, "left").groupBy(*page, "_label", "_field", "_own").agg(F.min(F.when(F.col("line_id").isNotNull(), near)).alias("b"))

    def fits(text: Column) -> Column:
        letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
        return F.when(F.col("_field") == "commune", (letters >= 3) & (F.length(F.trim(text)) >= 3)).when(
            F.col("_field") == "n_ordre", text.rlike(r"\d") & (F.length(text) <= 20) & ~F.lower(text).rlike("avril|mars")
        ).otherwise(True)

    inline = F.col("_own").isNotNull()
    beside = F.when(field_of("b.text", keywords).isNull(), X.bound(F.trim(F.regexp_replace(F.col("b.text"), r"^[:\-]", "")), lambda t: F.when(fits(t), t)))
    found = once(best, {"valeur": F.when(inline, F.col("_own")).otherwise(beside)}, F.col("valeur").isNotNull())
    found = found.select(*page, F.col("_field").alias("field"), "valeur", F.when(inline, F.col("_label")).otherwise(F.col("b.line_id")).alias("line_id"), F.when(inline, "meme_ligne").otherwise("voisin").alias("methode"))
    return distinct_values(found, [*page, "field"], "valeur", "line_id")


def distinct_values(values: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Empty values and 'n/a' and 'nan' go; of equal values the first stays."""
    full = values.withColumn(value, F.trim(value)).filter(~F.lower(value).isin("n/a", "nan", ""))
    return full.withColumn("_k", F.row_number().over(W.partitionBy(*keys, value).orderBy(order))).filter("_k = 1").drop("_k")


def zone_text(blocks: DataFrame, page: list[str], order: list[str], text: str = "text") -> DataFrame:
    """The texts of each page in order, signs unified, a line each."""
    rows = F.array_sort(F.collect_list(F.struct(*order, X.unify_signs(text).alias("_t"))))
    return blocks.groupBy(*page).agg(F.array_join(F.transform(rows, lambda r: r["_t"]), "\n").alias("zone_text"))


def _pattern_value(text: Column | str, pattern: str) -> Column:
    p = "(?iu)" + pattern
    raw = lambda e: F.regexp_replace(F.regexp_replace(e, r"\s+", " "), r"^[ ,;:\-]+|[ ,;:\-]+$", "")
    full = lambda c, use: X.bound(c, lambda e: F.when(e != "", use(e)))
    return full(F.regexp_extract(text, p, 1), lambda e: full(raw(e), lambda r: r))  # empty, too, where the pattern isn't found

def contextual(pages: DataFrame, patterns: dict[str, tuple[str, ...]], check: Callable[[str, Column], Column] = V.validated, text: str = "zone_text") -> DataFrame:
    """Pages with a column for each field: the first group of the first pattern that gives a value which passes the check."""
    return pages.withColumns({field: F.coalesce(*[check(field, _pattern_value(text, p)) for p in own]) for field, own in patterns.items()})


def contextual_options(pages: DataFrame, patterns: dict[str, tuple[str, ...]], page: list[str], text: str = "zone_text") -> DataFrame:
    """X14 before any check: page, field, place (of the pattern), valeur."""
    each = lambda t: F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("place"), _pattern_value(t, p).alias("valeur")) for f, own in patterns.items() for i, p in enumerate(own)])
    # bound: the patterns of all fields as one piece of compiled code would be too long for the JVM to compile, and be interpreted
    found = F.filter(X.bound(F.col(text), each), lambda x: x["valeur"].isNotNull())
    return pages.select(*page, F.explode(found).alias("x")).select(*page, "x.*")


def keyword_options(blocks: DataFrame, keywords: dict[str, tuple[str, ...]], page: list[str], order: str, fields: tuple[str, ...] | None = None) -> DataFrame:
    """X15 before any check: page, field, place, methode, valeur: of the field's longest keyword that a block of the page holds the first block: its text behind a
    separator or the keyword, up to another label (place 0), and the next four blocks (50 above to 150 below), before the first that holds a label.
    """
    everything = sorted({_key(k) for ws in keywords.values() for k in ws if _key(k)}, key=len, reverse=True)
    w = W.partitionBy(*page).orderBy(order)
    raw = F.col("text")
    own = blocks.withColumns({"_k": X.label_key("text")}).withColumn("_is_label", F.col("_k").rlike(r"\b(?:" + "|".join(everything) + r")\b"))
    for i in range(1, 5):
        own = own.withColumns({f"_t{i}": F.lead("text", i).over(w), f"_y{i}": F.lead("y0", i).over(w), f"_l{i}": F.lead("_is_label", i).over(w)})
    open_, after = F.lit(True), []
    for i in range(1, 5):
        near = (F.col(f"_y{i}") - F.col("y1")).between(-50, 150) & ~F.coalesce(F.col(f"_l{i}"), F.lit(True))
        open_ = open_ & F.coalesce(near, F.lit(False))
        after.append(F.when(open_, F.struct(F.lit(i).alias("place"), F.lit("suivant").alias("methode"), F.trim(f"_t{i}").alias("valeur"))))
    own = own.withColumn("_after", F.array(*after)).withColumn("_parted", F.trim(F.regexp_extract(raw, r"^[^:–\-;,.]*[:–\-;,.](.*)$", 1)))
    each = []
    for field in fields or tuple(keywords):
        words = sorted(keywords[field], key=len, reverse=True)
        stops = "|".join(_quoted(k) for ws in keywords.values() for k in ws if k not in words)
        which = F.lit(None).cast("int")
        for i, word in reversed(list(enumerate(words))):
            which = F.when(F.col("_k").contains(_key(word)), i).otherwise(which)
        rest = lambda word: F.regexp_replace(F.trim(F.regexp_extract(raw, "(?iu)" + _quoted(word) + r"(.*)$", 1)), r"^[:–\-\s.]+", "")
        behind = F.coalesce(F.when(F.col("_parted") != "", F.col("_parted")), *[F.when(raw.rlike("(?iu)" + _quoted(word)), rest(word)) for word in words], F.lit(""))
        if stops:
            behind = F.trim(F.regexp_replace(behind, r"(?isu)\b(?:" + stops + r")\b.*$", ""))
        # bound, so that only a field whose keyword the block holds is looked into, and the rules of all fields are no one piece of compiled code
        each.append(X.bound(which, lambda w, field=field, behind=behind: F.when(w.isNotNull(), F.struct(F.lit(field).alias("field"), w.alias("w"), behind.alias("behind")))))
    found = own.select(*page, order, "_after", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x"))
    line = F.when(F.col("x.behind") != "", F.struct(F.lit(0).alias("place"), F.lit("ligne").alias("methode"), F.col("x.behind").alias("valeur")))
    options = F.filter(F.concat(F.array(line), "_after"), lambda o: o.isNotNull())
    first = found.select(*page, order, "x.field", "x.w", options.alias("_o")).groupBy(*page, "field").agg(F.min_by("_o", F.struct("w", order)).alias("_o"))
    return first.select(*page, "field", F.explode("_o").alias("o")).select(*page, "field", "o.*")


def keyword_value(blocks: DataFrame, field: str, keywords: dict[str, tuple[str, ...]], page: list[str], order: str, check: Callable[[str, Column], Column] = V.validated) -> DataFrame:
    """Page, valeur, methode: the first of keyword_options() that passes the check."""
    own = keyword_options(blocks, keywords, page, order, (field,)).withColumn("valeur", check(field, F.col("valeur"))).filter("valeur is not null")
    return own.groupBy(*page).agg(F.min(F.struct("place", "valeur", "methode")).alias("_b")).select(*page, "_b.valeur", "_b.methode")


def analyzed(lines: DataFrame, page: list[str], order: str, keywords: dict[str, tuple[str, ...]] = KEYWORDS) -> DataFrame:
    """Page, field, raw, valeur, confiance, methode, valide: labelled lines in order, the value on the line or else the next line if that is no
    label and has two signs; corrected by C20; of each field the most confident, the first of several.
    """
    w = W.partitionBy(*page).orderBy(order)
    own = lines.withColumns({"text": F.trim("text")}).filter("text <> ''").withColumn("field", field_of("text", keywords))
    own = own.withColumns({"_next": F.lead("text").over(w), "_next_field": F.lead("field").over(w)}).filter("field is not null")
    below = F.when(F.col("_next_field").isNull() & (F.length("_next") > 1), F.col("_next"))
    own = once(own, {"raw": F.coalesce(without_label("text", F.col("field"), keywords), below)}, F.col("raw").isNotNull())
    result = V.corrected("libre", "raw")
    for name in ("echelle", "section", "date", "dossier"):  # bound, so that the rules of all fields are no one piece of compiled code
        result = F.when(F.col("field") == name, X.bound(F.col("raw"), lambda raw, name=name: V.corrected(name, raw))).otherwise(result)
    own = own.withColumn("_r", result)
    best = own.groupBy(*page, "field").agg(F.min(F.struct((-F.col("_r.confiance")).alias("c"), F.col(order).alias("o"), "raw", "_r")).alias("b"))
    return best.select(*page, "field", "b.raw", "b._r.valeur", "b._r.confiance", "b._r.methode", "b._r.valide")


def cross_alerts(docs: DataFrame, echelle: str = "echelle", code: str = "code", kind: str = "kind") -> DataFrame:
    """Docs with ``alerts`` (array of names) and ``suggestion``: a scale that is no standard one, with the nearest; an INSEE code outside 07 and 26; a
    scale beyond 5000 on a survey act or boundary plan.
    """
    n = F.regexp_extract(echelle, r"1\s*/\s*(\d+)", 1)
    n = F.when(n != "", n.cast("int"))
    standard = F.concat(F.lit("1/"), X.nearest_scale(n).cast("string"))
    odd = F.when((F.trim(echelle) != "") & ~F.col(echelle).isin(*[f"1/{s}" for s in X.SCALES]) & n.isNotNull(), standard)
    alerts = F.array(
        F.when(odd.isNotNull(), "ECHELLE_NON_STANDARD"), F.when((F.col(code) != "") & ~F.substring(code, 1, 2).isin("07", "26"), "COMMUNE_HORS_ZONE"),
        F.when(F.col(kind).isin("Plan de Bornage", "Document d'Arpentage (DMPC)") & (n > 5000), "ECHELLE_INHABITUELLE"),
    )
    return docs.withColumns({"alerts": F.filter(alerts, lambda a: a.isNotNull()), "suggestion": odd})


def verified(values: DataFrame, text: str = "full_text", field: str = "field", value: str = "valeur", known: str = "known") -> DataFrame:
    """X24, pass A: values with confidence and verification_status; a value that is empty has neither."""
    def score(v: Column) -> Column:
        out = V.confidence("libre", v, text)
        for name in ("commune", "n_ordre", "n_dossier", "section", "feuille", "date", "echelle", "geometre"):
            out = F.when(F.col(field) == name, V.confidence(name, v, text, F.col(known))).otherwise(out)
        return out

    full = ~F.lower(F.trim(F.coalesce(F.col(value), F.lit("")))).isin("", "none", "nan")
    # bound: the rules of all fields as one piece of compiled code would be too long for the JVM to compile, and be interpreted
    out = values.withColumn("confidence", F.when(full, X.bound(F.col(value), score)))
    return out.withColumn("verification_status", F.when(F.col("confidence").isNotNull(), V.status(F.col("confidence"))))


def last_date(text: Column | str) -> Column:
    """The last day-month-year of the text, which wins over earlier ones."""
    found = F.regexp_extract_all(X.col(text), F.lit(r"\b\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\b"), F.lit(0))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def date_by_place(text: Column | str) -> Column:
    """X24, pass C2b: the first date of a year from 1950 to 2030 that the text holds, its spaces as slashes."""
    found = F.regexp_extract_all(X.col(text), F.lit(r"\b\d{1,2}[/\-.\s]\d{1,2}[/\-.\s]\d{4}\b"), F.lit(0))
    ok = F.filter(found, lambda d: F.substring(d, -4, 4).cast("int").between(1950, 2030))
    return F.regexp_replace(F.get(ok, F.lit(0)), r"\s", "/")


def plan_density(blocks: DataFrame, page: list[str], initial: Column, text: str = "text", prob: str = "prob") -> DataFrame:
    """A12, X23's density rule: page, filled, empty, dense, kind: labels with and without a value behind them, confident blocks, and the kind that follows."""
    low = F.lower(text)
    behind = F.trim(F.regexp_extract(text, r"^[^:\-]*[:\-]([^:\-]*)", 1))
    labels = ("commune", "section", "feuille", "dossier", "ordre", "echelle")
    hit = [F.col(prob) >= 0.2] * len(labels)
    n_filled, n_empty = F.lit(0), F.lit(0)
    for ok, label in zip(hit, labels, strict=True):
        has = ok & low.contains(label)
        full = (F.length(behind) > 2) | (F.length(F.trim(F.replace(low, F.lit(label), F.lit("")))) > 2)
        n_filled, n_empty = n_filled + (has & full).cast("int"), n_empty + (has & ~full).cast("int")
    seen = blocks.withColumns({"_f": n_filled, "_e": n_empty, "_h": (F.col(prob) > 0.65).cast("int"), "_a": (F.col(prob) > 0.2).cast("int"), "_k": initial})
    out = seen.groupBy(*page).agg(F.sum("_f").alias("filled"), F.sum("_e").alias("empty"), F.sum("_h").alias("dense"), F.greatest(F.sum("_a"), F.lit(1)).alias("_all"), F.first("_k").alias("_k"))
    filled, empty, dense, kind = (F.col(c) for c in ("filled", "empty", "dense", "_k"))
    sparse = (dense < 40) | ((dense < 70) & (dense / F.col("_all") < 0.55))
    rule = F.when((empty > filled) & (empty >= 2), "DMPC").when(kind.isin("GENERIC", "CROQUIS"), F.when((filled >= 2) & (dense >= 60), "GENERIC").when(sparse, "CROQUIS"))
    return out.withColumn("kind", F.coalesce(rule, F.when((filled >= 2) & (dense >= 80), "GENERIC"), kind)).drop("_all", "_k")


def joined_neighbours(blocks: DataFrame, page: list[str], order: str, text: str = "text") -> DataFrame:
    """Blocks with ``joined``: a number and the single letter of the next block as one."""
    following = F.lead(text).over(W.partitionBy(*page).orderBy(order))
    fits = F.trim(text).rlike(r"^\d{1,5}$") & F.trim(following).rlike("^[A-Z]$")
    return blocks.withColumn("joined", F.when(fits, F.concat(F.trim(text), F.lit(" "), F.trim(following))).otherwise(F.col(text)))


def in_columns(blocks: DataFrame, page: list[str], width: Column) -> DataFrame:
    """Blocks with ``side`` (left or right of 45 % of the width) and ``place``, their order by y within it."""
    side = F.when(F.col("x0") < 0.45 * width, "gauche").otherwise("droite")
    return blocks.withColumn("side", side).withColumn("place", F.row_number().over(W.partitionBy(*page, "side").orderBy("y0", "x0", "block_id")))


def clustered(lines: DataFrame, page: list[str], y: str = "y0", gap: float = 8.0) -> DataFrame:
    """Lines of a page in order of y (extraction.merged_lines moves a line to the middle instead); one that lies over ``gap`` below the one before begins a cluster: page, cluster, y (the mean), n."""
    w = W.partitionBy(*page).orderBy(y)
    new = (F.col(y) - F.lag(y).over(w) > gap).cast("int")
    marked = lines.withColumn("_new", F.coalesce(new, F.lit(0)))
    marked = marked.withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*page, "cluster").agg(F.avg(y).alias(y), F.count("*").alias("n"))


def numbers_by_colour(blocks: DataFrame, prob: str = "prob", text: str = "text") -> DataFrame:
    """blocks of one to five digits, from 0.25, by y and x (their place in the page's order as ``place``)."""
    kept = blocks.filter(F.trim(text).rlike(r"^\d{1,5}$") & (F.col(prob) >= 0.25))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("y0", "x0", "block_id")))


def with_header(blocks: DataFrame, page: list[str], name: str = "header") -> DataFrame:
    """Blocks with ``header`` (or that name), whether they begin in the upper quarter of what the page holds. One pass over the page's rows, no join."""
    bottom = F.max("y1").over(W.partitionBy(*page))
    return blocks.withColumn(name, F.coalesce(F.col("y0") <= bottom / 4, F.lit(False)))


def header_quarter(blocks: DataFrame, page: list[str]) -> DataFrame:
    """The blocks of the upper quarter of what the page holds."""
    return with_header(blocks, page, "_header").filter("_header").drop("_header")


def confident(blocks: DataFrame, least: float, prob: str = "prob") -> DataFrame:
    """F1: blocks read with a confidence of ``least`` or more. The steps use 0.08, 0.10, 0.15, 0.20, 0.25 and 0.65; words 20 and 30 of 100."""
    return blocks.filter(F.col(prob) >= least)


def overlapping(cells: DataFrame, blocks: DataFrame, page: list[str], share: float = 0.4, least: float = 0.10) -> DataFrame:
    """(page, cell_id, block_id, text, prob): blocks of a page, read with over ``least``, of which more than ``share`` lies in a cell both ways; the
    probability counts 0.95. Cells: cell_id and box c_x0..c_y1.
    """
    inside = lambda a, b: F.least(f"{b}1", f"c_{b}1") - F.greatest(f"{b}0", f"c_{b}0") > share * (F.col(f"{b}1") - F.col(f"{b}0"))
    own = blocks.filter((F.col("prob") > least) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.trim("text") != ""))
    return cells.join(own, page).filter(inside("c", "x") & inside("c", "y")).select(*page, "cell_id", "block_id", F.trim("text").alias("text"), (F.col("prob") * 0.95).alias("prob"))


def by_priority(candidates: DataFrame, keys: list[str], order: tuple[str, ...], strategy: str = "methode") -> DataFrame:
    """Of each document and field the first value (valeur, not empty) by the strategies in order; of one strategy the most confident, then the
    first by text. Strategies that aren't named come last.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(strategy)), F.lit(0)), F.lit(len(order) + 1))
    full = candidates.filter(F.trim(F.coalesce("valeur", F.lit(""))) != "")
    first = F.min(F.struct(rank.alias("r"), (-F.col("confidence")).alias("c"), "valeur", F.col(strategy).alias("m")))
    return full.groupBy(*keys).agg(first.alias("_b")).select(*keys, "_b.valeur", F.col("_b.m").alias(strategy), (-F.col("_b.c")).alias("confidence"))


def closing(text: Column | str) -> Column:
    """X24, pass C1: struct(commune, date) of 'fait à X, le D' or 'rédigé à X, le D'."""
    p = r"(?iu)(?:fait|r[ée]dig[ée])\s+[aà]\s+([A-ZÀ-ÿ][A-Za-zÀ-ÿ\s\-]{2,30}?)[,\s]+le\s+(\d{1,2}[\s/\-.]\d{1,2}[\s/\-.]\d{2,4})"
    get = lambda k: F.when(F.regexp_extract(X.col(text), p, k) != "", F.trim(F.regexp_extract(X.col(text), p, k)))
    return F.struct(get(1).alias("commune"), get(2).alias("date"))


def with_closing(docs: DataFrame, text: str = "full_text") -> DataFrame:
    """X24, pass C1: docs (commune, commune_conf, date, date_conf, known: whether the closing commune is in the names) whose commune is missing or under
    0.70, or date missing or under 0.65, take those of the closing, with 0.82.
    """
    end = closing(text)
    weak = lambda c, least: F.col(c).isNull() | (F.trim(c) == "") | F.coalesce(F.col(f"{c}_conf") < least, F.lit(True))
    take_commune, take_date = weak("commune", 0.70) & F.col("known") & end["commune"].isNotNull(), weak("date", 0.65) & end["date"].isNotNull()
    new = {"commune": F.when(take_commune, end["commune"]).otherwise(F.col("commune")), "commune_conf": F.when(take_commune, 0.82).otherwise(F.col("commune_conf"))}
    return docs.withColumns(new | {"date": F.when(take_date, end["date"]).otherwise(F.col("date")), "date_conf": F.when(take_date, 0.82).otherwise(F.col("date_conf"))})


def understood(lines: DataFrame, page: list[str], order: str) -> DataFrame:
    """analyzed() lines of each page as one row of the fields, with the alerts of cross_alerts()."""
    found = analyzed(lines, page, order)
    wide = found.groupBy(*page).agg(*[F.max(F.when(F.col("field") == f, F.col("valeur"))).alias(f) for f in ("commune", "echelle", "section", "dossier", "date")])
    return cross_alerts(wide.withColumns({"code": F.lit(None).cast("string"), "kind": F.lit("inconnu")})).drop("code", "kind")
