"""Small column expressions of files, forms, tokens and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

#: The signature of a modern cadastral extract, and phrases of its form.
EXTRACT_SIGNATURE = "DIRECTION GENERALE DES FINANCES PUBLIQUES"
FORM_PHRASES = (
    "déclarent avoir pris connaissance des informations portées", "au dos de la chemise 6463", "s'il est différent du propriétaire", "mandataire", "avoué",
    "représentant qualifié de l'autorité expropriant", "le présent document d'arpentage", "certifié par les propriétaires soussignés", "a été établi", "d'après les indications",
    "en conformité d'un piquetage", "effectué sur le terrain", "d'après un plan d'arpentage", "modification selon les énonciations", "art. 25 du décret", "inspection des finances",
)


def is_extract(text: Column | str) -> Column:
    """The text holds the signature of a modern extract."""
    return F.upper(X.col(text)).contains(EXTRACT_SIGNATURE)


def is_form_text(text: Column | str) -> Column:
    """The text holds a phrase of the form."""
    low, out = F.lower(X.col(text)), F.lit(False)
    for phrase in FORM_PHRASES:
        out = out | low.contains(phrase)
    return out


def parcels_of_all(*lists: Column | str) -> Column:
    """The distinct numbers of several lists, ascending; null lists are empty."""
    out = F.array().cast("array<int>")
    for c in lists:
        out = F.array_union(out, F.coalesce(X.col(c), F.array().cast("array<int>")))
    return F.array_sort(out)


def order_of_file(path: Column | str) -> Column:
    """A survey act's number of a file name: 'ddd_dddd-L...' or 'geofoncier_dmpc_ddddd_x_dddd'."""
    base = F.element_at(F.split(X.col(path), "/"), -1)
    act = F.translate(F.regexp_extract(base, r"^\d{3}[_\-](\d{3,5}[_\-][A-Za-z])", 1), "_", "-")
    listed = F.regexp_extract(F.lower(base), r"geofoncier_dmpc_\d{5}_[0-9a-z]{1,3}_(\d{1,5})", 1)
    return F.when(act != "", act).when(listed != "", listed)


def surveyor_of_file(path: Column | str) -> Column:
    """The name without its extension and the number at its end, other signs as _, 30 signs at most; 'inconnu' for none."""
    base = F.regexp_replace(F.element_at(F.split(X.col(path), "/"), -1), r"\.[^.]*$", "")
    name = F.trim(F.regexp_replace(base, r"[_\-]?\d+$", ""))
    return F.substring(F.regexp_replace(F.when(name == "", "inconnu").otherwise(name), r"[^a-zA-ZÀ-ÿ0-9_\-]", "_"), 1, 30)


def flat_value(values: Column | str, joiner: str = ", ") -> Column:
    """The elements of a list joined; '' for null."""
    return F.coalesce(F.array_join(F.transform(X.col(values), lambda v: v.cast("string")), joiner), F.lit(""))


def occurrence_bonus(value: Column | str, text: Column | str) -> Column:
    """0.08 for each time but the first that the text holds the value, 0.22 at most; values of three signs or fewer get none."""
    v, low = F.lower(X.col(value)), F.lower(X.col(text))
    times = (F.length(low) - F.length(F.replace(low, v, F.lit("")))) / F.length(v)
    return F.when((F.length(v) > 3) & (times > 1), F.least(F.lit(0.22), 0.08 * (times - 1))).otherwise(0.0)


def first_parcels(numbers: Column | str, n: int = 5) -> Column:
    """W11."""
    return F.array_join(F.slice(X.col(numbers), 1, n), ", ")


def token_expiry(token: Column | str) -> Column:
    """The time (seconds) of a web token's claim 'exp', without a check of its signature; null if there is none."""
    bare = F.regexp_replace(F.trim(X.col(token)), "(?i)^bearer +", "")
    body = F.translate(F.split_part(bare, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.try_to_binary(F.when(body != "", padded), F.lit("base64")).cast("string"), "$.exp").cast("long")


def section_key(c: Column | str) -> Column:
    """Upper case without zeros in front, kept where it would become empty."""
    own = F.upper(F.trim(X.col(c)))
    bare = F.regexp_replace(own, "^0+", "")
    return F.when(bare == "", own).otherwise(bare)


def number_key(c: Column | str) -> Column:
    """Four digits at least."""
    return X.zero_filled(c, 4)


def centroid(polygons: Column | str, multi: Column | None = None) -> Column:
    """struct(lat, lon) of polygons, an array of polygons of rings of [lon, lat]: the mean of the first ring's points, or of all points where
    ``multi`` (more than one polygon, if not given).
    """
    c = X.col(polygons)
    many = multi if multi is not None else F.size(c) > 1
    points = F.when(many, F.flatten(F.flatten(c))).otherwise(F.get(F.get(c, F.lit(0)), F.lit(0)))
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(k))) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean(1).alias("lat"), mean(0).alias("lon")))


def box(polygon: Column | str) -> Column:
    """struct(x0, y0, x1, y1, cx, cy, width) of an array of points [x, y]."""
    xs, ys = F.transform(X.col(polygon), lambda p: F.get(p, F.lit(0))), F.transform(X.col(polygon), lambda p: F.get(p, F.lit(1)))
    x0, y0, x1, y1 = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("width"))
