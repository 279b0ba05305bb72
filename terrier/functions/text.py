"""Column expressions for names, numbers, dates and geometry of land-registry records.

All are built-in expressions. Functions take a Column or a column's name and give null for null unless said otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row however often ``use`` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _accent_table() -> tuple[str, str]:
    """Every letter below U+0250 whose compatibility decomposition is one ASCII letter and marks."""
    pairs = []
    for code in range(0xA0, 0x250):
        base = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(base) == 1 and base.isascii() and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accent_table()
#: Letters that become two.
EXPANSIONS = {"ß": "ss", "ﬁ": "fi", "ﬂ": "fl", "½": "1/2"}


def strip_accents(c: Column | str) -> Column:
    """Letters without their marks; texts of ASCII alone are left as they are."""
    out = F.regexp_replace(F.translate(col(c), _FROM, _TO), "[̀-ͯ]", "")
    for a, b in EXPANSIONS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(col(c).rlike("[^\\x00-\\x7F]"), out).otherwise(col(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _upper_words(c: Column) -> Column:
    """Upper case; every sign but A-Z and 0-9 is a space, and spaces are single."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


#: Abbreviations and what they stand for, in this order.
ABBREVIATIONS = ((r"\bC\.?N\.?E\.?\b", "COMMUNE"), (r"\bST\.?\b", "SAINT"), (r"\bSTE\.?\b", "SAINTE"))


def match_key(c: Column | str) -> Column:
    """Accents off, CNE/ST/STE in full, upper case, each run of other signs one space; then ST, STE and CNE left as words in full."""
    out = strip_accents(c)
    for short, long in ABBREVIATIONS:
        out = F.regexp_replace(out, "(?i)" + short, long)
    out = _upper_words(out)
    for short, long in (("ST", "SAINT"), ("STE", "SAINTE"), ("CNE", "COMMUNE")):
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return out


def register_key(c: Column | str) -> Column:
    """Accents off, upper case, each run of other signs one space."""
    return _upper_words(strip_accents(c))


def corrector_key(c: Column | str) -> Column:
    """N2 with the words ST and STE in full."""
    out = F.upper(F.translate(strip_accents(c), "-'`’", "    "))
    return _upper_words(F.regexp_replace(F.regexp_replace(out, r"\bST\b", "SAINT"), r"\bSTE\b", "SAINTE"))


def interface_key(c: Column | str) -> Column:
    """N5 of the review: N4 after hyphens and apostrophes became spaces, with the words ST and STE in full."""
    out = loose_key(c)
    return F.regexp_replace(F.regexp_replace(out, r"\bST\b", "SAINT"), r"\bSTE\b", "SAINTE")


def archive_key(c: Column | str) -> Column:
    """N11, first form: accents off, lower case, signs that aren't ASCII dropped."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^\\x00-\\x7F]", ""))


def archive_name(c: Column | str) -> Column:
    """N11, second form: accents off, upper case."""
    return F.trim(F.upper(strip_accents(c)))


def loose_key(c: Column | str) -> Column:
    """Upper case, each other sign a space, ends trimmed, inner spaces kept."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z0-9]", " "))


def label_key(c: Column | str) -> Column:
    """Lower case, other signs to single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


def spatial_key(c: Column | str) -> Column:
    """Number marks unified before N6; texts of ASCII alone without such a mark need but the end of N6."""
    out = F.regexp_replace(F.translate(col(c), "’‘`´", "''''"), "(?i)\\bN['°º]", "n ")
    marked = F.contains(col(c), F.lit("'")) | F.contains(col(c), F.lit("`")) | col(c).rlike("[^\\x00-\\x7F]")
    return F.trim(F.regexp_replace(F.lower(F.when(marked, bound(out, strip_accents)).otherwise(col(c))), "[^a-z0-9]+", " "))


def unify_signs(c: Column | str) -> Column:
    """One kind of quote, dash and space; N' is N°."""
    out = F.translate(col(c), "’‘`´“”«»–— ", "''''\"\"\"\"-- ")
    return F.regexp_replace(out, r"\bN'", "N°")


#: UTF-8 letters as they look when read as Latin-1.
MOJIBAKE = {"Ã©": "é", "Ã¨": "è", "Ãª": "ê", "Ã§": "ç", "Ã´": "ô", "Ã®": "î", "Ã»": "û", "Ã¢": "â", "Ã¯": "ï", "Ã«": "ë", "Ã¹": "ù", "Â°": "°"}


def repair_mojibake(c: Column | str) -> Column:
    """The Latin-1 bytes read as UTF-8 if that is valid and leaves fewer signs of damage, else a table of replacements."""
    c = col(c)
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit("Ã"), F.lit("")))
    narrow = ~c.rlike("[^\u0000-ÿ]")
    again = F.when(narrow, F.try_validate_utf8(F.decode(F.encode(F.when(narrow, c), "ISO-8859-1"), "UTF-8")))
    table = c
    for a, b in MOJIBAKE.items():
        table = F.replace(table, F.lit(a), F.lit(b))
    return F.when(again.isNotNull() & ~again.contains("�") & (count(again) < count(c)), again).otherwise(table)


def learned_key(c: Column | str) -> Column:
    """N10."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


# -- corrections -----------------------------------------------------------------------------------------------------


def format_section(c: Column | str) -> Column:
    """C4: upper case letters and digits, two at most."""
    return F.substring(F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", ""), 1, 2)


def format_scale(c: Column | str) -> Column:
    """1/N of the first group of 2 to 5 digits, else the text in lower case."""
    n = F.regexp_extract(col(c), r"(?:1\s*[/:]\s*)?(\d{2,5})", 1)
    return F.when(n != "", F.concat(F.lit("1/"), n)).otherwise(F.lower(F.trim(col(c))))


def clean_parcels(c: Column | str) -> Column:
    """C6: ' à ' and ' a ' are ranges, other separators one comma; numbers and words that follow a number or a word are parted,
    but a number stays with the letters before it.
    """
    out = F.regexp_replace(F.regexp_replace(col(c), r"\n", " "), " (?:à|a) ", "-")
    out = F.regexp_replace(out, r"[;:/|_+]+", ",")
    out = F.regexp_replace(out, r"(?iu)\s+(?:et|ou|puis)\s+", ",")
    out = F.regexp_replace(out, r"(?<=\d)\s+(?=[0-9A-Za-z])|(?<=[A-Za-z])\s+(?=[A-Za-z])", ", ")
    out = F.regexp_replace(F.regexp_replace(out, r",\s*,", ","), r"\s*,\s*", ", ")
    return F.regexp_replace(out, r"^[, ]+|[, ]+$", "")


def numeric_tokens(c: Column | str, high: int = 9999, whole_words: bool = True) -> Column:
    """C7 (whole words, to 9999) and C8 (all runs of digits, to 99999): distinct numbers from 1, in order."""
    found = F.regexp_extract_all(col(c), F.lit(r"\b\d+\b" if whole_words else r"\d+"), F.lit(0))
    numbers = F.transform(F.filter(found, lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 9), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= high)))


def zero_filled(c: Column | str, width: int) -> Column:
    """Zeros in front up to a width; longer texts stay whole."""
    c = col(c).cast("string")
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def reference_hb(year2: Column | str, n: Column | str) -> Column:
    """C13, register HB: YY and a number of three digits at least."""
    return F.concat(zero_filled(year2, 2), zero_filled(n, 3))


def reference_rc(year: Column | str, n: Column | str) -> Column:
    """C13, register RC: YY/n, or n without a year."""
    return F.when(col(year).isNull(), col(n).cast("string")).otherwise(F.concat(zero_filled(F.pmod(col(year), F.lit(100)), 2), F.lit("/"), col(n).cast("string")))


def reference_dupuy(year: Column | str, n: Column | str) -> Column:
    """C13, register Dupuy: YY and the number without leading zeros."""
    return F.concat(zero_filled(F.pmod(col(year), F.lit(100)), 2), F.regexp_replace(F.trim(col(n).cast("string")), "^0+(?=.)", ""))


def insee(dept: Column | str, commune: Column | str) -> Column:
    """C11: department codes of three characters that end in 0, but for 97*, lose the 0."""
    dept = col(dept)
    return F.concat(F.when(dept.endswith("0") & ~dept.startswith("97"), F.substring(dept, 1, 2)).otherwise(dept), col(commune))


def parcel_parts(c: Column | str) -> Column:
    """struct(section, numero) of a parcel token; null without a digit."""
    t = F.trim(col(c))
    plain = t.rlike(r"(?i)^[A-Z]+\s*\d+$")
    letters = F.upper(F.regexp_replace(t, "[^A-Za-z]", ""))
    digits = F.regexp_replace(t, "[^0-9]", "")
    section = F.when(plain, F.upper(F.regexp_extract(t, r"(?i)^([A-Z]+)", 1))).otherwise(letters)
    return F.when(digits != "", F.struct(section.alias("section"), zero_filled(digits, 4).alias("numero")))


def act_number(c: Column | str, code_insee: Column | str) -> Column:
    """struct(dmpc_prefixe, dmpc_ref) of a survey act: digits without leading zeros and the letter that touches them, else A."""
    m = F.regexp_extract(col(c), r"(\d+)([A-Za-z]?)", 1)
    letter = F.upper(F.regexp_extract(col(c), r"(\d+)([A-Za-z]?)", 2))
    number = F.regexp_replace(m, "^0+(?=.)", "")
    return F.when(m != "", F.struct(F.coalesce(F.concat(F.substring(F.when(col(code_insee) != "", col(code_insee)), 1, 2), F.lit("0")), F.lit("000")).alias("dmpc_prefixe"), F.concat(number, F.when(letter == "", "A").otherwise(letter)).alias("dmpc_ref")))


def format_cadastre(section: Column | str, parcels: Column | str) -> Column:
    """C14: array of struct(cad_prefixe, cad_section, cad_parcelle) of the numbers between & and commas; none without a section."""
    parts = F.filter(F.transform(F.split(col(parcels), "[&,]"), lambda x: F.regexp_replace(x, "[^0-9]", "")), lambda x: (x != "") & (F.length(x) < 10))
    out = F.transform(parts, lambda x: F.struct(F.lit("000").alias("cad_prefixe"), F.upper(F.trim(col(section))).alias("cad_section"), x.cast("int").alias("cad_parcelle")))
    return F.when(F.trim(col(section)) != "", out)


def formatted_section(c: Column | str, pad_all: bool = False) -> Column:
    """Letters and digits in upper case; two signs at least for numbers (``pad_all``: for all)."""
    clean = F.regexp_replace(F.upper(F.trim(col(c))), "[^A-Z0-9]", "")
    return zero_filled(clean, 2) if pad_all else F.when(clean.rlike(r"^\d+$"), zero_filled(clean, 2)).otherwise(clean)


def formatted_number(c: Column | str, digits_only: bool = True) -> Column:
    """Of the first of several numbers the digits, four at least; else the whole, padded if it is a number. Null without a digit in the first case."""
    if digits_only:
        own = F.get(F.filter(F.transform(F.split(col(c), "[&,]"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
        digits = F.regexp_replace(own, "[^0-9]", "")
        return F.when(digits != "", zero_filled(digits, 4))
    own = F.upper(F.trim(col(c)))
    return F.when(own.rlike(r"^\d+$"), zero_filled(own, 4)).otherwise(own)


#: Keywords of the nature of an act, in order, and their codes.
ACT_KEYWORDS = (
    ("bornage", "BORNAGE"), ("division", "DIVISION_PARCELLAIRE"), ("distraction", "DIVISION_PARCELLAIRE"), ("lotissement", "LOTISSEMENT"), ("reunion", "REUNION_PARCELLAIRE"),
    ("réunion", "REUNION_PARCELLAIRE"), ("alignement", "RECONNAISSANCE_LIMITES"), ("limite", "RECONNAISSANCE_LIMITES"), ("dmpc", "DMPC"), ("document d'arpentage", "DMPC"),
)


def act_nature(c: Column | str) -> Column:
    """The code of the first keyword found, in order; AUTRE if none, nothing for nothing."""
    text, out = F.lower(F.coalesce(col(c), F.lit(""))), None
    for word, code in (("", ""), *ACT_KEYWORDS):
        hit = text == "" if not word else text.contains(word)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("AUTRE")


#: Standard scales' denominators.
SCALES = (200, 500, 1000, 1250, 2000, 2500, 5000, 10000, 25000)


def nearest_scale(n: Column | str) -> Column:
    """The nearest standard denominator; of two as near, the smaller."""
    return F.array_min(F.array(*[F.struct(F.abs(col(n) - s).alias("d"), F.lit(s).alias("s")) for s in SCALES]))["s"]


# -- dates -----------------------------------------------------------------------------------------------------------


def pivot(year2: Column | str, last: int) -> Column:
    """A two-digit year: up to ``last`` in the 2000s, else the 1900s. D2, D3: 7; D4, D6, D10: 30; D7: 49; D8: 35."""
    return F.when(col(year2) <= last, col(year2) + 2000).otherwise(col(year2) + 1900)


def year_of_date(c: Column | str) -> Column:
    """The year as two digits: ISO first, then day-month-year (from 1900 on its last two digits, else as written), then a bare 19xx or 20xx."""
    c = F.trim(col(c))
    iso, parted, bare = (F.regexp_extract(c, p, 1) for p in (r"^((?:19|20)\d{2})-\d{2}-\d{2}$", r"\d{1,2}[./-]\d{1,2}[./-](\d{2,4})", r"\b((?:19|20)\d{2})\b"))
    number = lambda x: F.when(x != "", x.cast("int"))
    short = F.when(number(parted) >= 1900, F.pmod(number(parted), F.lit(100))).otherwise(number(parted))
    return F.coalesce(F.pmod(number(iso), F.lit(100)), short, F.pmod(number(bare), F.lit(100)))


def year_in_text(c: Column | str) -> Column:
    """The first 19xx or 20xx of the text."""
    y = F.regexp_extract(col(c), r"\b((?:19|20)\d{2})\b", 1)
    return F.when(y != "", y.cast("int"))


def any_year(c: Column | str) -> Column:
    """The first number of four digits."""
    y = F.regexp_extract(col(c), r"\b(\d{4})\b", 1)
    return F.when(y != "", y.cast("int"))


_PARTED = r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})"


def parted_year(c: Column | str, last: int = 30) -> Column:
    """The year of the first day-month-year, below 100 by pivot."""
    y = F.regexp_extract(col(c), _PARTED, 3)
    y = F.when(y != "", y.cast("int"))
    return F.when(y < 100, pivot(y, last)).otherwise(y)


def serret_year(c: Column | str) -> Column:
    """day/month/year with two digits by pivot 30; else a bare year from 1900 to 2029."""
    bare = F.regexp_extract(col(c), r"\b(19\d{2}|20[0-2]\d)\b", 1)
    return F.coalesce(parted_year(c), F.when(bare != "", bare.cast("int")))


def search_year(c: Column | str, bare: bool) -> Column:
    """The year that a register search is filled with; ``bare``: else the first number of four digits (registers D and S)."""
    return F.coalesce(parted_year(c), any_year(c)) if bare else parted_year(c)


def full_year(c: Column | str) -> Column:
    """A two-digit year at the end is written in full (pivot 30), unless the text has a year of four digits."""
    t = F.trim(col(c))
    y = F.regexp_extract(t, r"[/.\-](\d{2})$", 1)
    long = F.concat(F.substring(t, F.lit(1), F.length(t) - 2), pivot(y.cast("int"), 30).cast("string"))
    return F.when(t.rlike(r"\b(?:19|20)\d{2}\b") | (y == ""), t).otherwise(long)


def dossier_year(c: Column | str) -> Column:
    """The two digits behind a first letter, pivot 35."""
    y = F.regexp_extract(F.trim(col(c)), r"^[A-Za-z](\d{2})", 1)
    return F.when(y != "", pivot(y.cast("int"), 35))


def compact_date(c: Column | str) -> Column:
    """dd/mm/yyyy of eight digits, of six (pivot 49), or of the first day, month and four-digit year anywhere in the text; other texts stay."""
    t = F.trim(col(c))
    year = F.substring(t, 5, 2)
    six = F.concat_ws("/", F.substring(t, 1, 2), F.substring(t, 3, 2), F.concat(F.when(year.cast("int") < 50, "20").otherwise("19"), year))
    eight = F.concat_ws("/", F.substring(t, 1, 2), F.substring(t, 3, 2), F.substring(t, 5, 4))
    p = r"(\d{1,2})\D(\d{1,2})\D(\d{4})"
    parted = F.concat_ws("/", zero_filled(F.regexp_extract(t, p, 1), 2), zero_filled(F.regexp_extract(t, p, 2), 2), F.regexp_extract(t, p, 3))
    return F.when(t.rlike(r"^\d{8}$"), eight).when(t.rlike(r"^\d{6}$"), six).when(t.rlike(p), parted).otherwise(t)


def iso_date(c: Column | str, year: Column | str | None = None, as_of: Column | None = None) -> Column:
    """D3: an ISO date as it is; yyyy-mm-dd of day, month (checked to be up to 31 and 12) and a year from 1900 to 2100 or of two digits
    (pivot 7); else January 1st of ``year``, else ``as_of``.
    """
    t = F.trim(col(c))
    p = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})$"
    day, month, y = (F.when(t.rlike(p), F.regexp_extract(t, p, k).cast("int")) for k in (1, 2, 3))
    full = F.when(F.length(F.regexp_extract(t, p, 3)) == 4, F.when(y.between(1900, 2100), y)).otherwise(pivot(y, 7))
    own = F.when(day.between(1, 31) & month.between(1, 12) & full.isNotNull(), F.format_string("%04d-%02d-%02d", full, month, day))
    first = F.format_string("%04d-01-01", col(year).cast("int")) if year is not None else F.lit(None).cast("string")
    first = F.when(col(year).isNotNull(), first) if year is not None else first
    return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t), own, first, *([F.date_format(as_of, "yyyy-MM-dd")] if as_of is not None else []))


def outside_register(year: Column | str, month: Column | str) -> Column:
    """After 1964, or in 1964 without a month or from March."""
    year, month = col(year), col(month)
    return F.coalesce((year > 1964) | ((year == 1964) & (month.isNull() | (month >= 3))), F.lit(False))


# -- measures --------------------------------------------------------------------------------------------------------


def informativeness(c: Column | str) -> Column:
    """M2: 0.4 min(1, n/5) + 0.6 H / log2(distinct) over the lower-case letters; 0 without letters."""
    letters = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z]", "")
    n = F.length(letters)
    shares = F.transform(F.array_distinct(F.split(letters, "")), lambda ch: (n - F.length(F.replace(letters, ch, F.lit("")))) / n)
    shares = F.filter(shares, lambda p: p > 0)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    spread = F.when(F.size(shares) > 1, entropy / F.log2(F.size(shares))).otherwise(0.0)
    return F.when(n > 0, 0.4 * F.least(F.lit(1.0), n / 5) + 0.6 * spread).otherwise(0.0)


def length_coherence(ocr: Column | str, name: Column | str) -> Column:
    """M3: a log-normal bump around a ratio of 1.3 of the numbers of letters, not below 0.05."""
    n, m = (F.length(F.regexp_replace(col(c), r"\P{L}", "")) for c in (ocr, name))
    z = (F.log(m / n) - F.log(F.lit(1.3))) / 0.65
    return F.when(n == 0, 0.08).when(m == 0, 0.5).otherwise(F.greatest(F.lit(0.05), F.exp(-0.5 * z * z)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """M8: 0 if a norm is next to nothing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-9, 0.0).otherwise(dot(a, b) / norm)


def lambert93(lat: Column | str, lon: Column | str) -> tuple[Column, Column]:
    """M9: (x, y) in metres; conformal conic of the GRS80 ellipsoid, parallels 44 and 49, origin 46.5 N 3 E."""
    import math

    e = math.sqrt(2 / 298.257222101 - (1 / 298.257222101) ** 2)
    a = 6378137.0

    def iso(p: float) -> float:
        return math.log(math.tan(math.pi / 4 + p / 2) * ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2))

    p0, p1, p2 = (math.radians(x) for x in (46.5, 44.0, 49.0))
    big = [math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2) for p in (p1, p2)]
    n = math.log(big[0] / big[1]) / (iso(p2) - iso(p1))
    c = a * big[0] / n * math.exp(n * iso(p1))
    r0 = c * math.exp(-n * iso(p0))
    p = F.radians(col(lat))
    latitude = F.log(F.tan(F.lit(math.pi / 4) + p / 2)) + F.lit(e / 2) * F.log((1 - e * F.sin(p)) / (1 + e * F.sin(p)))
    r, g = c * F.exp(-n * latitude), n * F.radians(col(lon) - 3)
    return 700000 + r * F.sin(g), 6600000 + r0 - r * F.cos(g)


def ring_centroid(ring: Column | str) -> Column:
    """struct(lat, lon): the mean of a ring's vertices."""
    n = F.size(col(ring))
    total = lambda k: F.aggregate(col(ring), F.lit(0.0), lambda s, p: s + p[k])
    return F.when(n > 0, F.struct((total("lat") / n).alias("lat"), (total("lon") / n).alias("lon")))
