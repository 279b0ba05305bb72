"""Scalar goldens and properties."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrier.functions import similarity as S
from terrier.functions import text as X


def value(spark, column, **cells):
    kinds = {int: "int", str: "string", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


CASES = [
    (lambda: X.match_key("c"), "St-Andéol-de-Berg", "SAINT ANDEOL DE BERG"),
    (lambda: X.match_key("c"), "Vallées-d'Antraigues", "VALLEES D ANTRAIGUES"),
    (lambda: X.match_key("c"), "c.n.e. Ucel", "COMMUNE UCEL"),
    (lambda: X.year_of_date("c"), "22.06.97", 97),
    (lambda: X.year_of_date("c"), "22.06.2009", 9),
    (lambda: X.year_of_date("c"), "22/06/1997", 97),
    (lambda: X.year_of_date("c"), "1997-01-01", 97),
    (lambda: X.year_of_date("c"), "", None),
    (lambda: X.numeric_tokens("c"), "9797 isC 69 TerrainA 287 GEO 0 10000", [9797, 69, 287]),
    (lambda: X.serret_year("c"), "30/7/89", 1989),
    (lambda: X.serret_year("c"), "28/4/79", 1979),
    (lambda: X.dossier_year("c"), "A09032", 2009),
    (lambda: X.dossier_year("c"), "A22-145", 2022),
    (lambda: X.dossier_year("c"), "B77", 1977),
    (lambda: X.dossier_year("c"), "09032", None),
    (lambda: X.compact_date("c"), "14071985", "14/07/1985"),
    (lambda: X.compact_date("c"), "140785", "14/07/1985"),
    (lambda: X.compact_date("c"), "140749", "14/07/2049"),
    (lambda: X.compact_date("c"), "1-2-1999", "01/02/1999"),
    (lambda: X.iso_date("c"), "22.06.97", "1997-06-22"),
    (lambda: X.iso_date("c"), "22.06.05", "2005-06-22"),
    (lambda: X.iso_date("c", F.lit(1999)), "31/13/1999", "1999-01-01"),
    (lambda: X.iso_date("c", F.lit(1977)), "", "1977-01-01"),
    (lambda: X.format_scale("c"), "1/1000", "1/1000"),
    (lambda: X.format_scale("c"), "1:500", "1/500"),
    (lambda: X.format_scale("c"), "2000", "1/2000"),
    (lambda: X.format_scale("c"), "abc", "abc"),
    (lambda: X.format_section("c"), " a-b ", "AB"),
    (lambda: X.format_section("c"), "AH 01", "AH"),
    (lambda: X.act_number("c", F.lit("07186"))["dmpc_ref"], "03854", "3854A"),
    (lambda: X.act_number("c", F.lit("07186"))["dmpc_ref"], "677 J", "677A"),
    (lambda: X.act_number("c", F.lit("07186"))["dmpc_ref"], "891-a", "891A"),
    (lambda: X.repair_mojibake("c"), "CommunautÃ©", "Communauté"),
    (lambda: X.act_nature("c"), "Plan de division", "DIVISION_PARCELLAIRE"),
]


@pytest.mark.parametrize("make, given_text, want", CASES)
def test_scalar(spark, make, given_text, want):
    assert value(spark, make(), c=given_text) == want


def test_parcels_and_codes(spark):
    part = lambda t: value(spark, X.parcel_parts("c"), c=t)
    assert tuple(part(" A0092")) == ("A", "0092")
    assert tuple(part("ab 14")) == ("AB", "0014")
    assert tuple(part("0C12")) == ("C", "0012")
    assert part("XYZ") is None
    assert value(spark, X.insee("a", "b"), a="070", b="289") == "07289"
    assert value(spark, X.insee("a", "b"), a="2A0", b="004") == "2A004"
    assert value(spark, X.insee("a", "b"), a="971", b="105") == "971105"
    assert value(spark, X.reference_hb("a", "b"), a=97, b=50) == "97050"
    assert value(spark, X.reference_rc("a", "b"), a=1959, b=488) == "59/488"
    assert value(spark, X.reference_dupuy("a", "b"), a=2003, b="42") == "0342"


@pytest.mark.parametrize("year, month, want", [(1967, None, True), (1964, 3, True), (1964, 2, False), (1964, None, True), (1959, None, False)])
def test_outside_register(spark, year, month, want):
    m = F.lit(month).cast("int")
    assert value(spark, X.outside_register("y", m), y=year) is want


def test_lambert(spark):
    x, y = X.lambert93(F.lit(44.7356), F.lit(4.5990))
    row = spark.range(1).select(x, y).first()
    assert row[0] == pytest.approx(826586.23, abs=0.01) and row[1] == pytest.approx(6405333.98, abs=0.01)


@pytest.mark.parametrize("text, want", [("AUBENAS", 0.985302), ("VALS", 0.92), ("ii", 0.16), ("a", 0.08), ("12", 0.0)])
def test_informativeness(spark, text, want):
    assert value(spark, X.informativeness("c"), c=text) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("a, b, want", [("AUBE", "AUBENAS", 100), ("RUOM", "RUOMS", 100), ("AUBE", "PRIVAS", 25.0), ("LUVINAS", "JUVINAS", 96.4286), ("BONZER", "UZER", 62.5)])
def test_alignment(a, b, want):
    assert S.alignment(a, b) == pytest.approx(want, abs=0.01)


words = st.text("ABC é", max_size=12)


@given(words, words)
def test_scores_are_bounded_and_symmetric(a, b):
    for f in (S.ratio, S.token_sort, S.token_set, S.weighted):
        assert 0 <= f(a, b) <= 100 + 1e-9
    assert S.ratio(a, b) == pytest.approx(S.ratio(b, a))
    if a.strip():
        assert S.ratio(a, a) == 100


@given(words, words)
def test_lcs_is_the_quadratic_one(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert S.lcs(a, b) == table[-1][-1]


def test_surveyor_key_is_made_once(spark):
    """A built-in score gets the key bound: it stands in the plan once, not once a known name; the results are those of the score as it is."""
    from terrier.functions import validators as V
    from terrier.operators.registers import edit_score

    df = spark.createDataFrame([(t,) for t in ("dressé par RACAT", "Serret Fernanb", "Jean Quidam Untel", "expert géomètre", "Barrial", "ab", "", None, "je vois \"RACAT\"")], "t string")
    bound = df.select(V.validated("geometre", "t", edit_score).alias("v"))
    assert bound._jdf.queryExecution().optimizedPlan().toString().count("[^A-Z0-9 ]") == 1
    assert bound.collect() == df.select(V.validated("geometre", "t", lambda a, b: edit_score(a, b)).alias("v")).collect()
