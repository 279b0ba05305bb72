"""Extraction operators against values derived by hand."""

import pytest
from pyspark.sql import functions as F

from terrier.operators import extraction as E
from terrier.operators import fields


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression("v").alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Echelle lf1O00", "Echelle 1/1000"), ("Section 0 parcelle 12", "Section O Parcelle 12"), ("lot 1O2 ici", "lot 102 ici"), ("Bois SO", "Bois SO"),
        ("c0mmune secti0n", "Commune Section"), ("gEometre", "Géomètre"), ("", ""), (None, None), ("é1é", "é1é"),
    ],
)
def test_cadastral_rules(spark, text, expected):
    assert one(spark, E.cadastral_rules, text) == expected


@pytest.mark.parametrize(("name", "ok"), [("M. Jean DURAND", True), ("SECTION", False), ("12 rue", False), ("jean durand", False), ("Un Deux Trois Quatre Cinq", False), (None, False)])
def test_is_signatory(spark, name, ok):
    assert one(spark, E.is_signatory, name) is ok


def test_merged_lines(spark):
    assert one(spark, E.merged_lines, [100, 10, 14, 30, 200], "array<int>") == [12, 30, 100, 200]
    assert one(spark, E.merged_lines, [], "array<int>") == []


def test_anchor_zones(spark):
    rows = [(1, "date", "date", 1, "date", 100.0, 100.0, 140.0, 120.0, 1000, 1000), (1, "date", "dat", 0, "dat", 0.0, 0.0, 30.0, 20.0, 1000, 1000)]
    z = E.anchor_zones(spark.createDataFrame(rows, "page int, field string, label string, block_id int, text string, x0 double, y0 double, x1 double, y1 double, width int, height int"), ["page"]).first()
    assert z.label == "date" and z.zone == pytest.approx([0.08, 0.09, 0.32, 0.165]) and z.display_zone == pytest.approx([0.08, 0.1, 0.26, 0.15])


def test_grid_values(spark):
    labels = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 50.0, 20.0)], "page int, label_id int, label_block int, l_x0 double, l_y0 double, l_x1 double, l_y1 double")
    blocks = spark.createDataFrame([(1, 1, 100.0, 0.0, 150.0, 20.0, "12"), (1, 2, 0.0, 30.0, 50.0, 50.0, "34"), (1, 3, 0.0, 21.0, 50.0, 40.0, "x")], "page int, block_id int, x0 double, y0 double, x1 double, y1 double, text string")
    found = E.grid_values(labels, blocks, ["page"], F.col("text").rlike(r"^\d+$"), F.lit(500.0), F.lit(500.0)).first()
    assert (found.block_id, found.distance) == (2, 90.0)


def test_signatures(spark):
    b = spark.createDataFrame(
        [("d", 1, "Vu et approuvé : DUPONT Paul.", 0.9), ("d", 2, "M. Jean DURAND", 0.9), ("d", 3, "M. Jean DURAND", 0.5), ("d", 4, "Section", 0.5), ("d", 5, "représentés", 0.3), ("d", 6, "soussignés", 0.8), ("d", 7, "dispensés", 0.1)],
        "doc_id string, block_id int, text string, prob double",
    )
    assert E.signatories(b, ["doc_id"], ["block_id"]).first().signataires == ["DUPONT Paul", "M. Jean DURAND"]
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    assert {r.doc_id: r.certification for r in E.certification(docs, b, ["doc_id"]).collect()} == {"d": "soussignés (1°)", "e": "soussignés (1°)"}
    assert E.joined_text(b.filter("block_id < 3"), ["doc_id"]).first().full_text == "Vu et approuvé : DUPONT Paul.\nM. Jean DURAND"


def test_indication(spark):
    p = spark.createDataFrame([(1, "xx en conformite d'un piquetage qu'ils ont effectué sur le terrain yy"), (2, "0 " * 60)], "page int, full_text string")
    assert [(r.page, r.valeur) for r in E.indication(p, ["page"]).collect()] == [(1, E.INDICATIONS["B"])]
    assert one(spark, E.chosen_indication, "B.") == E.INDICATIONS["B"] and one(spark, E.chosen_indication, '"12"') == "12"
    assert one(spark, E.plain_answer, "Le texte est : 'Ucel'.") == "Ucel" and one(spark, E.plain_answer, "je vois Vals") == "Vals"


def test_parcels_and_roles(spark):
    p = spark.createDataFrame([(1, "parcelles n° 12, 14a de 1997\nsections ci-apres\n 34\n1950", ["56", "12"], None), (2, None, None, ["7", "7"])], "page int, text string, new array<string>, old array<string>")
    got = {r.page: r.parcelles for r in E.parcel_lists(p, ["page"], "text", "new", "old").collect()}
    assert got == {1: ["12 (Nouveau)", "14a (Nouveau)", "34 (Nouveau)", "56 (Nouveau)"], 2: ["7 (Ancien)"]}
    roles = spark.createDataFrame([(1, 1), (1, 3), (2, 3), (3, 3)], "p int, n int").select(E.page_role("p", "n").alias("r"))
    assert [r.r for r in roles.collect()] == ["all", "entete", "corps", "signatures"]


def test_frequency_penalty(spark):
    rows = [(1, "UCEL", 90)] * 4 + [(1, "VALS", 80)] * 2 + [(1, "", 70)] * 3
    out = E.frequency_penalty(spark.createDataFrame(rows, "page int, official string, score int"), ["page"])
    assert {(r.official, r.score) for r in out.collect()} == {("UCEL", 70.0), ("VALS", 80.0), ("", 70.0)}


def test_output_audit(spark):
    rows = [("a_dmpc", None, "1", None, "Cabinet Géomètre", "A", "DMPC"), ("b", "UCEL", "2", "3", "Durand", "A", "DMPC")]
    out = E.output_audit(spark.createDataFrame(rows, "fichier string, commune string, n_ordre string, n_dossier string, geometre string, section string, nature string"), ["fichier"])
    assert {(r.fichier, r.rule) for r in out.collect()} == {("a_dmpc", "COMMUNE_VIDE"), ("a_dmpc", "NUMEROS_VIDES"), ("a_dmpc", "GEOMETRE_SUSPECT")}


def test_lookups(spark):
    names = spark.createDataFrame([("Aubenas",), ("Vals-les-Bains",)], "name string")
    rows = spark.createDataFrame([("vals", 50.0), ("AUBENA5", 100.0)], "text string, conf double")
    found = {r.text: (r.commune, r.methode) for r in E.alias_or_fuzzy(rows, names, spark.createDataFrame([("VALS", "Vals-les-Bains")], "alias string, name string"), "text", "conf").collect()}
    assert found == {"vals": ("Vals-les-Bains", "Alias Exact"), "AUBENA5": ("Aubenas", "Fuzzy matching")}
    fixed = E.dictionary_correction(spark.createDataFrame([("AUBENSA",), ("12345",)], "t string"), spark.createDataFrame([("AUBENAS",)], "name string"), "t", "name", 80.0)
    assert {r.t: r.corrected for r in fixed.collect()} == {"AUBENSA": "AUBENAS", "12345": "12345"}


def test_knowledge_base(spark):
    schema = "commune string, code_insee string, departement string, sections_connues array<string>, prefixes_dossier array<string>, types_plans_frequents array<string>"
    kb = spark.createDataFrame([("Aubenas", "", "07", ["A"], [], [])], schema)
    full = E.kb_bootstrap(kb, spark.createDataFrame([("Aubenas", "07019"), ("Ucel", "07325"), (" ", "1")], "nom string, code string"))
    assert {(r.commune, r.code_insee, r.departement, tuple(r.sections_connues)) for r in full.collect()} == {("Aubenas", "07019", "07", ("A",)), ("Ucel", "07325", "07", ())}
    more = E.kb_enriched(full, spark.createDataFrame([("Aubenas", "b"), ("Aubenas", "A")], "commune string, section string"))
    assert {r.commune: r.sections_connues for r in more.collect()} == {"Aubenas": ["A", "B"], "Ucel": []}
    found = E.kb_entry(spark.createDataFrame([("AUBENAS",), ("AUBENASS",), ("ZZZ",)], "c string"), full, "c")
    assert {r.c: r.kb_commune for r in found.collect()} == {"AUBENAS": "Aubenas", "AUBENASS": "Aubenas", "ZZZ": None}


def test_search(spark):
    rows = spark.createDataFrame([(i, "07" if i % 2 else "26", f"2020-01-{i:02d}") for i in range(1, 11)], "id int, dept string, date string")
    assert [r.id for r in E.search(rows, {"dept": "07"}, "date", "2020-01-03", "2020-01-09", ("id",), 1, 2).collect()] == [5, 7]


def test_text_scan(spark):
    pages = spark.createDataFrame([(1, "plan de la commune de AUBENAS centre"), (2, "rien"), (3, None)], "page int, text string")
    names = spark.createDataFrame([("Aubenas",), ("Ucel",), ("Privas",)], "name string")
    assert [(r.page, r.found, r.score) for r in E.text_scan(pages, names, ["page"], "text", "name").collect()] == [(1, "Aubenas", 100.0)]


def test_text_scan_of_texts_shorter_than_the_names(spark):
    pages = spark.createDataFrame([(1, "A."), (2, "AUBENA"), (3, "Fait a Aubenas"), (4, "PRI")], "page int, text string")
    names = spark.createDataFrame([("Aubenas",), ("Privas",)], "name string")
    got = {r.page: (r.found, round(r.score, 3)) for r in E.text_scan(pages, names, ["page"], "text", "name").collect()}
    assert got == {2: ("Aubenas", round(1200 / 13, 3)), 3: ("Aubenas", 100.0)}


def test_manual_references(spark):
    found = spark.createDataFrame([(1, "NO_MATCH", None, None), (2, "MATCH_UNIQUE", "97050", "Em"), (3, None, None, None), (4, "NO_MATCH", None, None)], "id int, status string, reference string, op_code string")
    typed = spark.createDataFrame([(1, " 97051 ", "Da"), (2, "1", "Da"), (3, "98001", ""), (4, " ", "Da")], "id int, reference string, op_code string")
    got = {r.id: (r.status, r.reference, r.op_code) for r in E.manual_references(found, typed, ["id"]).collect()}
    assert got == {1: ("MANUEL", "97051", "Da"), 2: ("MATCH_UNIQUE", "97050", "Em"), 3: ("MANUEL", "98001", ""), 4: ("NO_MATCH", None, None)}


def test_model_answers(spark):
    cells = spark.createDataFrame([(1, "Aubenas", None, None, 7), (2, "zzz", None, "Privas", 0), (3, "zzz", "", "illisible", 0), (4, None, None, None, None)], "cell_id int, answer string, hint string, second string, letters int")
    names = spark.createDataFrame([("Aubenas",), ("Privas",), ("Ucel",)], "name string")
    got = {r.cell_id: (r.official, r.score, r.methode) for r in E.model_answers(cells, names).collect()}
    assert got == {1: ("Aubenas", 100, "VLM_P1"), 2: ("Privas", 95, "VLM_P2")}
    assert E.model_answers(cells.filter("false"), names).count() == 0


def test_line_pairs_make_labels_once(spark):
    """Lines are read as labels once and as neighbours once, whatever is asked of their fields and values afterwards."""
    made = spark.sparkContext.accumulator(0)
    text = F.udf(lambda k: made.add(1) or ("Commune", "Commune : Ucel", "Vals", "Dossier n° A09", None)[k % 5], "string")
    own = spark.range(0, 200, 1, 2).select(F.floor(F.col("id") / 5).alias("page"), F.col("id").alias("line_id"), text("id").alias("text"), F.lit(10.0).alias("x0"), (F.col("id") % 5 * 20).cast("double").alias("y0"))
    got = fields.line_pairs(own.withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 12}), ["page"]).collect()
    assert made.value <= 400
    assert {(r.line_id % 5, r.field, r.valeur, r.methode) for r in got} == {(1, "commune", "Ucel", "meme_ligne"), (3, "dossier", "n° A09", "meme_ligne")} and len(got) == 80
