"""The publication stream and the stream of corrections: broken files, stops, clashing names, state over starts."""

import json

from pyspark.sql import functions as F

from terrier.sources import tables as T
from terrier.streaming import corrections, publish

ANSWER = "doc_id string, id_geofoncier string, has_document boolean, error string"


def answer(batch):
    done = F.when(F.col("doc_id") != "d2", F.concat(F.lit("g-"), "doc_id"))
    return batch.select("doc_id", done.alias("id_geofoncier"), (F.col("doc_id") == "d1").alias("has_document"), F.when(F.col("doc_id") == "d2", "x" * 100).alias("error"))


def put(folder, name, value):
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def test_publication(spark, tmp_path):
    folder, gone = tmp_path / "in", tmp_path / "archive"
    folder.mkdir()
    put(folder, "a_plan_DMPC.json", {"doc_id": "d1", "commune": "Vals", "n_dossier": "A09"})
    put(folder, "b_plan_moderne.json", {"doc_id": "d2", "commune": "Ucel"})
    put(folder, "c_plan_PVa.json", {"doc_id": "d3", "champs": {"commune": {"valeur": "aubenas", "zone": [0, 1]}, "geometre": {"valeur": "RACAT"}}, "enr_code_insee": "07019", "ref_dossier": ""})
    put(folder, "d_plan_X.json", '{"doc_id": "d4", broken')
    put(folder, "e_plan_Y.json", "")
    put(folder, "notes.json", {"doc_id": "d9"})
    sources = spark.createDataFrame([("a", "a.pdf"), ("a", "a.PNG"), ("zzz", "zzz.pdf")], "base string, document string")
    start = lambda: publish.run(spark, str(folder), str(tmp_path / "reg"), str(tmp_path / "ck"), answer, str(gone), None, sources).awaitTermination(120)
    start()
    start()  # nothing new
    rows = {r.fichier_json: r for r in spark.read.parquet(str(tmp_path / "reg")).collect()}
    assert {n: r.statut for n, r in rows.items()} == {
        "a_plan_DMPC.json": "OK", "b_plan_moderne.json": "ECHEC - " + "x" * 80, "c_plan_PVa.json": "OK (sans document)", "d_plan_X.json": "ECHEC - JSON illisible",
    }
    a, c = rows["a_plan_DMPC.json"], rows["c_plan_PVa.json"]
    assert (a.type_plan, a.id_geofoncier, a.document_source, a.ref_dossier) == ("DMPC", "g-d1", "a.PNG", "A09") and rows["b_plan_moderne.json"].id_geofoncier == ""
    assert (c.commune, c.geometre, c.code_insee, c.type_plan) == ("aubenas", "RACAT", "07019", "PVa") and all(r.date_publication for r in rows.values())
    publish.finish(spark, str(tmp_path / "reg"), str(folder), str(gone))
    assert sorted(p.name for p in folder.glob("*.json")) == ["e_plan_Y.json", "notes.json"]  # a file of no bytes is not seen

    put(folder, "a_plan_DMPC.json", {"doc_id": "d1", "commune": "Vals"})  # a new file whose archived name is taken; after a stop
    put(folder, "f_plan_Z.json", {"doc_id": "d5", "commune": "Zut"})
    publish.archive(spark, str(folder), str(gone), ["a_plan_DMPC.json", "missing.json"])
    assert len(list(gone.glob("a_plan_DMPC*.json"))) == 2
    start()
    register = spark.read.parquet(str(tmp_path / "reg"))
    assert register.count() == 5
    publish.write_csv(register, str(tmp_path / "csv"))
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*")) for line in p.read_text().splitlines() if not line.startswith("date_publication")]
    assert [line.split(";")[1].upper() for line in lines] == sorted(line.split(";")[1].upper() for line in lines) and len(lines) == 5
    assert [r.commune for r in T.sorted_register(register).collect()][-1] == "Zut"


def test_corrections_keep_their_state_over_starts(spark, tmp_path):
    schema = "field string, ocr_value string, correction string, ts long"
    first = [("commune", "BAINS", "Vals", 1), ("commune", "bains!", "Vals-les-Bains", 3), ("commune", "ab", "Aubenas", 2), ("commune", "Ucel", "ucel", 4), ("section", "abc", None, 5)]
    second = [("commune", "Bains", "Bain", 2), ("section", "0AB", "OAB", 9), ("section", "0AB", "OAC", 9)]
    out = {}
    for k, rows in enumerate((first, second, [])):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))

        def put_(batch, number, k=k):
            out.update({(r.field, r.ocr_norm): (r.correction, r["count"], k) for r in batch.collect()})

        stream = corrections.learned(spark.readStream.schema(schema).parquet(str(tmp_path / "log")))
        stream.writeStream.outputMode("update").foreachBatch(put_).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert out == {("commune", "bains"): ("Vals-les-Bains", 3, 1), ("section", "0ab"): ("OAC", 2, 1)}
