"""The publication loop as a stream of extraction files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What is read of a file; a field stands at the top or, as its value, under champs.
RECORD = """doc_id string, commune string, code_insee string, enr_code_insee string, geometre string, ref_dossier string, n_dossier string, date string, section string, parcelles string, numero_da string, op_code string,
champs struct<commune: struct<valeur: string>, geometre: struct<valeur: string>>, _corrupt string"""
#: The register's columns, in order.
COLUMNS = ("date_publication", "commune", "code_insee", "geometre", "ref_dossier", "type_plan", "id_geofoncier", "document_source", "statut", "fichier_json")
#: The files that are read, and the kind of plan in a file's name.
FILES, KIND = "*_plan_*.json", r"_plan_([^.]+)\.json$"
UNREADABLE = "JSON illisible"


def records(files: DataFrame, name: Column | None = None) -> DataFrame:
    """A row a file (value, its whole text): fichier_json, type_plan, base (the name of its source document), the fields of RECORD, and ``unreadable``. A
    broken file spoils its own row only; a file of no bytes is not seen by the reader and stays where it is.
    """
    name = F.col("_metadata.file_name") if name is None else name
    own = files.select(name.alias("fichier_json"), F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    first = lambda *c: F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in c], F.lit(""))
    kind = F.regexp_extract("fichier_json", KIND, 1)
    return own.select(
        "fichier_json", F.when(kind == "", "inconnu").otherwise(kind).alias("type_plan"), F.regexp_replace("fichier_json", KIND, "").alias("base"), F.coalesce("r.doc_id", "fichier_json").alias("doc_id"),
        first("r.commune", "r.champs.commune.valeur").alias("commune"), first("r.code_insee", "r.enr_code_insee").alias("code_insee"), first("r.geometre", "r.champs.geometre.valeur").alias("geometre"),
        first("r.ref_dossier", "r.n_dossier").alias("ref_dossier"), "r.date", "r.section", "r.parcelles", "r.numero_da", "r.op_code", (F.col("r").isNull() | F.col("r._corrupt").isNotNull()).alias("unreadable"),
    )


def register_rows(batch: DataFrame, published: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Rows of the register (COLUMNS): OK, OK (sans document) or ECHEC with the first 80 signs of the reason; a failure has neither id nor document.

    batch: records(). published: doc_id, id_geofoncier, has_document, error of what the service answered. documents: base, document
    (S20: the source documents by the name without its ending); of several the first by name.
    """
    sources = documents.groupBy("base").agg(F.min("document").alias("document")) if documents is not None else batch.select("base").distinct().withColumn("document", F.lit(None).cast("string"))
    reason = F.when(F.col("unreadable"), UNREADABLE).when(F.col("error").isNotNull(), F.col("error")).when(F.col("id_geofoncier").isNull(), "sans reponse")
    status = F.when(reason.isNotNull(), F.concat(F.lit("ECHEC - "), F.substring(reason, 1, 80))).when(F.col("has_document"), "OK").otherwise("OK (sans document)")
    own = batch.join(published, "doc_id", "left").join(sources, "base", "left").withColumns({"statut": status, "date_publication": F.current_timestamp()})
    done = lambda c: F.when(reason.isNull(), F.col(c)).otherwise("").alias(c)
    return own.withColumn("document_source", F.coalesce("document", F.lit(""))).select(*[done(c) if c in ("id_geofoncier", "document_source") else F.col(c) for c in COLUMNS])


def archive(spark: SparkSession, folder: str, target: str, names: list[str]) -> None:
    """Moves files; one whose name is taken gets the time behind its name. What is gone already is passed over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    for name in names:
        source, place = path(folder, name), path(target, name)
        if fs.exists(place):
            stem, _, ending = name.rpartition(".")
            place = path(target, f"{stem}_{spark.sparkContext._jvm.java.lang.System.currentTimeMillis()}.{ending}")
        if fs.exists(source):
            fs.rename(source, place)


def archive_batch(spark: SparkSession, register: str, folder: str, target: str, batch: int) -> None:
    """Archives the files of a batch that the register has, at most MOST_FILES of them."""
    if batch >= 0:
        done = spark.read.parquet(register).filter(F.col("batch") == batch).select("fichier_json")
        archive(spark, folder, target, [r[0] for r in done.collect()])


#: Files of a batch, so what the driver moves is bounded.
MOST_FILES = 1000


def run(
    spark: SparkSession, folder: str, register: str, checkpoint: str, publish: Callable[[DataFrame], DataFrame], target: str | None = None, every: str | None = "30 seconds", documents: DataFrame | None = None,
) -> StreamingQuery:
    """Reads new files (FILES), publishes the readable ones and adds a row for each to the register once: a batch that is run again overwrites its own
    partition. Files are archived (``target``) once their batch is committed, that is in the next one; finish() does so for the last. every: None
    takes what is there and ends.
    """
    source = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", FILES).option("maxFilesPerTrigger", MOST_FILES).load(folder)

    def handle(batch: DataFrame, batch_id: int) -> None:
        if target:
            archive_batch(batch.sparkSession, register, folder, target, batch_id - 1)
        rows = register_rows(batch, publish(batch.filter("not unreadable")), documents).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(register)

    writer = records(source).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def finish(spark: SparkSession, register: str, folder: str, target: str) -> None:
    """Archives the files of the last batch, after the stream has ended."""
    last = spark.read.parquet(register).agg(F.max("batch")).first()[0]
    if last is not None:
        archive_batch(spark, register, folder, target, last)


def write_csv(register: DataFrame, path: str) -> None:
    """The register as ';' CSV with a header, sorted by commune in capitals and time of publication; in ranges, so no task gets it whole."""
    from ..sources.tables import sorted_register

    sorted_register(register).select(*COLUMNS).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
