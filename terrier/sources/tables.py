"""Readers and writers of the record tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.small import parcels_of_all


def communes(spark: SparkSession, *paths: str) -> DataFrame:
    """Officiel, normalise, code of JSON lists of {nom, code}; entries without a name are left out."""
    rows = spark.read.schema("nom string, code string").option("multiLine", True).json(list(paths))
    return rows.filter(F.trim("nom") != "").select(F.col("nom").alias("officiel"), X.match_key("nom").alias("normalise"), "code")


def lineage_lines(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return spark.read.text(path).filter(F.size(F.split("value", ";")) >= 11)


def results(spark: SparkSession, path: str) -> DataFrame:
    """S8: ';' CSV with a header; a byte order mark before the first name is dropped."""
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


#: The columns of a word table, in its order.
WORDS = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated words with a header, quotes are ordinary signs; read once, since the columns are known."""
    return spark.read.schema(WORDS).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def with_sniffed_header(df: DataFrame, wanted: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """Columns renamed by the first wanted name whose parts its header's key contains; missing ones are an error or ''."""
    from unicodedata import combining, normalize

    key = lambda c: "".join(ch for ch in normalize("NFKD", c) if not combining(ch)).upper()
    taken: dict[str, str] = {}
    for c in df.columns:
        name = next((n for n, parts in wanted.items() if n not in taken and any(p in key(c) for p in parts)), None)
        if name:
            taken[name] = c
    if missing := [r for r in required if r not in taken]:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[(F.col(f"`{taken[n]}`") if n in taken else F.lit("")).alias(n) for n in wanted]).na.fill("")


def numeric_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is a number."""
    return df.filter(F.expr(f"try_cast(`{column}` as double)").isNotNull())


def numeric_sheet(df: DataFrame, names: list[str], number: str) -> DataFrame:
    """A sheet without a header: its columns by place, the rows whose ``number`` is one."""
    named = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=False)])
    return numeric_rows(named, number)


def parcel_register(df: DataFrame) -> DataFrame:
    """Register RC of a sheet without a header: a numeric n_registre, names in upper case, the year of the date, and the numbers of its
    three lists of parcels, each and together.
    """
    names = ["n_registre", "n_cadastre", "vendeur", "notaire", "commune", "section", "parcelle_origine", "parcelle_acquereur", "parcelle_vendeur", "acquereur", "date_cadastre"]
    own = numeric_sheet(df, names, "n_registre").withColumn("n_registre", F.col("n_registre").cast("double").cast("int"))
    lists = {k: X.numeric_tokens(F.col(c).cast("string"), 99999, whole_words=False) for k, c in (("parc_orig", "parcelle_origine"), ("parc_acq", "parcelle_acquereur"), ("parc_vend", "parcelle_vendeur"))}
    own = own.withColumns({"commune": F.upper(F.trim("commune")), "section": F.upper(F.trim("section")), "annee": X.year_in_text(F.col("date_cadastre").cast("string"))} | lists)
    return own.withColumn("parc_all", parcels_of_all("parc_acq", "parc_orig", "parc_vend"))


def words_of_spans(spans: DataFrame) -> DataFrame:
    """Each span (span_id, text, x0, y0, x1, y1, conf) as a block, line and word of its own."""
    one = F.lit(1)
    return spans.select(
        F.col("span_id").alias("block_num"), one.alias("par_num"), one.alias("line_num"), one.alias("word_num"), F.col("x0").alias("left"), F.col("y0").alias("top"),
        (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "text", "conf",
    )


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, or an empty one of the same schema where there is none or it can't be read."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_modern(df: DataFrame, path: str, boxes: str = "bbox") -> None:
    """As write_plans, arrays joined by ' / ', the boxes of the fields as JSON in Bbox_Champs."""
    own = df.withColumn("Bbox_Champs", F.to_json(boxes)).drop(boxes) if boxes in df.columns else df
    write_plans(own, path, " / ")


def write_booklet(rows: DataFrame, fields: DataFrame, path: str) -> None:
    """The rows as ';' CSV and as JSON, and the fields of the first page as a second CSV."""
    write_plans(rows, f"{path}/lignes.csv")
    write_plans(fields, f"{path}/champs.csv")
    rows.write.mode("overwrite").json(f"{path}/lignes.json")


def write_plans(df: DataFrame, path: str, joiner: str = ", ") -> None:
    """S15, S16: ';' CSV, arrays joined, texts repaired."""
    cols = [F.concat_ws(joiner, c).alias(c) if t.startswith("array") else (X.repair_mojibake(c).alias(c) if t == "string" else F.col(c)) for c, t in df.dtypes]
    df.select(*cols).write.option("sep", ";").option("header", True).mode("overwrite").csv(path)


def append_register(rows: DataFrame, path: str) -> None:
    """The register is a Parquet table that publications are added to."""
    rows.write.mode("append").parquet(path)


def sorted_register(register: DataFrame) -> DataFrame:
    return register.orderBy(F.upper("commune"), "date_publication")


def export_validated(df: DataFrame, columns: list[str], status: str = "Confirmation_Status", done: str = "Validé par l'humain") -> DataFrame:
    """Validated rows, those of the wanted columns that there are."""
    return df.filter(F.col(status) == done).select(*[c for c in columns if c in df.columns])


def save_corrections(corrections: DataFrame, path: str) -> None:
    """Learned corrections (field, ocr_norm, correction, count) are appended; the last of each reading counts."""
    corrections.select("field", "ocr_norm", "correction", "count", F.current_timestamp().alias("saved")).write.mode("append").parquet(path)


def all_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Of each field and reading the correction that was saved last, and how often one was made."""
    rows = spark.read.parquet(path)
    return rows.groupBy("field", "ocr_norm").agg(F.max_by("correction", "saved").alias("correction"), F.sum("count").alias("count"))


def dictionary(*lists: DataFrame) -> DataFrame:
    """Distinct cleaned names of several one-column tables, in order."""
    names = [df.select(X.match_key(df.columns[0]).alias("value")) for df in lists]
    out = names[0]
    for other in names[1:]:
        out = out.unionByName(other)
    return out.filter("value <> ''").distinct().orderBy("value")
