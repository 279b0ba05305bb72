"""A training corpus from ``documents``: texts with a letter, no exact or near copies, no repeated passages, packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, which run() writes to the shared folder and reads again as the next one's docs. All but the last
return the columns of ``documents``; further columns pass through, whatever their names.

Null texts go in the first stage (they have no language). Rows with a null id are kept by the first stage and dropped by
the second, since later stages tell documents by id. Rows with one id and one text become one in the second stage; rows
with one id and different texts are told apart by the text's digest, but for the third stage, where they are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from terrier.llm import spark_io as io

#: SQL cannot express the first, third and fourth stage.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _digest(docs: DataFrame):
    return F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (``und``): those without a letter, null texts among them. It is no test of
    being in a learned language: shares add up to 1, so foreign or garbled text with letters gets one of the learned ones.
    """
    io.shrink_executors(spark)
    return language_id.known_language(docs)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays, as one row."""
    io.shrink_executors(spark)
    own = docs.filter(F.col("doc_id").isNotNull())
    sha = _free(docs, "sha")
    found = io.stored(exact_dedup.exact_dedup(own).select("doc_id", F.col("text_sha256").alias(sha), "kept"), "found")
    gone = found.filter("not kept").select("doc_id", sha).distinct()
    again = io.stored(found.filter("kept").groupBy("doc_id", sha).agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", sha), "again")
    left = own.withColumn(sha, _digest(own)).join(io.narrow(gone), ["doc_id", sha], "left_anti")
    if again.take(1):
        marks = io.narrow(again)
        left = left.join(marks, ["doc_id", sha], "left_anti").unionByName(left.join(marks, ["doc_id", sha], "left_semi").dropDuplicates(["doc_id", sha]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more), the smallest id stays."""
    io.shrink_executors(spark)
    gone = near_dedup.near_dedup(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(io.narrow(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id also holds; documents of which nothing is left go.

    The columns are those of docs; n_chars, where there is one, is counted anew.
    """
    io.shrink_executors(spark)
    sha, rest = _free(docs, "sha"), _free(docs, "rest")
    cut = suffix_dedup.suffix_dedup(docs, with_text=True).filter("n_removed > 0")
    cut = io.stored(cut.select("doc_id", F.lower(F.hex("text_sha256")).alias(sha), F.col("kept_text").alias(rest)).distinct(), "cut")
    marks = io.narrow(cut.select("doc_id", sha))
    marked = docs.withColumn(sha, _digest(docs))
    new = marked.join(marks, ["doc_id", sha], "left_semi").join(cut, ["doc_id", sha]).filter(F.length(F.trim(rest)) > 0).withColumn("text", F.col(rest))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.join(marks, ["doc_id", sha], "left_anti").select(*columns).unionByName(new.select(*columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    io.shrink_executors(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", known_language), ("exact_dedup", no_exact_copies), ("near_dedup", no_near_copies), ("suffix_dedup", no_repeated_passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = None
    docs = io.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = io.stored(stage(spark, docs, sf_dir), name)
        if before:
            io.discard(before)
        before = docs
    return docs
