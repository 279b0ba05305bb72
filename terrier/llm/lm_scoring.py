"""Language-model scores: cross-entropy difference of two matched bigram models.

The target model counts the documents marked as target, the background model counts all documents. They are matched: one
vocabulary (all words of the corpus), one additive smoothing, and background counts scaled by the target's share of all
words, so that smoothing weighs alike in both and the difference tells the domain, not the size, of the models. All
documents are counted; none is drawn. A document's own words are left out of the counts that judge it. With k = scale of
the model, P(w | v) = (k c(v, w) + a) / (k c(v) + a V). A document's score is the mean over its words of the target's loss
less the background's: low where the document is like the target.

Documents are packed into compressed blocks. A block posts each n-gram that it holds once, with its counts, to the n-gram's
part of the hash space, and gets the n-gram's totals back in the same order; then it works out its documents' sums. So the
most frequent n-gram costs one posting a block, and a task holds one part or one block.

Words and n-grams are told apart by hashes of 62 bits; two that collide would count as one.

Cases: null and empty texts and texts without words have no words and a null score; each row is a document of its own,
with a repeated or null id too (a null id is in no target); an empty target gives scores of 0; an empty table gives no
rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

ALPHA = 0.01
BLOCK_BYTES = 4_000_000
#: Bytes of text behind one part of the n-grams.
PARTITION_BYTES = 8_000_000
#: The two lowest bits of an n-gram: bigram, context, last word of a document.
_BIGRAM, _CONTEXT, _LAST, _KIND = np.uint64(0), np.uint64(1), np.uint64(2), np.uint64(3)
TOTALS = "part long, block long, blob binary, words long, n long, n_target long"


def document_grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, their documents, last word of each document that has words, number of words of each document).

    A document's first word follows the start mark; a context and a last word that are the same word differ in their lowest bits only.
    """
    starts, ends, doc = blocks.words(data, at)
    word = blocks.span_hash(blocks.prefix_hash(data, blocks.BYTE_VALUE_LOWER), starts, ends)
    before = np.r_[np.uint64(0), word[:-1]][: len(word)]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(word)])
    before[first] = 0
    key = lambda w: blocks.mix(w + np.uint64(0x51ED270B)) & ~_KIND
    bigram = blocks.mix(blocks.mix(before + np.uint64(0x2545F491)) + word) & ~_KIND | _BIGRAM
    last = word[np.r_[first[1:], len(word)] - 1] if len(word) else word
    return np.concatenate([bigram, key(before) | _CONTEXT]), np.concatenate([doc, doc]), key(last) | _LAST, np.bincount(doc, minlength=len(at) - 1)


def _postings(parts: int):
    """Rows (part, block, blob): n-grams of a block with their counts in it, in all documents and in the target's."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, target, data, at, _ in blocks.opened(batches):
            gram, doc, last, _ = document_grams(data, at)
            own, place = blocks.numbered(np.concatenate([gram, last]))
            place = place[: len(gram)]
            n, n_target = np.bincount(place, minlength=len(own)), np.bincount(place[target[doc]], minlength=len(own))
            order, part, edges = blocks.parts_of(own >> np.uint64(2), parts)
            code = (own >> np.uint64(2)) // np.uint64(parts) << np.uint64(2) | own & _KIND
            out = []
            for p, a, b in zip(part, edges, edges[1:], strict=False):
                rows = order[a:b]
                steps = np.diff(code[rows], prepend=np.uint64(0))  # ascending; their upper bytes are mostly 0
                out.append((p, block, blocks.deflate(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T, n[rows].astype("<u4"), n_target[rows].astype("<u4"))))
            yield from blocks.rows(out, *blocks.PART_ROW)

    return work


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of whole parts to rows (part, block, blob) of totals in the order of the postings, and a row of the part's sums."""
    names, kinds = [*blocks.PART_ROW[0], "words", "n", "n_target"], (*blocks.PART_ROW[1], *[pa.int64()] * 3)
    for part, rows in blocks.grouped(batches):
        code, n, n_target = [], [], []
        for _, blob in rows:
            steps, all_n, own_n = blocks.inflate(blob, "u1", "<u4", "<u4")
            code.append(np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64))
            n.append(all_n)
            n_target.append(own_n)
        edges = np.r_[0, np.cumsum([len(c) for c in code])].tolist()
        code, n, n_target = map(np.concatenate, (code, n, n_target))
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        sums = [np.add.reduceat(c[order].astype(np.int64), first) for c in (n, n_target)]
        held, group = np.diff(np.r_[first, len(code)]), np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(first)), held)
        kind = code[first] & _KIND
        words = blocks.distinct(code[first][kind != _BIGRAM] >> np.uint64(2))
        bigram = kind == _BIGRAM
        out = [(part, block, blocks.deflate(*(s[group[a:b]].astype("<i8") for s in sums)), None, None, None) for (block, _), a, b in zip(rows, edges, edges[1:], strict=False)]
        yield from blocks.rows([*out, (part, -1, None, len(words), int(sums[0][bigram].sum()), int(sums[1][bigram].sum()))], names, kinds)


def share(gram: np.ndarray, own: np.ndarray, target: np.ndarray, c_t: np.ndarray, c_b: np.ndarray, size: float, scale: float, alpha: float) -> np.ndarray:
    """What n-grams add to the loss difference: own counts ``own`` (in the target too if ``target``) of totals c_t, c_b."""
    context = (gram & _KIND) == _CONTEXT
    smooth = np.where(context, alpha * size, alpha)
    ratio = np.log((scale * (c_b - own) + smooth) / (c_t - own * target + smooth))
    return own * np.where(context, -ratio, ratio)


def _scores(parts: int, size: float, scale: float, alpha: float):
    """Blocks with their totals to rows (doc_id, n_words, in_target, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, target, data, at, (totals,) in blocks.opened(batches):
            gram, doc, last, words = document_grams(data, at)
            sums = np.zeros(len(ids))
            if len(gram):
                own, place = blocks.numbered(np.concatenate([gram, last]))
                order, part, edges = blocks.parts_of(own >> np.uint64(2), parts)
                c_b, c_t = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
                blob = {t["part"]: t["blob"] for t in totals}
                for p, a, b in zip(part, edges, edges[1:], strict=False):
                    c_b[order[a:b]], c_t[order[a:b]] = blocks.inflate(blob[p], "<i8", "<i8")
                key, times = np.unique(doc * np.int64(len(own)) + place[: len(gram)], return_counts=True)
                doc, place = key // len(own), key % len(own)
                sums = np.bincount(doc, share(own[place], times, target[doc], c_t[place], c_b[place], size, scale, alpha), minlength=len(ids))
            score = pa.array(sums / np.maximum(words, 1), mask=words == 0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == blocks.NO_ID), pa.array(words.astype(np.int64)), pa.array(target), score], ["doc_id", "n_words", "in_target", "score"])

    return work


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """id, n_words, in_target, score, one row per row of docs. targets: (id) of the target's documents."""
    ids = targets.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(True).alias("target")).filter("doc_id is not null").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(ids) if io.few(ids) else ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("flag"))
    packed = io.stored(rows.mapInArrow(blocks.tidy(blocks.pack(BLOCK_BYTES)), blocks.BLOCK), "blocks")
    parts = int(max(1, -(-(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) // PARTITION_BYTES)))
    posted = packed.mapInArrow(blocks.tidy(_postings(parts)), blocks.PART_SCHEMA).repartition(min(parts, io.MOST_PARTS), "part").sortWithinPartitions("part")
    totals = io.stored(posted.mapInArrow(blocks.tidy(_totals), TOTALS), "totals")
    io.collect_garbage(docs.sparkSession)
    # the start mark is a context but no word
    words, n, n_target = (x or 0 for x in totals.filter("block = -1").agg(F.sum("words"), F.sum("n"), F.sum("n_target")).first())
    by_block = totals.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("part", "blob")).alias("totals"))
    scored = packed.join(by_block, "block", "left").mapInArrow(blocks.tidy(_scores(parts, float(max(1, words - 1)), n_target / max(1, n), alpha)), "doc_id long, n_words long, in_target boolean, score double")
    scored = io.stored(scored, "scores")
    io.discard(packed, totals)
    return scored.withColumnRenamed("doc_id", id_col)


def op2_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of high quality; background: all documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cross_entropy_difference(io.documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id"))
