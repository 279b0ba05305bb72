"""Ranked lexical search: the best documents of each query, found by branch and bound in a hierarchical max tree.

A first pass reads every document once and keeps, of the terms that any query asks for, the occurrences in blocks of
BLOCK_DOCS documents; the counts over all documents (how many hold a term, their number and total length) come from the
blocks. A second pass turns a block's occurrences into impacts and builds, per term, a tree of maxima over document ranges: ranges of LEAF
documents, FANOUT of them a node, and so on up to the block. A query starts at the root; its bound of a node is the weighted sum of its terms' maxima there. The node
with the highest bound is opened first, a leaf range by the exact scores of its documents; nodes with a bound below the
k-th score so far stay closed, and those with just that bound are opened, since they may hold an equal score with a smaller
id. The k best carry over from block to block of a task, so later blocks are mostly closed at their root. A task gives out
k rows a query, which are ranked in two steps.

The queries are a stated set that is held against all documents, in groups of about QUERY_BYTES of text, so that what
every task gets is bounded; each group is a pass over the documents.

Cases: null, empty and termless documents count nowhere and are not ranked; termless queries have no rows; the texts of
queries of one id are one query, a null query id is left out; document rows of one id are documents of their own; a null
document id ranks behind the others of its score; words of any length and texts of any length are read whole; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

BLOCK_DOCS, LEAF, FANOUT = 4096, 32, 16
#: A block ends after so many bytes of occurrences, however few documents it has.
BLOCK_BYTES = 32 << 20
QUERY_BYTES = 256_000
#: Tasks whose rows of a query are ranked together in the first step.
GROUPS = 1000
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
INDEX = "docs int, full long, total long, terms binary, dfs binary, data binary"


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the terms."""
    starts, ends = blocks.runs_of(TERM[data], at)
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def split(text: str | None) -> set[bytes]:
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    low = blocks.LOWER[data].tobytes()
    starts, ends, _ = terms(data, np.array([0, len(data)]))
    return {low[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


class Vocabulary:
    """The terms of a group of queries, looked up by hash and then by their bytes."""

    def __init__(self, words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64)
        at = np.r_[0, np.cumsum(sizes)]
        data = np.frombuffer(b"".join(words), np.uint8)
        hashes = blocks.span_hash(blocks.prefix_hash(data, blocks.BYTE_VALUE_LOWER), at[:-1], at[1:])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        if len(hashes) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of a group of queries have one hash")
        self.starts, self.sizes, self.data = at[:-1], sizes, data

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 for others."""
        out = np.full(len(starts), -1, np.int64)
        if not len(starts) or not len(self.hashes):
            return out
        h = blocks.span_hash(blocks.prefix_hash(data, blocks.BYTE_VALUE_LOWER), starts, ends)
        place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[place] == h)
        found = self.ids[place[hit]]
        same = self.sizes[found] == (ends - starts)[hit]
        hit, found = hit[same], found[same]
        sizes = self.sizes[found]
        equal = blocks.LOWER[data[blocks.ranges(starts[hit], sizes)]] == self.data[blocks.ranges(self.starts[found], sizes)]
        right = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes) if len(hit) else np.zeros(0, bool)
        out[hit[right]] = found[right]
        return out


def _indexed(words: list[bytes]):
    """Rows (doc_id, text) to blocks: ids, lengths, and the occurrences (term, document of the block, times), by term and document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words)
        ids, lengths, keys, times, n, size = [], [], [], [], 0, 0

        def block():
            nonlocal ids, lengths, keys, times, n, size
            key, tf = np.concatenate(keys), np.concatenate(times)
            order = np.argsort(key, kind="stable")
            key, tf = key[order], tf[order]
            term, doc = key >> 32, key & 0xFFFFFFFF
            present, first = np.unique(term, return_index=True)
            dfs = np.diff(np.r_[first, len(term)])
            length = np.concatenate(lengths)
            data = blocks.deflate(np.concatenate(ids), length, doc.astype("<i4"), tf.astype("<i8"))
            row = (n, int((length > 0).sum()), int(length.sum()), present.astype("<i8").tobytes(), dfs.astype("<i8").tobytes(), data)
            ids, lengths, keys, times, n, size = [], [], [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], [x.split()[0] for x in INDEX.split(", ")])

        for batch in blocks.chunks(batches, "text"):
            data, at = blocks.text_bytes(batch.column(1))
            starts, ends, doc = terms(data, at)
            term = vocabulary.find(data, starts, ends)
            length = np.bincount(doc, minlength=batch.num_rows).astype("<i8")
            ids_here = batch.column(0).fill_null(blocks.NO_ID).to_numpy().astype("<i8")
            own = term >= 0
            key = np.sort((term[own] << 32) | doc[own])
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            tf = np.diff(np.r_[new, len(key)])
            key = key[new]
            for low in range(0, batch.num_rows, BLOCK_DOCS):
                high = min(low + BLOCK_DOCS, batch.num_rows)
                if n and (n + high - low > BLOCK_DOCS or size > BLOCK_BYTES):
                    yield block()
                inside = (key & 0xFFFFFFFF >= low) & (key & 0xFFFFFFFF < high)
                ids.append(ids_here[low:high])
                lengths.append(length[low:high])
                keys.append(key[inside] - low + n)
                times.append(tf[inside])
                n += high - low
                size += 16 * int(inside.sum())
        if n:
            yield block()

    return work


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            term, df = (np.frombuffer(b"".join(c.to_pylist()), "<i8") for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], ["term", "df"])


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m), m = 50 + (50 * length * docs) div total."""
    if len(length) and 50 * int(length.max()) * docs >= 1 << 63:
        m = np.array([50 + 50 * int(n) * docs // total for n in length], np.int64)
    else:
        m = 50 + 50 * length * docs // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Tree:
    """A block's impacts, by term, and their maxima over document ranges."""

    def __init__(self, ids, length, doc, tf, term, dfs, docs: int, total: int):
        self.ids, self.doc = ids, doc.astype(np.int64)
        self.impact = impacts(tf, length[self.doc], docs, total)
        ranges_ = -(-len(ids) // LEAF)
        row = np.repeat(np.arange(len(term)), dfs)
        cell = row * (ranges_ + 1) + self.doc // LEAF
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
        low = np.zeros(len(term) * (ranges_ + 1), np.int32)
        if len(first):
            low[cell[first]] = np.maximum.reduceat(self.impact, first)
        #: the first place of each term's occurrences in each range; a range's end is the next one's beginning
        self.place = np.searchsorted(cell, np.arange(len(term) * (ranges_ + 1))).reshape(len(term), ranges_ + 1)
        self.levels = [low.reshape(len(term), ranges_ + 1)[:, :ranges_]]
        while self.levels[-1].shape[1] > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, self.levels[-1].shape[1], FANOUT), axis=1))

    def scores(self, rows: np.ndarray, weight: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents of the block, exact scores) of a leaf range's documents that hold a term."""
        begin = self.place[rows, leaf]
        n = self.place[rows, leaf + 1] - begin
        at = blocks.ranges(begin, n)
        out = np.zeros(LEAF, np.int64)
        np.add.at(out, self.doc[at] - leaf * LEAF, np.repeat(weight, n) * self.impact[at])
        held = np.flatnonzero(out)
        return held + leaf * LEAF, out[held]

    def search(self, rows: np.ndarray, weight: np.ndarray, best: Best) -> int:
        """Best-first from the root; the number of nodes opened."""
        top, opened = len(self.levels) - 1, 0
        heap = [(-int(weight @ self.levels[top][rows, 0].astype(np.int64)), top, 0)]
        while heap:
            bound, level, node = heapq.heappop(heap)
            if -bound < best.line:
                break
            opened += 1
            if not level:
                doc, score = self.scores(rows, weight, node)
                best.add(self.ids[doc], score)
                continue
            below = self.levels[level - 1]
            stop = min((node + 1) * FANOUT, below.shape[1])
            bounds = weight @ below[rows, node * FANOUT : stop].astype(np.int64)
            for k in np.flatnonzero(bounds >= best.line).tolist():
                heapq.heappush(heap, (-int(bounds[k]), level - 1, node * FANOUT + k))
        return opened


class Best:
    """The k best (score, id) so far; ``line``: the least score that can still get in."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.line = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        own = scores >= self.line
        if not own.any():
            return
        ids, scores = np.r_[self.ids, ids[own]], np.r_[self.scores, scores[own]]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.line = int(self.scores[-1])


def _search(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, docs: int, total: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        for batch in batches:
            for present, dfs, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                present, dfs = np.frombuffer(present, "<i8"), np.frombuffer(dfs, "<i8")
                if not len(present):
                    continue
                tree = Tree(*blocks.inflate(data, "<i8", "<i8", "<i4", "<i8"), present, dfs, docs, total)
                row_of = np.full(len(weights), -1, np.int64)
                row_of[present] = np.arange(len(present))
                for (_, own), b in zip(queries, best, strict=True):
                    rows = row_of[own]
                    held = rows >= 0
                    if held.any():
                        tree.search(rows[held], weights[own[held]], b)
        part = TaskContext.get().partitionId()
        found = [(q, b) for (q, _), b in zip(queries, best, strict=True) if len(b.ids)]
        if found:
            n = [len(b.ids) for _, b in found]
            ids = np.concatenate([b.ids for _, b in found])
            columns = [pa.array(np.repeat([q for q, _ in found], n)), pa.array(ids, mask=ids == blocks.NO_ID), pa.array(np.concatenate([b.scores for _, b in found])), pa.array(np.full(len(ids), part % GROUPS))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score", "part"])

    return work


def _ranked(texts: DataFrame, queries: list[tuple[int, set[bytes]]], k: int) -> DataFrame:
    words = sorted(set().union(*(w for _, w in queries)))
    number = {w: i for i, w in enumerate(words)}
    index = io.stored(texts.mapInArrow(blocks.tidy(_indexed(words)), INDEX), "index")
    docs, total = (x or 0 for x in index.agg(F.sum("full"), F.sum("total")).first())
    df = np.zeros(len(words), np.int64)
    for term, n in index.select("terms", "dfs").mapInArrow(_counted, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # a row a term of this group of queries
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    asked = [(q, np.array(sorted(number[w] for w in own), np.int64)) for q, own in queries]
    found = index.select("terms", "dfs", "data").mapInArrow(blocks.tidy(_search(asked, weights, docs, total, k)), "item_id long, doc_id long, score long, part long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k).drop("rank", "part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    out = io.stored(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
    io.discard(index)
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every query, equal scores by ascending id."""
    spark = docs.sparkSession
    io.bound_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = queries.select(F.col(query_id).cast("long").alias("item_id"), F.coalesce(F.col(query_text).cast("string"), F.lit("")).alias("text")).filter("item_id is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // query_bytes))
    out = None
    for g in range(groups):
        own: dict[int, set[bytes]] = {}
        for q, text in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toLocalIterator():
            own.setdefault(q, set()).update(split(text))
        found = [(q, w) for q, w in sorted(own.items()) if w]
        if found:
            part = _ranked(texts, found, k)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(io.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), whole GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
