"""Quality scores by a generalised additive model with pairwise interactions.

A text gives a fixed list of shape features, computed from its bytes. Features are cut into bins; boosting goes round
the features, each time fitting a shallow tree to the residuals of one feature's bins and adding it, shrunk, to that
feature's lookup table. Then the pairs of features that explain most of what is left get tables over two features'
bins in the same way. A score is the logistic function of a sum of looked-up values.

Cases: null and empty texts are scored as texts of no bytes; repeated rows are scored one by one; with no labelled rows,
or labels of one kind only, all scores are the smoothed share of label 1; an empty table gives no rows; labels that are
null are not learned; a document with several labels counts once for each; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

FEATURES = ("log_bytes", "log_words", "mean_word", "long_words", "upper", "digits", "marks", "symbols", "spaces", "lines_per_word", "beyond_ascii", "distinct_words", "distinct_lines", "short_words", "word_end_marks", "longest_word", "capitalised", "mark_runs", "common_letters")
#: Labelled documents that are learned from: those whose ids have the smallest hashes.
SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 32, 8, 8, 150, 60, 0.15, 4
_BYTE = np.arange(256)
_UPPER, _DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_UPPER & ~_DIGIT & ~_LOWER
_SYMBOL = np.isin(_BYTE, list(b"#$%&*+<=>@[\\]^_`{|}~/"))
_COMMON = np.isin(_BYTE, list(b"aeinrst"))


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    n, size = len(at) - 1, np.diff(at).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return c[at[1:]] - c[at[:-1]]

    starts, ends, doc = blocks.words(data, at)
    length = (ends - starts).astype(float)
    per = lambda w=None: np.bincount(doc, w, minlength=n)
    words = np.maximum(per(), 1.0)
    prefix = blocks.prefix_hash(data, blocks.BYTE_VALUE_LOWER)

    def distinct(starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.ones(n)
        key = blocks.mix(blocks.span_hash(prefix, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        return np.bincount(doc[first], minlength=n) / np.maximum(np.bincount(doc, minlength=n), 1.0)

    line_starts, line_ends = blocks.runs_of(data != 10, at)
    line_doc = np.searchsorted(at, line_starts, "right") - 1
    top = np.zeros(n)
    np.maximum.at(top, doc, length)
    mark = _MARK[data]
    pair = mark.copy()
    pair[1:] &= mark[:-1]
    pair[:1] = False
    base = np.maximum(size, 1.0)
    columns = [
        np.log1p(size), np.log1p(per()), per(length) / words, per((length > 14).astype(float)) / words, share(_UPPER[data]) / base, share(_DIGIT[data]) / base,
        share(mark) / base, share(_SYMBOL[data]) / base, share(blocks.SPACE[data]) / base, share(data == 10) / words, share(data > 127) / base,
        distinct(starts, ends, doc), distinct(line_starts, line_ends, line_doc), per((length < 4).astype(float)) / words,
        per(mark[ends - 1].astype(float)) / words, np.log1p(top), per(_UPPER[data[starts]].astype(float)) / words, share(pair) / base, share(_COMMON[data]) / base,
    ]
    return np.stack(columns, 1)


def _tree(sums: np.ndarray, weights: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values of a greedy tree of contiguous leaves over bins with gradient sums and hessian weights."""
    cuts, value = [0, len(sums)], lambda a, b: sums[a:b].sum() / (weights[a:b].sum() + 1.0)
    cs, cw = np.r_[0, np.cumsum(sums)], np.r_[0, np.cumsum(weights)]
    gain = lambda s, w: s * s / (w + 1.0)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                k = np.arange(a + 1, b)
                g = gain(cs[k] - cs[a], cw[k] - cw[a]) + gain(cs[b] - cs[k], cw[b] - cw[k]) - gain(cs[b] - cs[a], cw[b] - cw[a])
                i = int(g.argmax())
                if g[i] > best[0]:
                    best = (g[i], int(k[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(sums))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = value(a, b)
    return out


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self):
        self.bias, self.edges, self.tables, self.pairs, self.pair_edges, self.pair_tables = 0.0, [], [], [], [], []

    @staticmethod
    def _edges(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.arange(1, bins) / bins))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        ones = float(y.sum())
        share = (ones + 1) / (len(y) + 2)
        self.bias = float(np.log(share / (1 - share)))
        if not 0 < ones < len(y):
            return self
        self.edges = [self._edges(c, BINS) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        z = np.full(len(y), self.bias)

        def boost(bin_of: np.ndarray, table: np.ndarray, shape: int | None = None) -> None:
            p = 1 / (1 + np.exp(-z))
            s, w = np.bincount(bin_of, y - p, minlength=table.size), np.bincount(bin_of, p * (1 - p), minlength=table.size)
            if shape is None:
                step = RATE * _tree(s, w, LEAVES)
            else:  # a shallow tree on each axis' split of the best single cut, both at once
                s2, w2 = s.reshape(-1, shape), w.reshape(-1, shape)
                rows = _tree(s2.sum(1), w2.sum(1), 2)
                columns = _tree(s2.sum(0), w2.sum(0), 2)
                part = np.unique(rows, return_inverse=True)[1][:, None] * 2 + np.unique(columns, return_inverse=True)[1][None]
                value = np.bincount(part.ravel(), s, minlength=4) / (np.bincount(part.ravel(), w, minlength=4) + 1.0)
                step = RATE * value[part.ravel()]
            table += step
            z[:] += step[bin_of]

        for _ in range(ROUNDS):
            for b, t in zip(bins, self.tables, strict=True):
                boost(b, t)
        coarse = [self._edges(c, PAIR_BINS) for c in x.T]
        coarse_bins = [np.searchsorted(e, c, "right") for e, c in zip(coarse, x.T, strict=True)]
        p = 1 / (1 + np.exp(-z))
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            cell = coarse_bins[i] * (len(coarse[j]) + 1) + coarse_bins[j]
            s, w = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
            gains.append((float((s * s / (w + 1.0)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((i, j))
            self.pair_edges.append((coarse[i], coarse[j]))
            self.pair_tables.append(np.zeros((len(coarse[i]) + 1) * (len(coarse[j]) + 1)))
        cells = [coarse_bins[i] * (len(coarse[j]) + 1) + coarse_bins[j] for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), cell, table in zip(self.pairs, cells, self.pair_tables, strict=True):
                boost(cell, table, len(coarse[j]) + 1)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=False):
            z += t[np.searchsorted(e, c, "right")]
        for (i, j), (a, b), t in zip(self.pairs, self.pair_edges, self.pair_tables, strict=True):
            z += t[np.searchsorted(a, x[:, i], "right") * (len(b) + 1) + np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-z))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks.chunks(batches, "text"):
        x = features(*blocks.text_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), blocks.list_column(x, x.shape[1], pa.float64())], ["y", "x"])


def _scored(shared, line: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, "text"):
            score = shared.value.score(features(*blocks.text_bytes(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= line).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return work


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of the ``rows`` labelled training documents whose ids have the smallest hashes; the ids are
    broadcast, at most ``rows`` of them.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).filter(train_rows)
    own = own.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(id_col).cast("long")).alias("_h"))
    picked = own.filter(F.col("_h") <= io.hash_line(own.count(), rows)).orderBy("_h", "y").limit(rows).select("doc_id", "y")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows: Column, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    sample = labelled_sample(docs, labels, label, train_rows, SAMPLE_ROWS, id_col, text_col)
    got = sample.select("y", "text").mapInArrow(blocks.tidy(_featured), "y double, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    return AdditiveModel().fit(x[order], y[order])


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 0, line: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted; learned from labels whose crc32(id as text) % modulus is not held_out."""
    rows = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held_out
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, rows, id_col, text_col))  # tables of a fixed size
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~rows, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(blocks.tidy(_scored(shared, line)), "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_col)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(io.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
