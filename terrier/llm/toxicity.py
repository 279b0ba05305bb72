"""Toxicity scores by a counterfactual-regularised classifier.

A text's features are its distinct words and the distinct byte strings of ``GRAM`` bytes in them (a word begins with its
boundary), hashed. Features that go with label 1 are selected, and a logistic model is fitted in numpy. For every
labelled text that mentions an identity term, copies are made in which the term is swapped for the other terms of its
group; the fit is penalised by the squared change of the score's logit, and likewise for bare mentions, so that naming a
group, in whatever way, does not move a score.

Cases: null and empty texts get the bias' score; repeated rows are scored one by one; with no labelled rows, or labels
of one kind only, all scores are the smoothed share of label 1; an empty table gives no rows; labels that are null are
not learned; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io
from .quality import labelled_sample

GRAM = 5
#: Labelled documents of either kind that are learned from: those whose ids have the smallest hashes.
SAMPLE_ROWS = 4000
BUCKET_BITS = 22
PENALTY = 1.0
RIDGE, EVIDENCE, STEPS = 2e-6, 3.0, 1500
SWAPS = 3
#: Terms that name groups of people; those of a group are swapped for each other.
IDENTITY_GROUPS = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("muslims", "christians", "jews", "buddhists", "hindus", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
_GROUP_OF = {t: g for g in IDENTITY_GROUPS for t in g}
_TERM = re.compile(r"(?i)(?<!\w)(" + "|".join(sorted(_GROUP_OF, key=len, reverse=True)) + r")(?!\w)")


def swapped(text: str, swaps: int = SWAPS) -> list[str]:
    """Copies of text in which each identity term is exchanged for the 1st, 2nd, ... next term of its group."""
    if not text or not _TERM.search(text):
        return []

    def other(k: int):
        def put(m: re.Match) -> str:
            group = _GROUP_OF[m[0].lower()]
            return group[(group.index(m[0].lower()) + k) % len(group)]

        return put

    return [_TERM.sub(other(k), text) for k in range(1, swaps + 1)]


def occurrences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every word and every byte string of GRAM bytes within a word and its boundary."""
    inside = blocks.LOWER[data]
    letter = (inside >= 97) & (inside <= 122) | (data > 127)
    starts, ends = blocks.runs_of(letter, at)
    doc = np.searchsorted(at, starts, "right") - 1
    prefix = blocks.prefix_hash(data, blocks.BYTE_VALUE_LOWER)
    word = blocks.span_hash(prefix, starts, ends)
    shift = np.uint64(64 - BUCKET_BITS)
    head = np.minimum(starts + GRAM - 1, ends)
    heads = blocks.mix(blocks.span_hash(prefix, starts, head) + np.uint64(1))[ends - starts >= GRAM - 1]
    count = np.maximum(ends - starts - GRAM + 1, 0)
    grams = blocks.ranges(starts, count)
    inner = blocks.span_hash(prefix, grams, grams + GRAM) + np.uint64(2)
    feature = np.concatenate([word, heads, blocks.mix(inner)]) >> shift
    return feature.astype(np.int32), np.concatenate([doc, doc[ends - starts >= GRAM - 1], np.repeat(doc, count)])


def distinct_features(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    feature, doc = occurrences(data, at)
    key = blocks.distinct(doc.astype(np.int64) << BUCKET_BITS | feature)
    edges = np.searchsorted(key, np.arange(len(at)) << BUCKET_BITS)
    key = (key & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
    return [key[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _encoded(texts: list[str]) -> list[np.ndarray]:
    return distinct_features(*blocks.text_bytes(pa.array(texts, pa.string())))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, x, of) of the texts and, with y null, of their swapped copies; ``of`` is the text's id."""
    for batch in blocks.chunks(batches, "text"):
        ids, texts, labels = (batch.column(i).to_pylist() for i in range(3))
        full = list(zip(labels, texts, ids, strict=True))
        full += [(None, c, i) for t, i in zip(texts, ids, strict=True) for c in swapped(t or "")]
        x = _encoded([t or "" for _, t, _ in full])
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in full], pa.float64()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([r[2] for r in full], pa.int64())], ["y", "x", "of"])


class Linear:
    """Sparse weights over hashed features."""

    def __init__(self, bias: float, chosen: np.ndarray, weights: np.ndarray):
        self.bias, self.chosen, self.weights = bias, chosen, weights

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        place = np.full(1 << BUCKET_BITS, -1, np.int32) if not hasattr(self, "_place") else self._place
        if not hasattr(self, "_place"):
            place[self.chosen] = np.arange(len(self.chosen))
            self._place = place
        feature, doc = occurrences(data, at)
        slot = place[feature]
        hit = slot >= 0
        key = blocks.distinct(doc[hit].astype(np.int64) << BUCKET_BITS | slot[hit])
        z = self.bias + np.bincount(key >> BUCKET_BITS, self.weights[key & ((1 << BUCKET_BITS) - 1)], minlength=len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_place"}


def _csr(rows: list[np.ndarray], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = [s[s >= 0] for s in (slot[r] for r in rows)]
    return np.concatenate([*kept, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), [len(k) for k in kept])


def fit(rows: list[np.ndarray], y: np.ndarray, row_weight: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY) -> Linear:
    """A logistic model; pairs: features of two texts whose logits should be equal."""
    share = float((row_weight @ y + 1) / (row_weight.sum() + 2))
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Linear(bias, np.zeros(0, np.int64), np.zeros(0))
    size, ones = 1 << BUCKET_BITS, y > 0
    a, b = (np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(k)]), minlength=size) for k in (ones, ~ones))
    n_a, n_b = int(ones.sum()), int((~ones).sum())
    odds = np.log((a + 0.5) / (n_a - a + 0.5)) - np.log((b + 0.5) / (n_b - b + 0.5))
    # neutral words are no evidence against what the others say, however many a text has
    strong = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= EVIDENCE
    chosen = np.flatnonzero(strong & (a + b >= 3))
    slot = np.full(size, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    col, row = _csr(rows, slot)
    left, right = (_csr([p[k] for p in pairs], slot) for k in (0, 1))
    scale = row_weight / row_weight.sum()
    w, m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    w[-1] = bias
    steps = STEPS
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=len(rows)) + w[-1]
        r = scale * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.r_[np.bincount(col, r[row], minlength=len(chosen)), r.sum()]
        if pairs:
            change = np.bincount(left[1], w[left[0]], minlength=len(pairs)) - np.bincount(right[1], w[right[0]], minlength=len(pairs))
            d = 2 * penalty * change / len(pairs)
            g[:-1] += np.bincount(left[0], d[left[1]], minlength=len(chosen)) - np.bincount(right[0], d[right[1]], minlength=len(chosen))
        g[:-1] += RIDGE * w[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Linear(float(w[-1]), chosen, w[:-1])


def train(docs: DataFrame, labels: DataFrame, label: str, train_rows, id_col: str = "doc_id", text_col: str = "text") -> Linear:
    own = labels.filter(train_rows & F.col(label).isNotNull())
    totals = {r[0]: r[1] for r in own.groupBy(F.col(label).cast("int")).count().collect()}
    sample = None
    for kind in (0, 1):
        part = labelled_sample(docs, own.filter(F.col(label) == kind), label, train_rows, SAMPLE_ROWS, id_col, text_col)
        sample = part if sample is None else sample.unionByName(part)
    got = sample.select("doc_id", "text", "y").mapInArrow(blocks.tidy(_training_rows), "y double, x binary, of long").toArrow()
    order = sorted(range(got.num_rows), key=lambda i, of=got.column("of").to_pylist(), y=got.column("y").to_pylist(): (of[i], y[i] is None))
    got = got.take(pa.array(order, pa.int64()))
    x, of, y = ([np.frombuffer(b, np.int32) for b in got.column("x").to_pylist()], got.column("of").to_pylist(), got.column("y").to_pylist())
    base = {o: r for o, r, k in zip(of, x, y, strict=True) if k is not None}
    pairs = [(base[o], r) for o, r, k in zip(of, x, y, strict=True) if k is None and o in base]
    none = np.zeros(0, np.int32)
    for group in IDENTITY_GROUPS:
        bare = _encoded(list(group))
        pairs += [(r, none) for r in bare] + list(zip(bare, bare[1:] + bare[:1], strict=True))
    rows = [r for r, k in zip(x, y, strict=True) if k is not None]
    target = np.array([k for k in y if k is not None], float)
    per = {k: max(1, int((target == k).sum())) for k in (0, 1)}
    weight = np.where(target > 0, totals.get(1, 0) / per[1], totals.get(0, 0) / per[0])
    return fit(rows, target, weight, pairs)


def _scored(shared, line: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in blocks.chunks(batches, "text", blocks.CHUNK_BYTES // 2):
            score = model.score(*blocks.text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= line).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return work


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, held_out: int = 1, line: float = 0.7) -> DataFrame:
    """id, held_out, score, predicted; learned from labels whose crc32(id as text) % modulus is not held_out."""
    rows = F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held_out
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, rows, id_col, text_col))  # at most 2**BUCKET_BITS weights
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(~rows, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(blocks.tidy(_scored(shared, line)), "doc_id long, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_col)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(io.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
