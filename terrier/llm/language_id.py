"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows of a text's UTF-8 bytes, each filter's
largest answer in the window goes through a rectifier to a softmax layer. The network is trained in numpy on windows of
a bounded sample of labelled texts of each language and applied to all windows of every whole text; a text's answer is the softmax of
its windows' mean logits, weighted by their bytes. For scoring, embedding and filters are folded into tables that are
looked up by pairs of bytes.

Cases: null texts and texts without a letter are ``und`` with score 0; an empty table gives no rows; repeated rows
are answered one by one; without labelled rows there is nothing to learn and every answer is ``und``; other columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from . import spark_io as io

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBEDDING = 8
#: Labelled texts that are learned from, shared evenly among the languages (of each those whose ids and texts have the
#: smallest hashes), at least so many of each that has them; and windows of each text.
SAMPLE_ROWS = 6000
SAMPLE_LEAST = 300
SAMPLE_WINDOWS = 3
EPOCHS = 4
UNKNOWN = "und"


def is_training(id_col: str = "doc_id", modulus: int = 3, held_out: int = 1) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != held_out


class ByteNet:
    """The network and its training."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32)
        self.p["bias"] = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.p["out"] = rng.normal(0, 0.3, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        self.p["out_bias"] = np.zeros(len(classes), np.float32)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        rows = np.arange(n)[:, None]
        emb = p["e"][x]
        tops, best = [], []
        for w in WIDTHS:
            out = sum(emb[:, j : WINDOW - w + 1 + j] @ p[f"f{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w))
            at = out.argmax(1)
            best.append(at)
            tops.append(out[rows, at, np.arange(FILTERS)])
        pre = np.concatenate(tops, 1) + p["bias"]
        h = np.maximum(pre, 0)
        logits = h @ p["out"] + p["out_bias"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        d = prob * (weight / weight.sum())[:, None]
        g = {"out": h.T @ d, "out_bias": d.sum(0), "e": np.zeros_like(p["e"])}
        dh = (d @ p["out"].T) * (pre > 0)
        g["bias"] = dh.sum(0)
        for k, (w, at) in enumerate(zip(WIDTHS, best, strict=True)):
            own = dh[:, k * FILTERS : (k + 1) * FILTERS]
            patch = at[:, :, None] + np.arange(w)  # n, FILTERS, w
            taken = x[rows[:, :, None], patch]
            vectors = p["e"][taken]  # n, FILTERS, w, EMBEDDING
            g[f"f{w}"] = np.einsum("nf,nfwe->wef", own, vectors).reshape(w * EMBEDDING, FILTERS)
            back = own[:, :, None, None] * p[f"f{w}"].reshape(w, EMBEDDING, FILTERS).transpose(2, 0, 1)
            np.add.at(g["e"], taken.reshape(-1), back.reshape(-1, EMBEDDING))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> ByteNet:
        rng = np.random.default_rng(7)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                own = order[low : low + batch]
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, g in self.gradient(x[own], y[own], weight[own]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """Answers of all filters to pairs of bytes at their start, and the rest of the wider filters."""
        p = self.p
        part = lambda w, j: p["e"] @ p[f"f{w}"][j * EMBEDDING : (j + 1) * EMBEDDING]
        pair = lambda w, j: (part(w, j)[:, None] + part(w, j + 1)[None]).reshape(65536, FILTERS)
        return {"start": np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0)], 1), "third": part(3, 2), "rest": pair(4, 2), "bias": p["bias"], "out": p["out"], "out_bias": p["out_bias"]}


def window_logits(t: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    out = np.empty((len(windows), t["out"].shape[1]), np.float32)
    k = FILTERS
    for low in range(0, len(windows), 256):
        x = windows[low : low + 256]
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        a = t["start"][pair]
        top = [a[:, :, :k].max(1), (a[:, :-1, k : 2 * k] + t["third"][x[:, 2:]]).max(1), (a[:, :-2, 2 * k :] + t["rest"][pair[:, 2:]]).max(1)]
        out[low : low + 256] = np.maximum(np.concatenate(top, 1) + t["bias"], 0) @ t["out"] + t["out_bias"]
    return out


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zero bytes, number of windows of each text, bytes in each window)."""
    sizes = np.diff(at)
    count = np.maximum(1, -(-sizes // WINDOW))
    first = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    flat[blocks.ranges(first * WINDOW, sizes)] = data
    held = np.full(int(count.sum()), WINDOW)
    held[first + count - 1] = sizes - (count - 1) * WINDOW
    return flat.reshape(-1, WINDOW), count, held


def train(docs: DataFrame, train_rows: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network for all languages of the training rows; each class counts alike."""
    text = F.col(text_col).cast("string")
    room = F.greatest(F.length(text) - F.lit(WINDOW // 2), F.lit(0))
    cuts = [F.substring(text, 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), room + 1).cast("int"), F.lit(WINDOW)) for i in range(SAMPLE_WINDOWS)]
    rows = docs.filter(F.col(lang_col).isNotNull() & text.isNotNull() & train_rows & text.rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long"), text).alias("_h"), F.array(*cuts).alias("cuts"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    classes = sorted(counts)
    if not classes:
        return None
    most = max(SAMPLE_LEAST, -(-SAMPLE_ROWS // len(classes)))
    lines = docs.sparkSession.createDataFrame([(k, io.hash_line(n, most)) for k, n in counts.items()], "lang string, _line long")
    near = rows.join(F.broadcast(lines), "lang").filter("_h <= _line").dropDuplicates(["lang", "_h"])
    sample, held = [], dict.fromkeys(classes, 0)
    for r in sorted(near.select("lang", "_h", "cuts").collect(), key=lambda r: (r["_h"], r["lang"])):
        held[r["lang"]] += 1
        if held[r["lang"]] <= most:
            sample.append(r)
    raw = [(c.encode()[:WINDOW], classes.index(r["lang"])) for r in sample for c in r["cuts"]]
    x = np.frombuffer(b"".join(b.ljust(WINDOW, b"\0") for b, _ in raw), np.uint8).reshape(-1, WINDOW)
    y = np.array([k for _, k in raw])
    per = np.maximum(np.bincount(y, minlength=len(classes)), 1)
    return ByteNet(classes).fit(x, y, (len(y) / (len(classes) * per))[y].astype(np.float32))


def _predict(shared, names: list[str]):
    """Rows (columns to keep, text, has a letter) to (columns, lang_pred, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, tables = shared.value
        for batch in blocks.chunks(batches, "_text"):
            windows, count, held = windows_of(*blocks.text_bytes(batch.column(len(names))))
            logits = window_logits(tables, windows) * held[:, None]
            first = np.cumsum(count) - count
            mean = np.add.reduceat(logits, first) / np.maximum(np.add.reduceat(held, first), 1)[:, None]
            prob = np.exp(mean - mean.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            has = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            best = prob.argmax(1)
            found = [classes[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.string()), pa.array(np.where(has, prob.max(1), 0).astype(np.float64))], [*names, "lang_pred", "score"])

    return work


def predict(net: ByteNet | None, docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, none of them named lang_pred, score, _text or _has, with lang_pred and score, one row per row of docs."""
    io.bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    own = docs.select(*[c.alias(k) for k, c in keep.items()], text.alias("_text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_has"))
    if net is None:
        return own.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((net.classes, net.tables()))  # a fixed size for each language
    schema = T.StructType([*own.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return own.mapInArrow(blocks.tidy(_predict(shared, list(keep))), schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 3, held_out: int = 1) -> DataFrame:
    """id, held_out, lang_pred, score; learned from rows whose crc32(id as text) % modulus is not held_out."""
    rows = is_training(id_col, modulus, held_out)
    keep = {"doc_id": F.col(id_col).cast("long"), "held_out": F.coalesce(~rows, F.lit(False))}
    return predict(train(docs, rows, id_col, text_col, lang_col), docs, keep, text_col).withColumnRenamed("doc_id", id_col)


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that are not ``und``."""
    net = train(docs, is_training(id_col), id_col, text_col, lang_col)
    found = predict(net, docs, {f"_c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)}, text_col)
    return found.filter(F.col("lang_pred") != UNKNOWN).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(io.documents(spark, sf_dir))
