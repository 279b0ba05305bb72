"""Exact dedup by a log-structured merge index of text digests.

Each task puts the digests of its rows into a memtable; a full memtable is flushed as a run sorted by digest, with a
Bloom filter. A digest that an older run of the task holds (its filter is asked first, then the run is searched) is
counted there instead. Runs of a level merge into one of the next level, keeping the smallest order key. The task's
runs are then compacted over all tasks by digest, and every row whose digest repeats is held against the bytes of the
row that stays.

Cases: null and empty texts are equal to each other; a null id stays only where all rows of its text have none,
whichever end is kept; a repeated id is a row like any other (of rows with the same text and id, each is kept if the id is); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

MEMTABLE_ROWS = 65_536
FANOUT = 4
FILTER_BITS = 12
PROBES = 5
#: The order key of a null id, behind all others.
NO_KEY = (1 << 63) - 1
RUN_SCHEMA = "digest binary, best long, n long, level int"


class Run:
    """Sorted distinct digests with the smallest order key and the number of rows of each, and a Bloom filter."""

    def __init__(self, digests: np.ndarray, best: np.ndarray, n: np.ndarray, level: int):
        self.digests, self.best, self.n, self.level = digests, best, n, level
        self.mask = np.uint64((1 << max(6, int(len(digests) * FILTER_BITS).bit_length())) - 1)
        self.bits = np.zeros((int(self.mask) + 1) // 8, np.uint8)
        for at in _probes(digests, self.mask):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def maybe(self, digests: np.ndarray) -> np.ndarray:
        out = np.ones(len(digests), bool)
        for at in _probes(digests, self.mask):
            out &= (self.bits[at >> 3] >> (at & 7)) & 1 == 1
        return out

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the digests that are here, and their places."""
        ask = np.flatnonzero(self.maybe(digests))
        at = np.minimum(np.searchsorted(self.digests, digests[ask]), len(self.digests) - 1)
        hit = self.digests[at] == digests[ask]
        return ask[hit], at[hit]


def _probes(digests: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
    words = np.frombuffer(np.ascontiguousarray(digests).tobytes(), "<u8").reshape(len(digests), -1)
    a, b = words[:, 0], words[:, -1] * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) & mask).astype(np.int64)


def _combined(digests: np.ndarray, best: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(digests, kind="stable")
    digests, best, n = digests[order], best[order], n[order]
    first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
    return digests[first], np.minimum.reduceat(best, first), np.add.reduceat(n, first)


class LsmIndex:
    """The index of one task."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.memtable: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows, self.limit, self.fanout = 0, memtable_rows, fanout
        self.runs: list[Run] = []

    def put(self, digests: np.ndarray, keys: np.ndarray) -> None:
        """digests: fixed-width byte strings, a multiple of 8 bytes wide; keys: the smallest of equal digests stays."""
        if not len(digests):
            return
        digests, best, n = _combined(digests, keys, np.ones(len(keys), np.int64))
        for run in reversed(self.runs):
            which, at = run.find(digests)
            if len(which):
                run.best[at] = np.minimum(run.best[at], best[which])
                run.n[at] += n[which]
                left = np.ones(len(digests), bool)
                left[which] = False
                digests, best, n = digests[left], best[left], n[left]
        self.memtable.append((digests, best, n))
        self.rows += len(digests)
        if self.rows >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.runs.append(Run(*_combined(*map(np.concatenate, zip(*self.memtable, strict=True))), level=0))
            self.compact()
        self.memtable, self.rows = [], 0

    def compact(self) -> None:
        while len(same := [r for r in self.runs if r.level == self.runs[-1].level]) >= self.fanout:
            merged = _combined(*(np.concatenate([getattr(r, k) for r in same]) for k in ("digests", "best", "n")))
            self.runs = [r for r in self.runs if r.level != same[0].level]
            self.runs.append(Run(*merged, level=same[0].level + 1))


def _task_runs(width: int, memtable_rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LsmIndex(memtable_rows)
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = batch.column(0).cast(pa.binary(width)) if batch.num_rows else None
            if raw is not None:
                index.put(np.frombuffer(raw.buffers()[1], f"V{width}", batch.num_rows, raw.offset * width).view(f"S{width}"), keys)
        index.flush()
        for run in index.runs:
            for low in range(0, len(run.digests), 50_000):
                part = slice(low, low + 50_000)
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(run.digests[part]), [None, pa.py_buffer(run.digests[part].tobytes())])
                yield pa.RecordBatch.from_arrays([digests.cast(pa.binary()), pa.array(run.best[part]), pa.array(run.n[part]), pa.array(np.full(len(digests), run.level, np.int32))], ["digest", "best", "n", "level"])

    return work


def build_index(rows: DataFrame, digest: str, key: str, width: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """The compacted index of rows: one row (digest, best, n) per digest."""
    runs = rows.select(F.col(digest).alias("digest"), F.col(key).alias("key")).mapInArrow(blocks.tidy(_task_runs(width, memtable_rows)), RUN_SCHEMA)
    return runs.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, digest_bits: int = 256, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", the id that stays of equal texts. normalise: Column -> Column applied to the text before
    texts are compared. digest_bits: 256 (SHA-256), or fewer to force collisions in tests.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text: Column = normalise(text) if normalise else text
    ordered = F.bitwise_not if keep == "max" else lambda c: F.col(c)  # x -> -x - 1 turns the order round without an overflow
    base = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text")).withColumn("_sha", F.sha2("_text", 256))
    full = F.unhex("_sha")
    narrow = digest_bits // 8
    base = base.withColumn("_digest", full if narrow >= 32 else F.concat(F.substring(full, 1, narrow), F.lit(bytes(32 - narrow))))
    base = base.withColumn("_key", F.coalesce(ordered("_id"), F.lit(NO_KEY)))
    index = io.stored(build_index(base, "_digest", "_key", memtable_rows=memtable_rows), "index")
    repeated = index.withColumnRenamed("digest", "_digest").filter("n > 1")
    total = docs.count()

    again = io.skew_safe_join(base, repeated, ["_digest"], "n", total).select("_id", "_text", "_digest", "_key", "best", "n", F.ceil(F.col("n") / 256).cast("int").alias("_salts"))
    staying = again.filter("_key = best").groupBy("_digest", "_salts").agg(F.first("_text").alias("_stays")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    others = again.withColumn("_salt", F.pmod(F.xxhash64("_key", F.lit(7)), F.col("_salts")).cast("int"))
    differ = io.stored(others.join(staying, ["_digest", "_salt"]).filter("_text <> _stays").select("_id", "_key", "_text", "_digest"), "collisions")

    rows = base.select("_id", "_sha", "_digest", "_key")
    out = _with_index(rows, repeated, total)
    if differ.take(1):
        bad = differ.select("_digest").distinct()
        texts = base.join(bad, "_digest", "left_semi").groupBy("_digest", "_sha", "_text").agg(F.min("_key").alias("_best2"), F.count("*").alias("_n2"))
        out = out.join(texts.drop("_text"), ["_digest", "_sha"], "left").withColumns({"best": F.coalesce("_best2", "best"), "n": F.coalesce("_n2", "n")})
    keep_id = F.when(F.col("n") == 1, F.col("_id")).when(F.col("best") != NO_KEY, ordered("best"))
    out = io.stored(out.select("_id", keep_id.alias("keep_id"), F.col("n").alias("group_size"), keep_id.eqNullSafe(F.col("_id")).alias("kept"), F.col("_sha").alias("text_sha256")), "rows")
    io.discard(index, differ)
    return out.withColumnRenamed("_id", id_col)


def _with_index(rows: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """rows with best and n of their digest; 1 for a digest that doesn't repeat."""
    if io.few(repeated):
        both = rows.join(F.broadcast(repeated), "_digest", "left")
    else:
        hit = io.skew_safe_join(rows, repeated, ["_digest"], "n", total)
        miss = rows.join(repeated.select("_digest"), "_digest", "left_anti")
        both = hit.unionByName(miss.withColumns({"best": F.col("_key"), "n": F.lit(1)}))
    return both.withColumns({"best": F.coalesce("best", "_key"), "n": F.coalesce("n", F.lit(1)).cast("long")})


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(io.documents(spark, sf_dir), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
