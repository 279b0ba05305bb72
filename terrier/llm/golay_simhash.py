"""Near-duplicate groups by SimHash fingerprints that a Golay code hashes fuzzily.

A text's 64-bit fingerprint holds the majority of the bits of its word shingles' XXH64. Fingerprints link at 4 or fewer
differing bits. To find those links without holding all against all, a fingerprint is cut into three segments (22, 21 and
21 bits), and a segment is decoded by the perfect [23, 12, 7] Golay code, in which every word lies within 3 bits of just one
codeword: ``near(x)`` are the indices of the codewords of x and of all words one bit away, at most six. Two segments that
differ in at most two bits have a word between them at most one bit from both, so they share an index.

By pigeonhole, of three segments with four errors at most either one has none, and of the other two one has at most two:
keys of an exact segment and an index near another; or each has one, and then two have just one: keys of two indices near
two segments, where the segment of even weight gives its own index only and the odd one those of the words one bit away
(two segments one bit apart are of different parity). About 60 keys a fingerprint, and a pair within four bits always
shares one; pairs that share a key are verified.

Keys are range-partitioned together with the fingerprint, so a key of very many fingerprints is spread over partitions. A
task links within slices of at most SLICE fingerprints of a key and gives out a forest, never the pairs. Keys that span
slices are looked at again once components are known: only fingerprints outside the component that holds most of a key meet
its other slices.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts of one fingerprint are linked;
a row with a null id is linked with nothing and has no component; rows with one id are told apart by their texts, each linked
by its own fingerprint; ids are the tie-break; texts of any length are read whole; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

WIDTH, SEED, DISTANCE = 4, 42, 4
#: Bits of the segments, from the lowest.
SEGMENTS = (22, 21, 21)
SLICE = 4096
#: Pairs that a task holds before it makes a forest of them.
HELD_PAIRS = 1 << 20
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the code.
POLYNOMIAL = 0b101011100011


def _remainder(x: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (POLYNOMIAL << (bit - 11)), x)
    return x


def _errors() -> np.ndarray:
    """The error of at most three bits that each of the 2048 remainders stands for."""
    one = 1 << np.arange(23)
    two = (one[:, None] ^ one[None, :])[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] ^ one[None, :]).ravel())
    every = np.unique(np.r_[0, one, two, three])
    out = np.zeros(2048, np.int64)
    out[_remainder(every)] = every
    return out


_LOW, _HIGH, _ERROR = _remainder(np.arange(4096)), _remainder(np.arange(2048) << 12), _errors()


def decode(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within 3 bits of each 23-bit word."""
    return (x ^ _ERROR[_LOW[x & 0xFFF] ^ _HIGH[x >> 12]]) >> 11


def _sets(table: np.ndarray, only_first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of the distinct values of each row; only_first: rows of which the first column counts alone."""
    table = table.copy()
    if only_first is not None:
        table[only_first, 1:] = table[only_first, :1]
        table[~only_first, 0] = table[~only_first, 1]
    table.sort(axis=1)
    new = np.ones(table.shape, bool)
    new[:, 1:] = table[:, 1:] != table[:, :-1]
    return table[new], new.sum(axis=1)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints (uint64)."""
    x, parts, at = fingerprints.astype(np.uint64), [], 0
    for bits in SEGMENTS:
        parts.append((x >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
        at += bits
    tables = [np.stack([decode(p), *(decode(p ^ (1 << b)) for b in range(bits))], axis=1) for p, bits in zip(parts, SEGMENTS, strict=True)]
    near = [_sets(t) for t in tables]
    odd = [_sets(t, np.bitwise_count(p) % 2 == 0) for t, p in zip(tables, parts, strict=True)]
    rows, out, tag = [], [], 0
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            values, counts = near[j]
            row = np.repeat(np.arange(len(x)), counts)
            rows.append(row)
            out.append((tag << 40) | (parts[i][row] << 12) | values)
            tag += 1
    for i, j in ((0, 1), (0, 2), (1, 2)):
        (a, n_a), (b, n_b) = odd[i], odd[j]
        n = n_a * n_b
        row = np.repeat(np.arange(len(x)), n)
        place = blocks.ranges(np.zeros(len(x), np.int64), n)
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        rows.append(row)
        out.append((tag << 40) | (a[first_a[row] + place // n_b[row]] << 12) | b[first_b[row] + place % n_b[row]])
        tag += 1
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - width + 1)
    starts, stops = (ends - sizes)[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for low in range(0, n, 50_000):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low : low + 50_000], stops[low : low + 50_000], strict=True)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = blocks.text_bytes(batch.column(1))
        found = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            fp = batch.column(0).slice(low, 2000).to_numpy()
            row, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges (a, b) connect: (node, smallest node of its component), without the smallest ones."""
    nodes, place = blocks.numbered(np.r_[a, b])
    u, v = place[: len(a)], place[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[u], top[v])
        new = top.copy()
        np.minimum.at(new, top[u], low)
        np.minimum.at(new, top[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == top).all():
            break
        top = new
    other = top != np.arange(len(nodes))
    return nodes[other], nodes[top[other]]


class Forest:
    """Gathers edges, and makes a forest of them now and then."""

    def __init__(self):
        self.a, self.b, self.n, self.line = [], [], 0, HELD_PAIRS

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)
            if self.n >= self.line:
                self.shrink()
                self.line = max(HELD_PAIRS, 2 * self.n)

    def shrink(self) -> None:
        a, b = forest(np.concatenate(self.a), np.concatenate(self.b))
        self.a, self.b, self.n = [a], [b], len(a)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shrink()
        a, b = self.a[0], self.b[0]
        self.a, self.b, self.n = [], [], 0
        return a, b


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of a negative number, the bits of its absolute value would count


def _link(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp) that come sorted, to edges (a, b, null) and to slices (key, null, fingerprints) of the keys of which this task or a neighbour may have more."""
        trees, held_key, held_fp, first = Forest(), np.zeros(0, np.int64), np.zeros(0, np.int64), True
        slices: list[tuple[int, bytes]] = []

        def within(key, fp):
            step = 1
            at = np.flatnonzero(key[1:] == key[:-1])
            while len(at):
                met = at[linked(fp[at], fp[at + step])]
                trees.add(fp[met], fp[met + step])
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]

        def out():
            a, b = trees.take()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], ["a", "b", "fps"])
            for low in range(0, len(slices), 100):
                k, blob = zip(*slices[low : low + 100], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(blob, pa.binary())], ["a", "b", "fps"])
            slices.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = np.r_[held_key, batch.column(0).to_numpy()], np.r_[held_fp, batch.column(1).to_numpy()]
            edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            if first and len(edges) > 1:  # the partition's first key, or what is left of a key that was cut
                slices.append((int(key[0]), fp[: edges[1]].tobytes()))
                first = False
            within(key[: edges[-1]], fp[: edges[-1]])
            key, fp = key[edges[-1] :], fp[edges[-1] :]
            while len(key) > most:
                within(key[:most], fp[:most])
                slices.append((int(key[0]), fp[:most].tobytes()))
                key, fp, first = key[most:], fp[most:], True
            held_key, held_fp = key, fp
            if trees.n >= HELD_PAIRS or len(slices) >= 100:
                yield from out()
        if len(held_key):
            within(held_key, held_fp)
            slices.append((int(held_key[0]), held_fp.tobytes()))
        yield from out()

    return work


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, part, fps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fp = np.frombuffer(fps, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k)), pa.array(np.full(len(fp), part)), pa.array(fp)], ["key", "part", "fp"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = Forest()
    for batch in batches:
        for left, right in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = np.array(left, np.int64), np.frombuffer(right, np.int64)
            for low in range(0, len(a), 256):
                i, j = np.nonzero(linked(a[low : low + 256, None], b[None, :]))
                trees.add(a[low + i], b[j])
    a, b = trees.take()
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _between(found: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Edges between slices of one key; None if every such key lies in one component."""
    slices = found.filter("fps is not null").select(F.col("a").alias("key"), F.xxhash64("a", "fps").alias("part"), "fps")
    several = slices.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    slices = io.stored(slices.join(several, "key"), "slices")
    rows = slices.mapInArrow(_opened, "key long, part long, fp long")
    rows = io.stored(rows.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "placed")
    most = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
    outside = rows.join(most, "key").filter("comp <> most")
    outside = io.stored(outside.groupBy("key", "part").agg(F.collect_list("fp").alias("left")).select("key", "left"), "outside")
    if not outside.take(1):
        io.remove(slices, rows, outside)
        return None
    edges = io.stored(outside.join(slices, "key").select("left", F.col("fps").alias("right")).mapInArrow(_meet, "a long, b long").distinct(), "between")
    io.remove(slices, rows, outside)
    return edges


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE) -> DataFrame:
    """One row per row of docs: id, fingerprint, component_id."""
    io.bound_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = io.stored(texts.mapInArrow(blocks.tidy(_signed), "doc_id long, fp long"), "signed")
    classes = io.stored(signed.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    keyed = classes.select("fp").mapInArrow(blocks.tidy(_keyed), "key long, fp long").repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    found = io.stored(keyed.mapInArrow(blocks.tidy(_link(slice_rows)), "a long, b long, fps binary"), "found")
    comps = io.connected_components(found.filter("b is not null"), "a", "b")
    more = _between(found, comps)
    if more is not None:
        both = io.stored(comps.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), "both")
        io.remove(comps, more)
        comps = io.connected_components(both, "a", "b")
        io.remove(both)
    placed = classes.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    placed = io.stored(placed, "placed")
    tops = placed.groupBy("comp").agg(F.min("rep").alias("component_id"), F.count("*").alias("weight"))
    top = io.skew_safe_join(placed, tops, ["comp"], "weight", classes.count()).select("fp", "n", "component_id")
    hit = io.skew_safe_join(signed.filter("doc_id is not null"), io.stored(top, "top"), ["fp"], "n", signed.count())
    out = hit.select("doc_id", "fp", "component_id").unionByName(signed.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))
    out = io.stored(out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "rows")
    io.discard(signed, classes, found, comps, placed)
    return out


def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(io.documents(spark, sf_dir))
