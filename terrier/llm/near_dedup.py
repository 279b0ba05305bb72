"""Near-duplicate groups by b-bit MinHash.

Each text gives a set of word shingles. Of ``HASHES`` minima per set, bands of rows become bucket keys and the low
``BITS`` bits of every minimum are packed into bit planes. Texts of one sequence of words (equal SHA-256 of the lower-case
words) are one class; its smallest id stands for it. Within a bucket every class is paired with its centre only, the class
whose buckets are largest together and so nearest to the middle of its group; pairs whose similarity, estimated from the
counts of differing bits and corrected for chance agreement, may reach the threshold are confirmed on the full sets, of
words and not of hashes. Components of the confirmed links are found, and then, in buckets that still span several
components, the classes outside the centre's component meet those of other components, in cells of about ``CELL`` by
``CELL`` classes, so that no task gets a whole bucket. So a group of n copies costs about n pairs, and yet no link between
two components is lost that a bucket shows.

Bands are chosen so that a pair at the threshold shares no bucket with a chance below ``MISS``.

Cases: null texts, empty texts and texts without words have no shingles and are linked with nothing; repeated rows and
equal texts are linked; rows with one id but different texts are one document, linked to whatever any of its texts is
linked to, each row with its own n_shingles; a row with a null id is linked with nothing, has no component_id and is kept;
ids are the tie-break; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

#: Minima of a set; the first BAND_HASHES make the bands, all make the estimate.
HASHES = 512
BAND_HASHES = 150
BITS = 4
MISS = 1e-5
PLANE_WORDS = -(-HASHES // 64)
#: Standard errors that an estimate may lie below the threshold and still be confirmed on the sets.
SLACK = 4
#: Classes of a bucket, or copies of a centre, that one task compares at once.
CELL = 256
#: Bytes of text whose shingles are hashed at once.
CHUNK_BYTES = 500_000
SIGNED = "doc_id long, n_shingles long, sequence binary, sig array<long>, bands array<long>"


def banding(threshold: float, hashes: int = BAND_HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows a band): the most rows at which a pair at the threshold is missed with a chance below ``miss``."""
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (hashes // r) <= miss]
    rows = max(fit, default=1)
    return hashes // rows, rows


def shingle_hashes(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles in text order, n + 1 offsets). Fewer words than ``width``: the whole sequence as one."""
    starts, ends, doc = blocks.words(data, at)
    n_docs = len(at) - 1
    per = np.bincount(doc, minlength=n_docs).astype(np.int64)
    word = blocks.span_hash(blocks.prefix_hash(data, blocks.BYTE_VALUE_LOWER), starts, ends)
    count = np.where(per >= width, per - width + 1, (per > 0).astype(np.int64))
    offsets = np.r_[0, np.cumsum(count)]
    first = np.cumsum(per) - per
    prefix = np.zeros(len(word) + 1, np.uint64)
    up, down = blocks.powers(len(word) + 1)
    np.cumsum(word * up[: len(word)], out=prefix[1:])
    begin = blocks.ranges(first, count)
    stop = np.minimum(begin + width, np.repeat(first + per, count))
    return blocks.mix((prefix[stop] - prefix[begin]) * down[begin] + (stop - begin).astype(np.uint64)), offsets


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(256)
    return rng.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)


def minima(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HASHES minima (32 bits each) of every non-empty set; one row a set."""
    out = np.empty((len(offsets) - 1, HASHES), np.uint32)
    scratch = np.empty_like(hashes)
    for k, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
        np.multiply(hashes, a, out=scratch)
        scratch += b
        out[:, k] = np.minimum.reduceat(scratch, offsets[:-1]) >> np.uint64(32)
    return out


def planes(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima as BITS planes of PLANE_WORDS 64-bit words."""
    padded = np.zeros((len(low), PLANE_WORDS * 64), np.uint8)
    out = []
    for bit in range(BITS):
        padded[:, :HASHES] = low >> np.uint32(bit) & np.uint32(1)
        out.append(np.packbits(padded, axis=1, bitorder="little").view("<i8"))
    return np.concatenate(out, axis=1)


def sequences(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """SHA-256 of the lower-case words of each text, one space between them."""
    space = blocks.SPACE[data]
    before = np.r_[True, space[:-1]][: len(data)]
    before[at[:-1][np.diff(at) > 0]] = True
    keep = ~(space & before)
    held = np.r_[0, np.cumsum(keep)][at].tolist()
    raw = np.where(space, np.uint8(32), blocks.LOWER[data])[keep].tobytes()
    return [hashlib.sha256(raw[a:b].rstrip(b" ")).digest() for a, b in zip(held, held[1:], strict=False)]


def _sign(width: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, "text", CHUNK_BYTES):
            data, at = blocks.text_bytes(batch.column(1))
            hashes, offsets = shingle_hashes(data, at, width)
            full = np.flatnonzero(np.diff(offsets))
            n = np.zeros(batch.num_rows, np.int64)
            sets = [blocks.distinct(hashes[offsets[i] : offsets[i + 1]]) for i in full.tolist()]
            n[full] = [len(x) for x in sets]
            sig, keys = np.zeros((0, BITS * PLANE_WORDS), np.int64), np.zeros((0, bands), np.int64)
            if len(full):
                low = minima(np.concatenate(sets), np.r_[0, np.cumsum(n[full])])
                sig = planes(low)
                keys = np.empty((len(full), bands), np.int64)
                for b in range(bands):
                    h = np.full(len(full), b + 1, np.uint64)
                    for column in low[:, b * rows : (b + 1) * rows].T:
                        h = blocks.mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
                    keys[:, b] = h.view(np.int64)
            take = np.full(batch.num_rows, -1)
            take[full] = np.arange(len(full))
            index = pa.array(take, mask=take < 0)
            lists = [blocks.list_column(x, w, pa.int64()).take(index) for x, w in ((sig, BITS * PLANE_WORDS), (keys, bands))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sequences(data, at), pa.binary()), *lists], ["doc_id", "n_shingles", "sequence", "sig", "bands"])

    return work


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(blocks.tidy(_sign(width, bands, rows)), SIGNED)


def differing(a: str, b: str):
    """Column: in how many of the HASHES minima the low bits differ."""
    total = F.lit(0)
    for w in range(PLANE_WORDS):
        bits = None
        for p in range(BITS):
            x = F.get(F.col(a), F.lit(p * PLANE_WORDS + w)).bitwiseXOR(F.get(F.col(b), F.lit(p * PLANE_WORDS + w)))
            bits = x if bits is None else bits.bitwiseOR(x)
        total = total + F.bit_count(bits)
    return total


def estimate(differ):
    """Similarity from the number of differing minima, corrected for chance agreement of the low bits."""
    chance = 1 / (1 << BITS)
    return (1 - differ / F.lit(float(HASHES)) - F.lit(chance)) / F.lit(1 - chance)


def _passes(threshold: float, a: str = "sig_a", b: str = "sig_b"):
    """The estimate may reach the threshold: it lies at most SLACK standard errors of the b-bit estimate below."""
    chance = 1 / (1 << BITS)
    agree = threshold + (1 - threshold) * chance
    error = (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)
    return estimate(differing(a, b)) >= threshold - SLACK * error


_LOWER_BYTES = bytes(blocks.LOWER)


def shingles(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves; bytes.split() parts at the same signs as blocks.SPACE."""
    words = text.encode().translate(_LOWER_BYTES).split()
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else {tuple(words)} if words else set()


def _confirm(width: int, percent: int):
    """Rows (b, salt, a, text) that come sorted, the text of b (null a) before those that are held against it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            found_a, found_b = [], []
            for i in range(batch.num_rows):
                b, salt, a, text = (c[i].as_py() for c in batch.columns)
                if (b, salt) != key:
                    key, heads = (b, salt), []
                own = shingles(text, width)
                if a is None:
                    heads.append(own)
                    continue
                for head in heads:
                    shared = len(head & own)
                    if shared and 100 * shared >= percent * (len(head) + len(own) - shared):
                        found_a.append(a)
                        found_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return work


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the threshold. The text of b goes once to every CELL of its pairs, that of a once a pair."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    own = io.stored(io.restrict(texts, ids, "doc_id").filter("text is not null"), "texts")
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL).cast("int").alias("salts"))
    heads = salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(own.withColumnRenamed("doc_id", "b"), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    members = pairs.join(salts, "b").select("b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"), "a").join(own.withColumnRenamed("doc_id", "a"), "a").select("b", "salt", "a", "text")
    rows = heads.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    links = io.stored(rows.mapInArrow(blocks.tidy(_confirm(width, percent)), "a long, b long").distinct(), "links")
    io.remove(own)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct ``width``-word shingles.
    """
    threshold = percent / 100
    bands, rows = banding(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = io.stored(signatures(docs, id_col, text_col, width, bands, rows), "signed")
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = io.stored(known.groupBy("sequence").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_members")), "classes")

    own = known.join(classes.select(F.col("rep").alias("doc_id"), "sequence"), ["doc_id", "sequence"], "left_semi")
    sigs = io.stored(own.select(F.col("doc_id").alias("rep"), "sig", "bands"), "sigs")
    keyed = sigs.select(F.posexplode("bands").alias("place", "band"), "rep")
    shared = io.stored(keyed.join(keyed.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "band"), "shared")
    weighed = shared.join(shared.groupBy("rep").agg(F.sum("n").alias("weight")), "rep").select("band", "rep", "weight")
    centre = weighed.groupBy("band").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("centre"))
    buckets = io.stored(shared.select("band", "place", "rep").join(centre, "band"), "buckets")

    pairs = buckets.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = io.stored(pairs.filter(_passes(threshold)).select("a", "b").distinct(), "pairs")
    links = confirmed(pairs, texts, width, percent)
    comps = io.connected_components(links, "a", "b")
    io.discard(shared, pairs, links)

    of = lambda df, key, name: df.join(comps.select(F.col("node").alias(key), F.col("comp").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.col(key)))
    placed = of(of(buckets, "rep", "comp"), "centre", "first")
    outside = io.stored(placed.filter("comp <> first"), "outside")
    if outside.take(1):
        more = _across(outside, placed, sigs, threshold)
        second = confirmed(more, texts, width, percent)
        io.remove(more)
        if second.take(1):
            merged = second.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
            joined = io.connected_components(merged.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "a", "b")
            comps = comps.join(joined.withColumnRenamed("comp", "top").withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
            comps = io.stored(comps.unionByName(joined.join(comps.select("node"), "node", "left_anti")), "comps")
    top = of(classes, "rep", "component_id").select("sequence", "n_members", "component_id")
    found = io.stored(_attach(signed.select("doc_id", "n_shingles", "sequence"), top), "found")
    io.discard(signed, classes, sigs, buckets, outside, comps)
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _across(outside: DataFrame, placed: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Stored (a, b) whose estimate may reach the threshold: classes outside their bucket's first component with those of other
    components of the bucket, each pair in the first bucket that it shares. A bucket of n by m classes is dealt to cells of about
    CELL by CELL of them.
    """
    # the counts of the buckets are joined without an exchange by bucket, so a hot bucket isn't gathered in one task
    n_out = io.stored(outside.groupBy("band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("rows")), "rows")
    inside = placed.filter("rep <> centre").join(io.narrow(n_out), "band")
    n_in = io.stored(inside.groupBy("band", "rows").agg(F.ceil(F.count("*") / CELL).cast("int").alias("columns")), "columns")
    sizes = io.narrow(n_in)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    left = outside.join(sizes, "band").withColumn("x", cell("rows", 1)).withColumn("y", upto("columns"))
    right = inside.join(sizes.drop("rows"), "band").withColumn("y", cell("columns", 2)).withColumn("x", upto("rows"))
    before = F.slice("bands", F.lit(1), F.col("place"))
    side = lambda df, i: df.join(sigs, "rep").select("band", "x", "y", F.col("rep").alias(i), F.col("comp").alias(f"comp_{i}"), F.col("sig").alias(f"sig_{i}"), before.alias(f"before_{i}"), "first")
    left, right = side(left, "a").drop("first"), side(right, "b")
    once = (F.col("comp_b") == F.col("first")) | (F.col("a") < F.col("b"))
    new = ~F.arrays_overlap("before_a", "before_b")  # the keys of two places differ, so this is their first shared bucket
    met = left.join(right, ["band", "x", "y"]).filter((F.col("comp_a") != F.col("comp_b")) & once & _passes(threshold) & new)
    more = io.stored(met.select("a", "b").distinct(), "more")
    io.remove(n_out, n_in)
    return more


def _attach(members: DataFrame, top: DataFrame) -> DataFrame:
    """members with the component of their class; those without shingles or id are alone. Large classes are looked up apart."""
    alone = F.col("n_shingles") == 0
    empty = members.filter(alone | F.col("doc_id").isNull()).withColumn("component_id", F.col("doc_id"))
    hit = io.skew_safe_join(members.filter(~alone & F.col("doc_id").isNotNull()), top, ["sequence"], "n_members", members.count())
    return hit.select("doc_id", "n_shingles", "component_id").unionByName(empty.select("doc_id", "n_shingles", "component_id"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(io.documents(spark, sf_dir), percent=85, width=5)
