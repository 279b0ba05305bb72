"""Best-fit packing of tokenised documents by large-item matching.

A document's ids are those of a byte-level BPE file with an end id behind; documents longer than the capacity are cut
so that only the first piece is shorter. How many pieces have each length (a histogram of at most ``capacity``
entries) is all that the plan needs: pieces over a third of the capacity are paired greedily, at most two to a
sequence, and shorter ones go, longest first, into the smallest gap that holds them. The plan has slots (sequence,
offset) for each length; pieces take them by their rank among the pieces of that length.

Cases: null and empty texts are the end id alone; rows with equal ids or texts are packed one by one; an empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

CAPACITY = 1024
END_ID = 2
#: Fixed values of the vocabulary's pre-tokeniser.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPECIAL = "<|endoftext|>"
CACHE_WORDS = 200_000
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int"
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def char_classes() -> np.ndarray:
    """For each code point: letter, number, white space or other."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            shift = 0x800
            low, high = m.span()
            if high <= 0xD800:
                out[low:high] = kind
            elif low >= 0xD800:
                out[low + shift : high + shift] = kind
            else:
                out[low:0xD800], out[0xE000 : high + shift] = kind, kind
    return out


def split_points(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sorted starts of the pre-tokens in the code points of texts that begin at the offsets ``at`` (n + 1)."""
    n = len(codes)
    kind = char_classes()[codes]
    first = np.zeros(n + 1, bool)
    first[at] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    spaces = run[kind[run] == _SPACE]
    ends = np.r_[run[1:], n][kind[run] == _SPACE]
    inner = ~first[ends]  # a token follows in the same text
    spaces, ends = spaces[inner], ends[inner]
    start[ends - 1] = True
    blank = codes[ends - 1] == 32
    start[ends[blank]] = False  # a single space goes with what follows
    marks = np.flatnonzero((codes == 39) & start)
    for p in marks.tolist():
        stop = int(at[np.searchsorted(at, p, "right")]) if len(at) else n
        tail = "".join(map(chr, codes[p + 1 : min(p + 3, stop)].tolist()))
        hit = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
        if hit:
            q = p + 1 + len(hit)
            start[p + 1 : q] = False
            if q < stop and kind[q] != _SPACE:
                start[q] = True
            elif q < stop and not start[q] and not (codes[q] == 32):
                start[q] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts, by the pre-tokens' own ids; each worker keeps the last words' ids."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        ranks = path.rsplit(".", 1)[0] + ".tiktoken"
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        import public_tokenizers

        self.merge = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._encode_single_piece
        self.known: dict[int, tuple[int, ...]] = {}

    @functools.cached_property
    def full(self):
        """The library's own tokenizer, loaded for the first text that holds a special token."""
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        odd = {i for i, x in enumerate(texts) if SPECIAL in x}
        plain = ["" if i in odd else x for i, x in enumerate(texts)] if odd else texts
        joined = "".join(plain)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        at = np.r_[0, np.cumsum(sizes)]
        starts = split_points(codes, at)
        ends = np.r_[starts[1:], len(codes)]
        prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(blocks.mix(codes.astype(np.uint64) + np.uint64(1)) * blocks.powers(len(codes) + 1)[0][: len(codes)], out=prefix[1:])
        hashes = blocks.span_hash(prefix, starts, ends)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, merge, rows = self.known, self.merge, []
        for h, a, b in zip(distinct.tolist(), starts[where].tolist(), ends[where].tolist(), strict=True):
            ids = known.get(h)
            if ids is None:
                known[h] = ids = tuple(merge(joined[a:b]))
            rows.append(ids)
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.uint32, int(lengths.sum()))
        first = np.cumsum(lengths) - lengths
        ids = flat[blocks.ranges(first[inverse], lengths[inverse])]
        per_word = lengths[inverse]
        cum = np.r_[0, np.cumsum(per_word)]
        edges = cum[np.searchsorted(starts, at)]
        counts = np.diff(edges)
        if odd:
            whole = [self.full.encode(texts[i], add_special_tokens=False).ids if i in odd else ids[edges[i] : edges[i + 1]] for i in range(len(texts))]
            ids, counts = np.concatenate([np.asarray(x, np.uint32) for x in whole]), np.fromiter(map(len, whole), np.int64, len(whole))
        return ids, counts


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, capacity: int, end_id: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        for batch in blocks.chunks(batches, "text"):
            ids, counts = enc.encode([x or "" for x in batch.column(1).to_pylist()])
            rows: list[tuple] = []
            stops = np.cumsum(counts)
            for doc, n, stop in zip(batch.column(0).to_pylist(), counts.tolist(), stops.tolist(), strict=True):
                own = np.r_[ids[stop - n : stop], np.uint32(end_id)].astype("<u4")
                low, cut = 0, (n + 1) % capacity or capacity
                for k in range(-(-(n + 1) // capacity)):
                    rows.append((doc, k, low, cut - low, zlib.crc32(own[low:cut].tobytes()), part))
                    low, cut = cut, cut + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return work


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(blocks.tidy(_pieces(path, capacity, end_id)), PIECES_SCHEMA)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, offset): rank r of a length goes to sequence first + r - first rank.

    Work and size depend on the number of distinct lengths, not on the number of pieces.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is not between 1 and the capacity")
    large = sorted(k for k in left if 3 * k > capacity)
    groups: list[tuple[int, list[int]]] = []  # how many sequences hold these lengths
    while large:
        k = large[-1]
        at = bisect_left(large, capacity - k + 1) - 1
        if at < 0:
            groups.append((left[k], [k]))
            left[k] = 0
        else:
            mate = large[at]
            n = left[k] // 2 if mate == k else min(left[k], left[mate])
            if n:
                groups.append((n, [k, mate]))
                left[k] -= n
                left[mate] -= n
            if mate == k and left[k] == 1:
                large.pop()
                below = large[-1:]
                groups.append((1, [k, below[0]] if below else [k]))
                left[k] = 0
                if below:
                    left[below[0]] -= 1
        large = [x for x in large if left[x]]
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    open_gaps: list[int] = []

    def add(n: int, held: list[int]) -> None:
        gap = capacity - sum(held)
        if gap not in gaps:
            insort(open_gaps, gap)
        gaps.setdefault(gap, []).append((n, held))

    for n, held in groups:
        add(n, held)
    for k in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        while left[k]:
            at = bisect_left(open_gaps, k)
            if at == len(open_gaps):
                fit = capacity // k
                n, rest = divmod(left[k], fit)
                left[k] = 0
                if n:
                    add(n, [k] * fit)
                if rest:
                    add(1, [k] * rest)
                break
            gap = open_gaps[at]
            n, held = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            fit = gap // k
            full, rest = divmod(left[k], fit)
            if full >= n:
                add(n, held + [k] * fit)
                left[k] -= n * fit
            else:
                used = full
                if full:
                    add(full, held + [k] * fit)
                if rest:
                    add(1, held + [k] * rest)
                    used += 1
                if n > used:
                    add(n - used, held)
                left[k] = 0
    slots, rank, sequence = [], dict.fromkeys(left, 0), 0
    for gap in open_gaps:
        for n, held in gaps[gap]:
            offset = 0
            for k in held:
                slots.append((k, rank[k], n, sequence, offset))
                rank[k] += n
                offset += k
            sequence += n
    return slots


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    return -(-sum(k * n for k, n in histogram.items()) // capacity)


def _placed(shared):
    """Pieces with their rank among those of their length, last, to pieces with sequence and offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, low, sequence, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in PLACED[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[at] + rank - low[at]), pa.array(offset[at])], list(PLACED))

    return work


PLACED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, part) with sequence_id and offset.

    ``part`` numbers blocks of bounded size; ranks are counted within (part, length) and shifted by the counts of
    earlier parts, so no length, however common, meets in one task. The plan is broadcast: it grows with the distinct
    lengths and with the pieces of a sequence, both at most the capacity, and not with the number of pieces.
    """
    from pyspark.sql import Window as W

    counts = io.stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    length, low, _, sequence, offset = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5).T
    order = np.argsort((length << 44) + low, kind="stable")
    shared = pieces.sparkSession.sparkContext.broadcast([c[order] for c in ((length << 44) + low, low, sequence, offset)])
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = pieces.withColumn("_r", F.row_number().over(W.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["part", "length"]).select(*PLACED[:-2], (F.col("_r") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(blocks.tidy(_placed(shared)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = io.stored(tokenised_pieces(docs, path or vocabulary_path(), capacity, end_id), "pieces")
    out = io.stored(pack(pieces, capacity), "packed")
    io.discard(pieces)
    return out


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(io.documents(spark, sf_dir))
