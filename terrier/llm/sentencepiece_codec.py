"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked (a mark before it and for each space) and cut into marked words, over whose borders no piece goes. The
distinct words of a batch are sorted, which lays out their trie depth first: each word keeps the forward states of the
prefix that it shares with the word before and computes the rest. The state of a prefix is the last piece of its best
path. The file's model is of the byte-pair kind, so a path's transition between two pieces scores 0 if merging their
joined characters by rank ends in just these two, and minus infinity if not; exactly one path of a word is finite, and
it is the one that merging gives. Characters without a piece become byte pieces.

Cases: null and empty texts have no ids; U+2581 in a text is a space, as in the library; an empty table gives no rows;
repeated rows are encoded one by one; other columns are left out. Ids that a decoder doesn't know raise IndexError;
control and unknown ids decode to nothing.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

MARK = "▁"
NORMAL, BYTE = 1, 6
CACHE_WORDS = 400_000
CACHE_PAIRS = 2_000_000
_LAST = float("inf")
_NONE = -1  # before the first piece, and for a character without a piece


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of every id."""
    with open(path, "rb") as f:
        rows = [dict(_fields(v)) for k, v in _fields(f.read()) if k == 1]
    return [(r[1].decode(), struct.unpack("<f", r[2])[0] if 2 in r else 0.0, r.get(3, NORMAL)) for r in rows]


class Codec:
    """Encoder and decoder of one file; each worker keeps the last words' ids and the last pairs' transitions."""

    def __init__(self, path: str):
        pieces = read_pieces(path)
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.rank = {p: -s for p, s, t in pieces if t == NORMAL}  # the best score is the first
        self.text = [p for p, _, _ in pieces]
        self.size = len(pieces)
        # of the pieces that end with these two characters, or are one: lengths, longest first
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            lengths.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.pairs: dict[int, bool] = {}
        self.known: dict[int, tuple[int, ...]] = {}
        raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t == NORMAL else b"" for p, _, t in pieces]
        self.raw_length = np.array([len(b) for b in raw], np.int64)
        self.raw_first = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by rank leaves of text."""
        parts, rank = list(text), self.rank.get
        joined = [rank(a + b, _LAST) for a, b in zip(parts, parts[1:], strict=False)]
        while joined and (best := min(joined)) != _LAST:
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = rank(parts[at - 1] + parts[at], _LAST)
            if at < len(joined):
                joined[at] = rank(parts[at] + parts[at + 1], _LAST)
        return parts

    def follows(self, a: int, b: int) -> bool:
        """True if the transition from piece a (or _NONE) to piece b is finite."""
        key = (a + 1) * self.size + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            want = [self.text[b]] if a == _NONE else [self.text[a], self.text[b]]
            ok = self.pairs[key] = self.merged("".join(want)) == want
        return ok

    def walk(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of sorted marked words."""
        out, last, start, before = [], [_NONE], [0], ""
        ids, lengths, follows, transition, size = self.ids, self.lengths.get, self.follows, self.pairs.get, self.size
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                state, origin = _NONE, end - 1
                for n in lengths(word[end - 2 : end] if end > 1 else word[:1], ()) + (1,):
                    if n > end:
                        continue
                    begin = end - n
                    k = ids.get(word[begin:end])
                    if k is not None:
                        ok = transition((last[begin] + 1) * size + k)
                        if follows(last[begin], k) if ok is None else ok:
                            state, origin = k, begin
                            break
                last.append(state)
                start.append(origin)
            found, end = [], len(word)
            while end:
                k = last[end]
                found.extend((k,) if k != _NONE else [self.byte_ids[b] for b in reversed(word[start[end] : end].encode())])
                end = start[end]
            out.append(tuple(reversed(found)))
            before = word
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        marked = [(" " + t.replace(MARK, " ") if MARK in t else " " + t).encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(marked), np.uint8)
        at = np.r_[0, np.cumsum([len(m) for m in marked])].astype(np.int64)
        space = data == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        hashes = blocks.span_hash(blocks.prefix_hash(data), starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, raw = self.known, data.tobytes()
        keys, lows, highs = distinct.tolist(), starts[first].tolist(), ends[first].tolist()
        new = sorted((raw[a:b].decode().replace(" ", MARK), h) for h, a, b in zip(keys, lows, highs, strict=True) if h not in known)
        for (_, h), ids in zip(new, self.walk([w for w, _ in new]), strict=True):
            known[h] = ids
        rows = [known[h] for h in keys]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int32, int(lengths.sum()))
        per_word = lengths[inverse]
        ids = flat[blocks.ranges((np.cumsum(lengths) - lengths)[inverse], per_word)]
        cum = np.r_[0, np.cumsum(per_word)]
        return ids, np.diff(cum[np.searchsorted(starts, at)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes of all texts, n + 1 offsets)."""
        length = self.raw_length[ids]
        data = self.raw[blocks.ranges(self.raw_first[ids], length)]
        cum = np.r_[0, np.cumsum(length)]
        at = cum[np.r_[0, np.cumsum(counts)]]
        sizes = np.diff(at)
        lead = np.zeros(len(sizes), bool)
        full = sizes > 0
        lead[full] = data[at[:-1][full]] == 32
        keep = np.ones(len(data), bool)
        keep[at[:-1][lead]] = False
        return data[keep], np.r_[0, np.cumsum(sizes - lead)]


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, "text"):
            ids, counts = codec(path).encode([t or "" for t in batch.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return work


def _decoded(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([])
            counts = np.diff(lists.offsets.to_numpy())
            data, at = codec(path).decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)], pa.string())], ["doc_id", "text"])

    return work


def _checked(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.chunks(batches, "text"):
            ids, counts = codec(path).encode([t or "" for t in batch.column(1).to_pylist()])
            raw, at = blocks.text_bytes(batch.column(1))
            back, back_at = codec(path).decode(ids, counts)
            raw, back, flat = raw.tobytes(), back.tobytes(), ids.astype("<u4")
            stops = np.cumsum(counts)
            crc = [zlib.crc32(flat[b - n : b].tobytes()) for n, b in zip(counts.tolist(), stops.tolist(), strict=True)]
            same = [raw[a:b] == back[c:d] for a, b, c, d in zip(at, at[1:], back_at, back_at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return work


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    return _texts(docs, id_col, text_col).mapInArrow(blocks.tidy(_encoded(path or vocabulary_path())), "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids."""
    own = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(blocks.tidy(_decoded(path or vocabulary_path())), "doc_id long, text string").withColumnRenamed("doc_id", id_col)


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number and crc32 (little-endian unsigned 32-bit) of the ids, and whether decoding gives the text again."""
    return _texts(io.documents(spark, sf_dir), "doc_id", "text").mapInArrow(blocks.tidy(_checked(vocabulary_path())), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
