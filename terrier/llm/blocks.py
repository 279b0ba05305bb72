"""Vectorised work on the UTF-8 bytes of Arrow text columns: chunks, words, hashes, and compressed blocks of documents."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Bytes of text that are worked on at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Words are runs of bytes other than these: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_ODD_INV = pow(_ODD, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@functools.cache
def _trim():
    """The allocator's call that gives free memory back to the system, or None."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def tidy(work):
    """work, a function for mapInArrow, whose task leaves no free memory in the Python worker that the next task will use: idle workers keep what
    they ever held, beside the executor's own heap.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _pow[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return tidied


def _mixer(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


BYTE_VALUE = _mixer(256, 20240501) | np.uint64(1)
BYTE_VALUE_LOWER = BYTE_VALUE[LOWER]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd number and of its inverse modulo 2**64."""
    if len(_pow[0]) < n:
        for k, odd in enumerate((_ODD, _ODD_INV)):
            full = np.full(n, odd, np.uint64)
            full[0] = 1
            _pow[k] = np.multiply.accumulate(full)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string or binary column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of at most ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def runs_of(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay within the documents given by offsets."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | edge[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words."""
    starts, ends = runs_of(~SPACE[data], at)
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes that depend on the bytes of each span and nothing else."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) of all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def binary_column(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of the consecutive slices of data."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a sort, which is many times faster here than np.unique's hash table."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them)."""
    order = np.argsort(values)
    ascending = values[order]
    new = np.r_[True, ascending[1:] != ascending[:-1]][: len(values)]
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ascending[new], place


def list_column(values: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
    """A list column of rows of ``width`` values."""
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * width), flat)


# -- blocks of documents, and rows (part, block, blob) between blocks and the parts of a hash space ----------------------

#: Stands for a null id.
NO_ID = np.iinfo(np.int64).max
BLOCK = "block long, ids binary, sizes binary, flag binary, data binary"
PART_ROW = (["part", "block", "blob"], (pa.int64(), pa.int64(), pa.binary()))
PART_SCHEMA = "part long, block long, blob binary"


def deflate(*columns: np.ndarray) -> bytes:
    """Columns, with their numbers of bytes, compressed."""
    raw = b"".join([np.array([c.nbytes for c in columns], "<i8").tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def inflate(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    at = np.r_[0, np.cumsum(np.frombuffer(raw, "<i8", len(kinds)))] + 8 * len(kinds)
    return [np.frombuffer(raw[at[i] : at[i + 1]], kind) for i, kind in enumerate(kinds)]


def pack(limit: int, without_flagged: bool = False):
    """Rows (doc_id, text, flag, further binary columns) to blocks of at most ``limit`` bytes of text, or one longer text;
    without_flagged: no texts of flagged rows. Values of a further column have one width and are joined.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", limit):
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            data, at = text_bytes(batch.column(1))
            flag = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if without_flagged and flag.any():
                data = data[~np.repeat(flag, np.diff(at))]
            more = [text_bytes(c)[0].tobytes() for c in batch.columns[3:]]
            row = (number, ids.astype("<i8").tobytes(), np.diff(at).astype("<i8").tobytes(), flag.astype(np.uint8).tobytes(), deflate(data), *more)
            number += 1
            names = ["block", "ids", "sizes", "flag", "data", *batch.schema.names[3:]]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * (4 + len(more))), strict=True)], names)

    return work


def opened(batches: Iterator[pa.RecordBatch], without_flagged: bool = False) -> Iterator[tuple]:
    """(block, ids, sizes, flag, data, at, further columns) of every block, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            block, ids, sizes, flag, data, *more = (c[i].as_py() for c in batch.columns)
            ids, sizes, flag = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8"), np.frombuffer(flag, bool)
            yield block, ids, sizes, flag, inflate(data, "u1")[0], np.r_[0, np.cumsum(np.where(flag, 0, sizes) if without_flagged else sizes)], more


def rows(values: list[tuple], names: list[str], kinds: tuple) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(values), 500):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values[low : low + 500], strict=True), kinds, strict=True)], names)


def parts_of(key: np.ndarray, parts: int) -> tuple[np.ndarray, list[int], list[int]]:
    """(order by key % parts, parts that occur, their edges in the order)."""
    part = (key % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")  # 16 bits: a counting sort
    part = part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    return order, part[first].tolist(), [*first.tolist(), len(part)]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(part, [(block, blob)]) of rows (part, block, blob) that come sorted by part; one part is held at a time."""
    now, held = None, []
    for batch in batches:
        for part, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append((block, blob))
    if held:
        yield now, held
