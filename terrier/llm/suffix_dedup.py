"""Removal of byte strings that a document with a smaller id also holds, by a multi-document suffix order.

A string of ``length`` bytes is found in a candidate stage and judged in a suffix stage.

Blocks. Documents are packed into blocks of ``BLOCK_BYTES`` of text, a compressed table row each; every later exchange is
between blocks and parts of a hash space, one row for each pair, so a string that a third of all documents hold costs one
entry a block, and no task sees more than a part or a block. Of documents with equal texts (found and held against each
other byte by byte by exact dedup) only the one with the smallest id takes part.

Candidates. Of the windows of ``length`` bytes, each is assigned to its minimiser (the ``SEED``-byte string in it with
the smallest hash), so equal windows have equal minimisers. Minimisers that only one document holds are left out: their
windows cannot repeat. For the others the stretch of text of all windows assigned to one occurrence is a segment; equal
segments (compared by their bytes) are one, with the smallest id.

Suffix order. Segments meet by minimiser. Those that have a window in common with a different segment are ordered in
collections of about ``BUCKET_BYTES``; a segment without such a window is a collection of one string, whose windows all
belong to the smallest id that holds it. Column by column from the right, each round inserts one symbol of every segment
into the collection's Burrows-Wheeler transform; common prefixes of neighbouring suffixes are updated in the same round,
by minima over the intervals between equal symbols. Transform, prefixes and text places are sequential files, read once
and written once a round; they stay in memory up to ``FILE_BYTES`` and are seen by their own task only. In the final
order the suffixes that share ``length`` bytes are neighbours, and their smallest document id is the answer for all their
windows.

Cases: null and empty texts have no windows; a string that repeats within one document only stays; matches never cross
documents; overlaps count; rows with one id count as one document, each with a row of its own in the result; a null id
counts as larger than every id, and rows with a null id as one document; a text of any size is one block, whose task holds
some twenty times its bytes; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io
from .exact_dedup import exact_dedup

LENGTH = 50
SEED = 32
BLOCK_BYTES = 1_000_000
#: Bytes of text behind one part of the minimisers, and behind one part of the segments.
PARTITION_BYTES = 32_000_000
SEGMENT_PART_BYTES = 8_000_000
#: Bytes of segments of one collection, if they have more than one minimiser.
BUCKET_BYTES = 400_000
FILE_BYTES = 1 << 24
#: Window places worked on at a time; slices overlap by length - 1 bytes, and their places must fit into _PLACE.
SLICE = 1 << 17
_PLACE = np.uint64((1 << 18) - 1)


def minimisers(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the minimiser, first window, last window, document) of every run of windows with one minimiser."""
    n_windows = np.maximum(np.diff(at) - length + 1, 0)
    ends = at[:-1] + n_windows
    runs = []
    for low in range(0, len(data), SLICE):
        # only the documents that reach into the slice
        a, b = int(np.searchsorted(at, low, "right")) - 1, min(len(ends), int(np.searchsorted(at, low + SLICE, "left")))
        first, last = np.clip(at[a:b], low, low + SLICE), np.clip(ends[a:b], low, low + SLICE)
        own = blocks.ranges(first - low, np.maximum(last - first, 0))
        if len(own):
            runs.append(_runs(data[low : low + SLICE + length - 1], own, length, seed, low))
    if not runs:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    hashes, anchor, first, last = map(np.concatenate, zip(*runs, strict=True))
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])  # a run over an edge is one; documents share no place
    first, last = first[new], last[np.r_[new[1:], len(anchor)] - 1]
    return hashes[new], first, last, np.searchsorted(at, first, "right") - 1


def _runs(data: np.ndarray, windows: np.ndarray, length: int, seed: int, base: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of the minimisers of a slice that starts at base; of equal hashes (their upper
    bits) the first place counts.
    """
    width = length - seed + 1
    place = np.arange(len(data) - seed + 1)
    hashes = blocks.span_hash(blocks.prefix_hash(data), place, place + seed)
    low = (hashes & ~_PLACE) | place.astype(np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low[windows] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[new[1:], len(windows)] - 1
    return hashes[anchor[new]], anchor[new] + base, windows[new] + base, windows[last] + base


# -- candidates ------------------------------------------------------------------------------------------------------


def _short(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _postings(length: int, seed: int, parts: int):
    """Rows (part, block, blob): the distinct minimisers of a block, as short hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, _, data, at, _ in blocks.opened(batches, True):
            hashes = blocks.distinct(minimisers(data, at, length, seed)[0])
            order, own, edges = blocks.parts_of(hashes, parts)
            short = _short(hashes[order], parts)
            yield from blocks.rows([(p, block, short[a:b].tobytes()) for p, a, b in zip(own, edges, edges[1:], strict=False)], *blocks.PART_ROW)

    return work


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the postings of whole parts, rows (part, block, blob): the short hashes that another block holds too."""
    for part, rows in blocks.grouped(batches):
        own = [np.frombuffer(blob, "<u4") for _, blob in rows]
        row, short = np.repeat(np.arange(len(rows)), [len(x) for x in own]), np.concatenate(own)
        order = np.argsort(short)
        same = short[order][1:] == short[order][:-1]
        hit = np.zeros(len(short), bool)
        hit[order] = np.r_[False, same] | np.r_[same, False]
        row, short = row[hit], short[hit]
        edges = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
        yield from blocks.rows([(part, block, short[a:b].tobytes()) for (block, _), a, b in zip(rows, edges, edges[1:], strict=False) if a < b], *blocks.PART_ROW)


class Segments:
    """The candidate segments of a block: occurrences (doc, start, size, local), and the distinct ones in the order of local."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, at: np.ndarray, marks: list | None, length: int, seed: int, parts: int):
        hashes, first, last, doc = minimisers(data, at, length, seed)
        keep = np.zeros(len(hashes), bool)
        if marks:
            key = _short(hashes, parts).astype(np.uint64) << np.uint64(32) | hashes % np.uint64(parts)
            known = np.concatenate([np.frombuffer(m["blob"], "<u4").astype(np.uint64) << np.uint64(32) | np.uint64(m["part"]) for m in marks])
            known.sort()
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            keep |= known[place] == key
        # those that two documents of the block hold
        order = np.argsort(hashes)
        other = (hashes[order][1:] == hashes[order][:-1]) & (ids[doc[order]][1:] != ids[doc[order]][:-1])
        again = blocks.distinct(hashes[order][1:][other])
        if len(again):
            place = np.minimum(np.searchsorted(again, hashes), len(again) - 1)
            keep |= again[place] == hashes
        rows = np.flatnonzero(keep)
        self.doc, self.start, self.size = doc[rows], first[rows], last[rows] - first[rows] + length
        owner, anchor = ids[self.doc], hashes[rows]
        order, new = equal_spans(data, self.start, self.size, np.zeros(len(rows), np.uint64))
        group = np.cumsum(new) - 1
        self.local = np.empty(len(rows), np.int64)
        self.local[order] = group
        head = np.flatnonzero(new)
        self.n = len(head)
        self.low = np.minimum.reduceat(owner[order], head) if len(head) else np.zeros(0, np.int64)
        self.several = self.low != (np.maximum.reduceat(owner[order], head) if len(head) else self.low)
        self.anchor, self.at, self.length = anchor[order][head], self.start[order][head], self.size[order][head]


def equal_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and hash of the bytes, True where a span differs from the one before in key or any byte)."""
    hashes = np.empty(len(start), np.uint64)
    for low in range(0, len(start), 1 << 14):
        s = slice(low, low + (1 << 14))
        if not len(start[s]):
            break
        base, end = int(start[s].min()), int((start[s] + size[s]).max())
        if end - base > 1 << 22:  # spans from all over
            base, own = 0, blocks.ranges(start[s], size[s])
            at = np.r_[0, np.cumsum(size[s])]
            hashes[s] = blocks.span_hash(blocks.prefix_hash(data[own]), at[:-1], at[1:])
        else:
            hashes[s] = blocks.span_hash(blocks.prefix_hash(data[base:end]), start[s] - base, start[s] + size[s] - base)
    order = np.lexsort((hashes, key))
    new = np.ones(len(start), bool)
    if len(start) > 1:
        a, b = order[:-1], order[1:]
        pairs = np.flatnonzero((hashes[a] == hashes[b]) & (key[a] == key[b]) & (size[a] == size[b]))
        for low in range(0, len(pairs), 1 << 15):
            p = pairs[low : low + (1 << 15)]
            n = size[a[p]]
            differ = data[blocks.ranges(start[a[p]], n)] != data[blocks.ranges(start[b[p]], n)]
            new[p + 1] = np.add.reduceat(differ, np.cumsum(n) - n) > 0
    return order, new


def _segments(length: int, seed: int, parts: int, targets: int):
    """Rows (part, block, blob): the distinct candidate segments of a block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, _, _, data, at, (_, marks) in blocks.opened(batches, True):
            own = Segments(ids, data, at, marks, length, seed, parts)
            order, part, edges = blocks.parts_of(own.anchor // np.uint64(parts), targets)
            out = []
            for p, a, b in zip(part, edges, edges[1:], strict=False):
                rows = order[a:b]
                text = data[blocks.ranges(own.at[rows], own.length[rows])]
                out.append((p, block, blocks.deflate(rows.astype("<u4"), own.length[rows].astype("<u2"), own.several[rows], own.low[rows].astype("<i8"), own.anchor[rows], text)))
            yield from blocks.rows(out, *blocks.PART_ROW)

    return work


# -- suffix order ----------------------------------------------------------------------------------------------------


class ExternalColumn:
    """One array of the collection, kept as a file that each round reads once and writes once, in order."""

    def __init__(self, kind: type):
        self.kind, self.file = kind, tempfile.SpooledTemporaryFile(FILE_BYTES)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.frombuffer(self.file.read(), self.kind)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        self.file.write(values.tobytes())  # arrays only grow, so nothing of the round before is left


def suffix_order(text: np.ndarray, at: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(text places, common prefixes up to ``cap``) of all suffixes of the strings text[at[i]:at[i+1]], in order.

    Suffixes end with their string; an end is smaller than any byte, and two ends share nothing. Symbols must be below 255.
    """
    n = len(at) - 1
    if not len(text):
        return at[1:].astype(np.int32), np.zeros(n, np.uint8)
    transform, common, places = ExternalColumn(np.uint8), ExternalColumn(np.uint8), ExternalColumn(np.int32)
    lengths = np.diff(at)
    # round 0: the ends, in order of the strings
    transform.write(np.where(lengths > 0, text[np.maximum(at[1:] - 1, 0)] + np.uint8(1), np.uint8(0)))
    common.write(np.zeros(n, np.uint8))
    places.write(at[1:].astype(np.int32))
    string = np.flatnonzero(lengths > 0)
    where = string.copy()  # of the last suffix of each string that goes on; both in the order of the suffixes
    for step in range(1, int(lengths.max(initial=0)) + 1):
        bwt, lcp, sa = transform.read(), common.read(), places.read()
        size = len(bwt)
        order = np.argsort(bwt, kind="stable")  # a counting sort of bytes
        mark = np.zeros(size, bool)
        mark[where] = True
        r = np.flatnonzero(mark[order])  # ranks of the new suffixes among all equal symbols before them
        now = order[r]
        at_row = np.empty(size, np.int32)
        at_row[where] = string
        string = at_row[now]
        target = r - int(np.count_nonzero(bwt == 0)) + n  # ends come first; no suffix starts with the 0 of a finished string
        position = at[string + 1] - step
        incoming = np.where(position > at[string], text[np.maximum(position - 1, 0)] + np.uint8(1), np.uint8(0))
        symbol = bwt[now]
        before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, size - 1)]
        has_before, has_after = (r > 0) & (bwt[before] == symbol), (r + 1 < size) & (bwt[after] == symbol)
        padded = np.append(lcp, np.uint8(0))

        def span_min(left: np.ndarray, right: np.ndarray, lcp: np.ndarray = padded) -> np.ndarray:
            """1 + the minimum of lcp over (left, right], at most cap."""
            if not len(left):
                return np.zeros(0, np.uint8)
            cuts = np.empty(2 * len(left), np.int64)
            cuts[::2], cuts[1::2] = left + 1, right + 1
            return np.minimum(np.minimum.reduceat(lcp, cuts)[::2], cap - 1) + np.uint8(1)

        own = np.zeros(len(now), np.uint8)
        own[has_before] = span_min(before[has_before], now[has_before])
        follow = span_min(now[has_after], after[has_after])

        old = np.ones(size + len(now), bool)
        old[target] = False
        for column, was, new in ((transform, bwt, incoming), (places, sa, position)):
            out = np.empty(len(old), column.kind)
            out[old], out[target] = was, new
            column.write(out)
        out = np.empty(len(old), np.uint8)
        out[old], out[target] = lcp, own
        out[target[has_after] + 1] = follow
        common.write(out)
        going = position > at[string]
        string, where = string[going], target[going]
    return places.read(), common.read()


def window_owners(text: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For every place of the joined segments, the smallest owner of an equal window of ``length`` bytes; -1 where none begins."""
    place, common = suffix_order(text, at, length)
    string = np.searchsorted(at, place, "right") - 1
    string = np.minimum(string, len(at) - 2)
    full = (place + length <= at[string + 1]) & (place >= at[string])
    # an end's place is the next string's start: ends are the first suffixes of the order
    full[: len(at) - 1] = False
    new = np.r_[True, common[1:] < length]
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(np.where(full, owner[string], blocks.NO_ID), first)
    out = np.full(at[-1] + 1, -1, np.int64)
    out[place[full]] = np.repeat(low, np.diff(np.r_[first, len(place)]))[full]
    return out[:-1]


def collection_owners(data: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(string, low, high, owner) of the stretches of distinct strings whose windows belong to one owner, sorted by string."""
    at = np.r_[0, np.cumsum(size)]
    raw = data[blocks.ranges(start, size)]
    alphabet = np.zeros(256, np.uint8)
    present = np.flatnonzero(np.bincount(raw, minlength=256))
    alphabet[present] = np.arange(len(present))
    owners = window_owners(alphabet[raw], at, owner, length)
    count = np.maximum(size - length + 1, 0)
    spot, string = blocks.ranges(at[:-1], count), np.repeat(np.arange(len(size)), count)
    own = owners[spot]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (string[1:] != string[:-1])][: len(own)])
    last = np.r_[new[1:], len(spot)] - 1
    base = at[string[new]]
    return string[new], spot[new] - base, spot[last] - base + length, own[new]


def _judge(length: int):
    """Rows (block, blob) of the segments (part, block, blob) of whole parts: whose windows belong to smaller ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in blocks.grouped(batches):
            local, size, several, low, anchor, text = ([] for _ in range(6))
            n = []
            for _, blob in rows:
                own = blocks.inflate(blob, "<u4", "<u2", "?", "<i8", "<u8", "u1")
                n.append(len(own[0]))
                for column, values in zip((local, size, several, low, anchor, text), own, strict=True):
                    column.append(values)
            row = np.repeat(np.arange(len(rows)), n)
            local, size, several, low, anchor, data = map(np.concatenate, (local, size, several, low, anchor, text))
            del text
            size = size.astype(np.int64)
            start = np.cumsum(size) - size
            order, new = equal_spans(data, start, size, anchor)
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            owner = np.minimum.reduceat(low[order], head)
            at, length_of, key = start[order][head], size[order][head], anchor[order][head]
            found = [(np.arange(len(head)), np.zeros(len(head), np.int64), length_of, owner)]
            mixed = np.flatnonzero(_windows_met(data, at, length_of, key, length))
            if len(mixed):
                alone = np.ones(len(head), bool)
                alone[mixed] = False
                found = [tuple(c[alone] for c in found[0])]
                cuts = np.flatnonzero(np.r_[True, key[mixed][1:] != key[mixed][:-1]])
                held = np.cumsum(length_of[mixed])
                low_cut = 0
                for cut, following in zip(cuts, [*cuts[1:], len(mixed)], strict=True):
                    if held[following - 1] - (held[low_cut - 1] if low_cut else 0) >= BUCKET_BYTES or following == len(mixed):
                        own = mixed[low_cut:following]
                        string, a, b, o = collection_owners(data, at[own], length_of[own], owner[own], length)
                        found.append((own[string], a, b, o))
                        low_cut = following
            string, a, b, o = map(np.concatenate, zip(*found, strict=True))
            by = np.argsort(string, kind="stable")
            string, a, b, o = string[by], a[by], b[by], o[by]
            first = np.searchsorted(string, np.arange(len(head) + 1))
            count = np.diff(first)[group]
            posting = np.repeat(np.arange(len(group)), count)
            run = blocks.ranges(first[:-1][group], count)
            loses = several[posting] | (low[posting] > o[run])
            posting, run = posting[loses], run[loses]
            edges = np.searchsorted(row[posting], np.arange(len(rows) + 1)).tolist()
            out = []
            for (block, _), x, y in zip(rows, edges, edges[1:], strict=False):
                if x < y:
                    p, q = posting[x:y], run[x:y]
                    out.append((block, blocks.deflate(local[p], a[q].astype("<u2"), b[q].astype("<u2"), o[q].astype("<i8"))))
            yield from blocks.rows(out, ["block", "blob"], (pa.int64(), pa.binary()))

    return work


def _windows_met(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """True for the distinct strings (sorted by key) with a window whose hash another string of their key has too: only these need an order."""
    out = np.zeros(len(start), bool)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    several = np.flatnonzero(np.repeat(np.diff(np.r_[first, len(key)]) > 1, np.diff(np.r_[first, len(key)])))
    low = 0
    while low < len(several):
        high = min(len(several), low + (1 << 16))
        while high < len(several) and key[several[high]] == key[several[high - 1]]:
            high += 1
        own = several[low:high]
        low = high
        at = np.r_[0, np.cumsum(size[own])]
        count = size[own] - length + 1
        spot, string = blocks.ranges(at[:-1], count), np.repeat(np.arange(len(own)), count)
        hashes = blocks.span_hash(blocks.prefix_hash(data[blocks.ranges(start[own], size[own])]), spot, spot + length)
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        hit = order[np.r_[False, same] | np.r_[same, False]]
        out[own[string[hit]]] = True
    return out


# -- what is left ----------------------------------------------------------------------------------------------------


def _finish(length: int, seed: int, parts: int, with_text: bool):
    """Blocks with their marks and owners to one row per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, sizes, copy, data, at, (digests, marks, found) in blocks.opened(batches, True):
            gone = np.zeros(len(data), bool)
            if found:
                own = Segments(ids, data, at, marks, length, seed, parts)
                local, a, b, o = map(np.concatenate, zip(*(blocks.inflate(blob, "<u4", "<u2", "<u2", "<i8") for blob in found), strict=True))
                by = np.argsort(local, kind="stable")
                first = np.searchsorted(local[by], np.arange(own.n + 1))
                count = np.diff(first)[own.local]
                spot, run = np.repeat(np.arange(len(own.local)), count), by[blocks.ranges(first[:-1][own.local], count)]
                lost = o[run] < ids[own.doc[spot]]
                spot, run = spot[lost], run[lost]
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, own.start[spot] + a[run], 1)
                np.add.at(depth, own.start[spot] + b[run], -1)
                gone = np.cumsum(depth[:-1]) > 0
            if with_text and gone.any():  # only whole characters go
                lead = (data & 0xC0) != 0x80
                lead[0] = True
                gone = np.minimum.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
            starts, _ = blocks.runs_of(gone, at)
            spans = np.diff(np.searchsorted(starts, at))
            removed = np.diff(np.r_[0, np.cumsum(gone)][at])
            rest = data[~gone].tobytes()
            edges = np.r_[0, np.cumsum(np.diff(at) - removed)].tolist()
            kept = [rest[x:y] for x, y in zip(edges, edges[1:], strict=False)]
            whole = copy & (sizes > 0)
            columns = [pa.array(ids, mask=ids == blocks.NO_ID), pa.array(sizes), pa.array(np.where(copy, sizes, removed)), pa.array(np.where(whole, 1, spans).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary())]
                names += ["kept_text", "text_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return work


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256; with_text: also kept_text, the text that is
    left, of which only whole characters are removed (the counts are then those of whole characters), and text_sha256 of the
    text as it was, in binary.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, targets = max(1, -(-total // PARTITION_BYTES)), max(1, -(-total // SEGMENT_PART_BYTES))
    copies = exact_dedup(texts.filter(F.octet_length("text") >= length), keep="min").filter("not kept and doc_id is not null")
    copies = io.stored(copies.select("doc_id", F.col("text_sha256").alias("_sha"), F.lit(True).alias("_copy")).distinct(), "copies")
    marked = texts.withColumn("_sha", F.sha2("text", 256)).join(F.broadcast(copies) if io.few(copies) else copies, ["doc_id", "_sha"], "left")
    marked = marked.select("doc_id", "text", F.coalesce("_copy", F.lit(False)).alias("flag"), F.unhex("_sha").alias("digest"))
    packed = io.stored(marked.mapInArrow(blocks.tidy(blocks.pack(BLOCK_BYTES, True)), blocks.BLOCK + ", digest binary"), "blocks")

    posted = packed.mapInArrow(blocks.tidy(_postings(length, seed, parts)), blocks.PART_SCHEMA)
    shared = posted.repartition(int(min(parts, io.MOST_PARTS)), "part").sortWithinPartitions("part").mapInArrow(blocks.tidy(_shared), blocks.PART_SCHEMA)
    marks = io.stored(shared, "marks")
    io.collect_garbage(docs.sparkSession)
    by_block = marks.groupBy("block").agg(F.collect_list(F.struct("part", "blob")).alias("marks"))
    known = packed.join(by_block, "block", "left")
    segments = known.mapInArrow(blocks.tidy(_segments(length, seed, parts, targets)), blocks.PART_SCHEMA)
    owners = segments.repartition(int(min(targets, io.MOST_PARTS)), "part").sortWithinPartitions("part").mapInArrow(blocks.tidy(_judge(length)), "block long, blob binary")
    owners = io.stored(owners, "owners")
    io.collect_garbage(docs.sparkSession)
    full = known.join(owners.groupBy("block").agg(F.collect_list("blob").alias("found")), "block", "left")
    out = full.mapInArrow(blocks.tidy(_finish(length, seed, parts, with_text)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string, text_sha256 binary" if with_text else ""))
    out = io.stored(out, "left")
    io.discard(copies, packed, marks, owners)
    return out.withColumnRenamed("doc_id", id_col)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(io.documents(spark, sf_dir))
