"""The similarities of ``similarity`` over many pairs at once, as steps over whole columns of pairs; and bounds that they never pass.

Texts become rows of character codes. The longest common subsequence is kept in bit vectors, one step for each character of the
second texts; alignment and edit distance go row by row, where a gap along the row is a running maximum (minimum). A text
is prepared once, however many pairs it is in.

Bounds: a text's characters, each with its number among its equals, are marked in 128 bits; what two texts share is at most the bits
that both have, and as many more as a bit stands for several of the characters of both. No common subsequence is longer.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from . import similarity as S

#: Cells of the largest scratch array that a step works on.
CELLS = 4_000_000
#: Cells that a window of a text counts for: its steps' scratch stays in a processor's cache.
PARTIAL_CELLS = 64
#: What ends a token in the form "ends".
TOKEN_END = " "


class Texts:
    """Distinct texts, prepared."""

    def __init__(self, values: list[str], symbols: np.ndarray | None = None):
        self.values = self.plain = values
        self.length = np.array([len(v) for v in values], np.int64)
        self._forms: dict[str, np.ndarray] = {}
        self._bits: tuple[np.ndarray, np.ndarray] | None = None

    # the forms by words are made for the scores that ask for them

    @functools.cached_property
    def tokens(self) -> list[list[str]]:
        return [sorted(set(v.split())) for v in self.values]

    @functools.cached_property
    def sorted(self) -> list[str]:
        return [" ".join(sorted(v.split())) for v in self.values]

    @functools.cached_property
    def sorted_length(self) -> np.ndarray:
        return np.array([len(v) for v in self.sorted], np.int64)

    @functools.cached_property
    def sets(self) -> list[str]:
        return [" ".join(t) for t in self.tokens]

    @functools.cached_property
    def set_length(self) -> np.ndarray:
        return np.array([len(v) for v in self.sets], np.int64)

    def form(self, kind: str) -> np.ndarray:
        """Code points (n, longest), 0 behind a text's end. kind: plain, sorted, sets, or sets with a blank after each token ("ends")."""
        if kind not in self._forms:
            values = [v + TOKEN_END if v else "" for v in self.sets] if kind == "ends" else getattr(self, kind)
            width = max([1, *map(len, values)])
            self._forms[kind] = np.array(values, f"<U{width}").view(np.uint32).reshape(len(values), width).astype(np.int64) if values else np.zeros((0, 1), np.int64)
        return self._forms[kind]

    def bits(self) -> tuple[np.ndarray, np.ndarray]:
        """(bits (n, 2), characters that share a bit with another of their text)."""
        if self._bits is None:
            code = self.form("plain")
            seen = np.zeros(code.shape, np.int64)
            for j in range(1, code.shape[1]):
                seen[:, j] = (code[:, :j] == code[:, j : j + 1]).sum(axis=1)
            upper = np.where((code >= 97) & (code <= 122), code - 32, code)
            letter = (upper >= 65) & (upper <= 90)
            place = np.where(letter, (upper - 65) * 4 + np.minimum(seen, 3), 104 + (upper + 5 * seen) % 24)
            out = np.zeros((len(code), 2), np.uint64)
            for j in range(code.shape[1]):
                on = code[:, j] > 0
                half, bit = place[:, j] // 64, (place[:, j] % 64).astype(np.uint64)
                rows = np.flatnonzero(on)
                out[rows, half[rows]] |= np.uint64(1) << bit[rows]
            lost = self.length - np.bitwise_count(out).sum(axis=1).astype(np.int64)
            self._bits = out, lost
        return self._bits


def _chunks(n: int, width: int):
    step = max(1, CELLS // max(1, width))
    return ((low, min(low + step, n)) for low in range(0, n, step))


def _alike(n_a: np.ndarray, n_b: np.ndarray, cells: Callable[[int, int], int]):
    """(rows, longest first text, longest second text) of parts of the pairs that are about as long as each other, so that a long text costs its own pairs only."""
    kind = np.ceil(np.log2(np.maximum(n_a, 1))) * 64 + np.ceil(np.log2(np.maximum(n_b, 1)))
    order = np.argsort(kind, kind="stable")
    edges = np.flatnonzero(np.r_[True, kind[order][1:] != kind[order][:-1]][: len(order)])
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(order)][: len(edges)], strict=True):
        own = order[low:high]
        a, b = max(1, int(n_a[own].max())), max(1, int(n_b[own].max()))
        for first, last in _chunks(len(own), cells(a, b)):
            yield own[first:last], a, b


def _ends(a: np.ndarray) -> np.ndarray:
    """Places up to the last character."""
    return a.shape[1] - np.argmax(a[:, ::-1] > 0, axis=1) * (a > 0).any(axis=1) - a.shape[1] * ~(a > 0).any(axis=1)


def _coded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes from 0 (nothing) to the number of distinct characters of a."""
    symbols = np.unique(a)
    symbols = symbols[symbols > 0]
    code = lambda x: np.where((x > 0) & (np.searchsorted(symbols, x) < len(symbols)) & (symbols[np.minimum(np.searchsorted(symbols, x), len(symbols) - 1)] == x), np.searchsorted(symbols, x) + 1, 0)
    return (code(a), code(b), len(symbols)) if len(symbols) else (np.zeros_like(a), np.zeros_like(b), 0)


def lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequence of each row of a with that of b; 0 is no character."""
    out = np.zeros(len(a), np.int64)
    for own, n_a, n_b in _alike(_ends(a), _ends(b), lambda n, m: n + m + 64 * -(-n // 64)):
        x, y, n = _coded(a[own, :n_a], b[own, :n_b])
        if not n:
            continue
        words, rows = -(-x.shape[1] // 64), np.arange(len(x))
        where = np.zeros((len(x), n + 1, words), np.uint64)
        for i in range(x.shape[1]):
            where[rows, x[:, i], i // 64] |= np.uint64(1) << np.uint64(i % 64)
        where[:, 0] = 0
        v = np.full((len(x), words), np.iinfo(np.uint64).max, np.uint64)
        for j in range(y.shape[1]):
            hit = v & where[rows, y[:, j]]
            if words == 1:
                v = (v + hit) | (v - hit)
                continue
            carry = np.zeros(len(x), np.uint64)
            for w in range(words):
                part = v[:, w] + hit[:, w]
                over = part < v[:, w]
                total = part + carry
                carry = (over | (total < part)).astype(np.uint64)
                v[:, w] = total | (v[:, w] - hit[:, w])
        out[own] = np.bitwise_count(~v).sum(axis=1)
    return out


def _window_lcs(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """lcs() of each row of small, 64 signs at most, with every window of its length of that row of large, those over the ends among them. A window's step is a step along the
    marks of the row's signs, so that no window is written out.
    """
    size, n = small.shape[1], large.shape[1]
    x, y, symbols = _coded(small, large)
    rows = np.arange(len(x))
    where = np.zeros((len(x), symbols + 1), np.uint64)
    for i in range(size):
        where[rows, x[:, i]] |= np.uint64(1) << np.uint64(i)
    where[:, 0] = 0
    marks = np.zeros((len(x), n + 2 * (size - 1)), np.uint64)
    marks[:, size - 1 : size - 1 + n] = np.take_along_axis(where, y, axis=1)
    width = n + size - 1
    v = np.full((len(x), width), np.iinfo(np.uint64).max, np.uint64)
    hit, total = np.empty_like(v), np.empty_like(v)
    for j in range(size):
        np.bitwise_and(v, marks[:, j : j + width], out=hit)
        np.add(v, hit, out=total)
        np.subtract(v, hit, out=v)
        np.bitwise_or(v, total, out=v)
    return np.bitwise_count(~v).astype(np.int64)


def _share(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 0.0)


def _ratio_of(kind: str, size: str) -> Callable:
    def score(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
        a, b = getattr(p, size)[i], getattr(q, size)[j]
        out = _share(lcs(p.form(kind)[i], q.form(kind)[j]), a + b)
        return np.where((a > 0) & (b > 0), out, 0.0)

    return score


def _partial_of(kind: str, size: str) -> Callable:
    """Windows of the longer text, as long as the shorter, also over its ends."""

    def score(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        a, b, n_a, n_b = p.form(kind), q.form(kind), getattr(p, size)[i], getattr(q, size)[j]
        swap = n_a > n_b
        short, long = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
        order = np.lexsort((long, short))
        order = order[short[order] > 0]
        if not len(order):
            return out
        edges = np.flatnonzero(np.r_[True, (short[order][1:] != short[order][:-1]) | (long[order][1:] != long[order][:-1])][: len(order)])
        for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            own = order[low:high]
            s, n = int(short[own[0]]), int(long[own[0]])
            begin = np.arange(1 - s, n)
            size_ = np.minimum(begin + s, n) - np.maximum(begin, 0)
            for first, last in _chunks(len(own), (PARTIAL_CELLS if s <= 64 else 2 * s) * len(begin)):
                k = own[first:last]
                left, right = a[i[k]], b[j[k]]
                small = np.where(swap[k, None], right[:, :s] if right.shape[1] >= s else 0, left[:, :s] if left.shape[1] >= s else 0)
                large = np.where(swap[k, None], left[:, :n] if left.shape[1] >= n else 0, right[:, :n] if right.shape[1] >= n else 0)
                if s <= 64:
                    common = _window_lcs(small, large)
                else:
                    place = begin[:, None] + np.arange(s)
                    inside = (place >= 0) & (place < n)
                    windows = np.where(inside, large[:, np.where(inside, place, 0)], 0)
                    common = lcs(np.repeat(small, len(begin), axis=0), windows.reshape(-1, s)).reshape(len(k), len(begin))
                out[k] = (200.0 * common / (s + size_)).max(axis=1)
        return out

    return score


def _token_set(inner: Callable, partial: bool) -> Callable:
    def score(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        ids: dict[str, int] = {}
        a, b = (_token_ids(t, ids) for t in (p, q))
        for low, high in _chunks(len(i), a.shape[1] * b.shape[1] + 1):
            x, y = i[low:high], j[low:high]
            met = (a[x][:, :, None] == b[y][:, None, :]) & (a[x][:, :, None] >= 0)
            in_a, in_b = met.any(axis=2), met.any(axis=1)
            any_ = in_a.any(axis=1)
            found = np.zeros(len(x))
            none = np.flatnonzero(~any_ & (p.set_length[x] > 0) & (q.set_length[y] > 0))
            found[none] = inner(p, x[none], q, y[none])
            some = np.flatnonzero(any_)
            found[some] = 100.0 if partial else _with_common(p, x[some], q, y[some], in_a[some], in_b[some])
            out[low:high] = found
        return out

    return score


def _token_ids(t: Texts, ids: dict[str, int]) -> np.ndarray:
    out = np.full((len(t.values), max([1, *map(len, t.tokens)])), -1, np.int64)
    for row, own in enumerate(t.tokens):
        for k, token in enumerate(own):
            out[row, k] = ids.setdefault(token, len(ids))
    return out


def _rest(t: Texts, rows: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the tokens that are not common, each with a blank behind; their joined length; the common ones' joined length)."""
    code = t.form("ends")[rows]
    token = np.cumsum(code == 32, axis=1) - (code == 32)
    gone = np.take_along_axis(common, np.minimum(token, common.shape[1] - 1), axis=1) & (code > 0)
    kept = np.where(gone, 0, code)
    return kept, np.maximum((kept > 0).sum(axis=1) - 1, 0), np.maximum(gone.sum(axis=1) - 1, 0)


def _with_common(p, x, q, y, in_a, in_b) -> np.ndarray:
    left, n_left, both = _rest(p, x, in_a)
    right, n_right, _ = _rest(q, y, in_b)
    common = lcs(left, right)  # with a blank at both ends, where both have something left
    whole = (n_left == 0) | (n_right == 0)
    l, r = both + 1 + n_left, both + 1 + n_right
    sides = np.maximum(_share(both + np.where(whole, 0, common), l + r), np.maximum(_share(both, both + l), _share(both, both + r)))
    return np.where(whole, 100.0, sides)


ratio, token_sort = _ratio_of("plain", "length"), _ratio_of("sorted", "sorted_length")
partial, partial_sort = _partial_of("plain", "length"), _partial_of("sorted", "sorted_length")
token_set = _token_set(_ratio_of("sets", "set_length"), False)
partial_set = _token_set(_partial_of("sets", "set_length"), True)


def weighted(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
    a, b = p.length[i], q.length[j]
    out = ratio(p, i, q, j)
    long = np.maximum(a, b) / np.maximum(np.minimum(a, b), 1)
    full = (a > 0) & (b > 0)
    near, far = np.flatnonzero(full & (long < 1.5)), np.flatnonzero(full & (long >= 1.5))
    out[near] = np.maximum(out[near], 0.95 * np.maximum(token_sort(p, i[near], q, j[near]), token_set(p, i[near], q, j[near])))
    scale = np.where(long[far] > 8, 0.6, 0.9)
    parts = np.maximum(partial_sort(p, i[far], q, j[far]), partial_set(p, i[far], q, j[far]))
    out[far] = np.maximum(out[far], np.maximum(scale * partial(p, i[far], q, j[far]), scale * 0.95 * parts))
    return out


def edits(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
    """100 less the edit distance as a share of the longer text."""
    a, b, n_a, n_b = p.form("plain"), q.form("plain"), p.length[i], q.length[j]
    out = np.zeros(len(i))
    for own, most_a, most_b in _alike(n_a, n_b, lambda n, m: 4 * m + n):
        x, y = a[i[own], :most_a], b[j[own], :most_b]
        ramp = np.arange(y.shape[1] + 1)
        row = np.repeat(ramp[None, :], len(x), axis=0)
        last = row.copy()
        for k in range(x.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = k + 1
            new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (y != x[:, k : k + 1]))
            row = np.minimum.accumulate(new - ramp, axis=1) + ramp
            done = n_a[own] == k + 1
            last[done] = row[done]
        distance = np.take_along_axis(last, n_b[own, None], axis=1)[:, 0]
        out[own] = 100.0 * (1 - distance / np.maximum(np.maximum(n_a[own], n_b[own]), 1))
    return out


def alignment(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
    """M1. Texts are taken in upper case."""
    up = lambda t: t if all(v == v.upper() for v in t.values) else Texts([v.upper() for v in t.values])
    p, q = up(p), up(q)
    a, b, n_a = p.form("plain"), q.form("plain"), p.length[i]
    symbols = np.unique(np.r_[a.ravel(), b.ravel()])
    steps = np.full((len(symbols), len(symbols)), -0.5)
    for group in S.LOOKALIKES:
        own = np.flatnonzero(np.isin(symbols, [ord(c) for c in group]))
        steps[np.ix_(own, own)] = 1.5
    np.fill_diagonal(steps, 2.0)
    steps[symbols == 0] = steps[:, symbols == 0] = -1e9
    a, b = np.searchsorted(symbols, a), np.searchsorted(symbols, b)
    out = np.zeros(len(i))
    for own, most_a, most_b in _alike(n_a, q.length[j], lambda n, m: 6 * m + n):
        x, y = a[i[own], :most_a], b[j[own], :most_b]
        ramp = np.arange(y.shape[1])
        row, best = np.zeros((len(x), y.shape[1] + 1)), np.zeros(len(x))
        for k in range(x.shape[1]):
            new = np.maximum(0.0, np.maximum(row[:, :-1] + steps[x[:, k : k + 1], y], row[:, 1:] - 1))
            row[:, 1:] = np.maximum.accumulate(new + ramp, axis=1) - ramp
            best = np.maximum(best, row[:, 1:].max(axis=1))
        out[own] = best
    n = np.maximum(n_a, 1)
    return np.where((n_a > 0) & (q.length[j] > 0), np.minimum(100.0, 100.0 * out / (2 * n)), 0.0)


def sequence(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
    """M7, whose matching blocks depend on each other; so one pair at a time, after the bound."""
    return np.array([S.sequence_ratio(p.values[x], q.values[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], float)


def shared(p: Texts, row: int, q: Texts) -> np.ndarray:
    """At most so many characters are common to a text and each of the others, in any order."""
    (a, lost_a), (b, lost_b) = p.bits(), q.bits()
    both = np.bitwise_count(b & a[row]).sum(axis=1).astype(np.int64) + np.minimum(lost_b, lost_a[row])
    return np.minimum(both, np.minimum(q.length, p.length[row]))


def _bound_ratio(p, row, q, o):
    return _share(o, p.length[row] + q.length)


def _bound_sort(p, row, q, o):
    a, b = p.sorted_length[row], q.sorted_length
    return _share(np.minimum(o, np.minimum(a, b)), a + b)


def _bound_set(p, row, q, o):
    """Where tokens are common, their joined length gives the scores against either side; the two sides' own is bound by what they share."""
    a, b, both = p.set_length[row], q.set_length, _common_tokens(p, row, q)
    sides = np.maximum(_share(both, both + a), _share(both, both + b))
    return np.where((both > 0) & ((both == a) | (both == b)), 100.0, np.maximum(_share(np.minimum(o, np.minimum(a, b)), a + b), np.where(both > 0, sides, 0.0)))


def _common_tokens(p: Texts, row: int, q: Texts) -> np.ndarray:
    """Joined length of the tokens that a text and each of the others have in common; 0 without one."""
    if not hasattr(q, "_postings"):
        held: dict[str, list[int]] = {}
        for k, own in enumerate(q.tokens):
            for token in own:
                held.setdefault(token, []).append(k)
        q._postings = {token: np.array(rows) for token, rows in held.items()}
    out = np.zeros(len(q.values), np.int64)
    for token in p.tokens[row]:
        if token in q._postings:
            out[q._postings[token]] += len(token) + 1
    return np.maximum(out - 1, 0)


def _bound_partial(p, row, q, o):
    short = np.minimum(p.length[row], q.length)
    return np.where(o > 0, 200.0 * np.minimum(o, short) / np.maximum(short + np.minimum(o, short), 1), 0.0)


def _bound_weighted(p, row, q, o):
    a, b = p.length[row], q.length
    long = np.maximum(a, b) / np.maximum(np.minimum(a, b), 1)
    scale = np.where(long > 8, 0.6, 0.9)
    token = _common_tokens(p, row, q) > 0
    near = np.maximum(_bound_ratio(p, row, q, o), 0.95 * np.maximum(_bound_sort(p, row, q, o), _bound_set(p, row, q, o)))
    short = np.minimum(p.set_length[row], q.set_length)  # the shortest of all forms, so its share is the largest
    m = np.minimum(o, short)
    loose = np.where(m > 0, 200.0 * m / np.maximum(short + m, 1), 0.0)
    far = np.maximum(_bound_ratio(p, row, q, o), np.maximum(scale * _bound_partial(p, row, q, o), scale * 0.95 * np.where(token, 100.0, np.maximum(loose, _bound_partial(p, row, q, o)))))
    return np.where(np.minimum(a, b) == 0, 0.0, np.where(long < 1.5, near, far))


def _bound_edits(p, row, q, o):
    return 100.0 * o / np.maximum(np.maximum(p.length[row], q.length), 1) + 1e-9 + np.where((p.length[row] == 0) & (q.length == 0), 100.0, 0.0)


def _bound_sequence(p, row, q, o):
    return np.where((p.length[row] == 0) & (q.length == 0), 1.0, _bound_ratio(p, row, q, o) / 100)


def label(p: Texts, i: np.ndarray, q: Texts, j: np.ndarray) -> np.ndarray:
    """1 if the first text contains the second, else M7 for second texts of six signs or more, else 0."""
    out = np.array([float(q.values[y] in p.values[x]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], float)
    near = np.flatnonzero((out == 0) & (q.length[j] >= 6))
    out[near] = sequence(p, i[near], q, j[near])
    return out


def _bound_label(p, row, q, o):
    return np.where(o >= q.length, 1.0, np.where(q.length >= 6, _bound_sequence(p, row, q, o), 0.0))


class Scorer:
    """A score of pairs in batches, and a bound of a text's scores with all others."""

    def __init__(self, score: Callable, bound: Callable | None):
        self.score, self._bound = score, bound

    def bounds(self, p: Texts, row: int, q: Texts) -> np.ndarray:
        return self._bound(p, row, q, shared(p, row, q)) + 1e-9 if self._bound else np.full(len(q.values), np.inf)


SCORERS = {
    "ratio": Scorer(ratio, _bound_ratio), "partial": Scorer(partial, _bound_partial), "token_sort": Scorer(token_sort, _bound_sort), "token_set": Scorer(token_set, _bound_set),
    "weighted": Scorer(weighted, _bound_weighted), "edits": Scorer(edits, _bound_edits), "alignment": Scorer(alignment, None), "sequence": Scorer(sequence, _bound_sequence),
    "label": Scorer(label, _bound_label),
}


def _numbered(values: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct values and the number of each."""
    ids: dict[str, int] = {}
    numbers = np.fromiter((ids.setdefault(v, len(ids)) for v in values), np.int64, len(values))
    return list(ids), numbers


def of_pairs(name: str, left: list[str], right: list[str]) -> np.ndarray:
    """Scores of the pairs of two columns, each distinct text prepared and each distinct pair scored once."""
    a, i = _numbered(left)
    b, j = _numbered(right)
    pair, back = np.unique(i * max(1, len(b)) + j, return_inverse=True)
    found = SCORERS[name].score(Texts(a), pair // max(1, len(b)), Texts(b), pair % max(1, len(b)))
    return found[back]


def best(name: str, probes: Texts, names: Texts, least: float, k: int | None, first: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(probe, name, score) of all pairs that score ``least`` or more; with k, of each probe's k best and those equal to its k-th.
    The last value is the number of pairs that were scored: those whose bound reaches what is needed.
    """
    scorer = SCORERS[name]
    rows, cols, later = [], [], []
    every = least <= 0 and len(names.values) <= (max(first, 2 * k) if k is not None else 0)  # so few that no bound leaves one out
    if every:
        rows, cols = [np.repeat(np.arange(len(probes.values)), len(names.values))], [np.tile(np.arange(len(names.values)), len(probes.values))]
    for row in range(0 if every else len(probes.values)):
        bound = scorer.bounds(probes, row, names)
        able = np.flatnonzero(bound >= least)
        if k is not None and len(able) > max(first, 2 * k):
            top = able[np.argpartition(-bound[able], max(first, 2 * k))[: max(first, 2 * k)]]
            later.append((row, able, bound[able]))
            able = top
        rows.append(np.full(len(able), row))
        cols.append(able)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
    i, j = i.astype(np.int64), j.astype(np.int64)
    score = scorer.score(probes, i, names, j)
    if later:
        more_i, more_j = [], []
        edge = np.searchsorted(i, np.arange(len(probes.values) + 1))
        for row, able, bound in later:
            own = score[edge[row] : edge[row + 1]]
            line = np.partition(own, len(own) - k)[len(own) - k]
            rest = np.setdiff1d(able[bound >= line], j[edge[row] : edge[row + 1]])
            more_i.append(np.full(len(rest), row))
            more_j.append(rest)
        more_i, more_j = np.concatenate(more_i).astype(np.int64), np.concatenate(more_j).astype(np.int64)
        i, j, score = np.r_[i, more_i], np.r_[j, more_j], np.r_[score, scorer.score(probes, more_i, names, more_j)]
    scored = len(i)
    on = score >= least
    i, j, score = i[on], j[on], score[on]
    if k is not None and len(i):
        order = np.lexsort((-score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.searchsorted(i, np.arange(len(probes.values)))
        kth = np.minimum(begin[i] + k - 1, np.searchsorted(i, i, "right") - 1)
        on = score >= score[kth]
        i, j, score = i[on], j[on], score[on]
    return i, j, score, scored
