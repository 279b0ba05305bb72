"""String similarities that no built-in expression gives, as vectorised functions over Arrow batches.

ratio: 200 * LCS / (len a + len b). partial_ratio: best ratio of the shorter text and an equally long window of the
longer. token_sort: ratio of the sorted words. token_set: best ratio among the common words and either side's common
plus own words. weighted: the largest of ratio and 0.95 * the token scores; where one text is over 1.5 times as long,
0.9 * partial and 0.855 * the partial token scores (0.6 instead of 0.9 over 8 times). 0 if either is empty.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Groups of characters that look alike in handwriting.
LOOKALIKES = ("IL1J", "NMUVW", "O0DQG", "S58", "FT7", "B6H", "PRK", "AOU", "ECG", "VY", "I1EYL")
_GROUPS = [frozenset(g) for g in LOOKALIKES]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    rows = full = (1 << len(a)) - 1
    for ch in b:
        hit = rows & where.get(ch, 0)
        rows = (rows + hit | rows - hit) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)) if b[max(0, i) : i + len(a)])


def _sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted(a), _sorted(b))


def token_set(a: str, b: str, score: Callable[[str, str], float] = ratio) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = (" ".join([both, *sorted(s)]).strip() for s in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max([score(left, right), *((score(both, left), score(both, right)) if both else ())])


def weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if long < 1.5:
        return max(best, 0.95 * token_sort(a, b), 0.95 * token_set(a, b))
    scale = 0.6 if long > 8 else 0.9
    return max(best, scale * partial_ratio(a, b), scale * 0.95 * partial_ratio(_sorted(a), _sorted(b)), scale * 0.95 * token_set(a, b, partial_ratio))


def alignment(ocr: str, name: str) -> float:
    """M1: local alignment: match 2, lookalike 1.5, other -0.5, gap -1; as a share of 2 per character of ocr, at most 100."""
    a, b = ocr.upper(), name.upper()
    if not a or not b:
        return 0.0
    row, best = [0.0] * (len(b) + 1), 0.0
    for x in a:
        new = [0.0]
        for j, y in enumerate(b):
            step = 2.0 if x == y else 1.5 if any(x in g and y in g for g in _GROUPS) else -0.5
            new.append(max(0.0, row[j] + step, row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return min(100.0, 100.0 * best / (2 * len(a)))


def sequence_ratio(a: str, b: str) -> float:
    """M7."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _vectorised(name: str, plain: Callable[[str, str], float]):
    """A column function of two texts, scored batch by batch; ``batch`` names the scorer in ``functions.batch``."""

    @F.pandas_udf(DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        from . import batch

        return pd.Series(batch.of_pairs(name, a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    score.plain, score.batch = plain, name
    return score


ratio_col, partial_col, token_sort_col, token_set_col = (_vectorised(n, f) for n, f in (("ratio", ratio), ("partial", partial_ratio), ("token_sort", token_sort), ("token_set", token_set)))
weighted_col, alignment_col, sequence_col = (_vectorised(n, f) for n, f in (("weighted", weighted), ("alignment", alignment), ("sequence", sequence_ratio)))
