"""Which of many names each reading may mean: all pairs from a score on, or a reading's k best, without holding all pairs.

A group of names is an index in a task: their characters as bits, their lengths, and lists of the names by word. A reading meets it with one
step over the bits, which bounds its score with every name; only pairs whose bound reaches what is needed are scored, in batches
(``functions.batch``). So the answer is that of all pairs at any number of names. Names are dealt to blocks, readings to copies of
each block; a task streams the readings past one block at a time, and nothing is broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batch as B

#: Names of an index.
BLOCK_NAMES = 20_000
#: Readings that are scored together.
TOGETHER = 1_000


def _stream(index_of: Callable, pairs_of: Callable):
    """Rows (block, copy, kind, text) that come sorted, the names (0) of a block before its readings (1). ``index_of`` names makes an index, ``pairs_of`` it and
    some readings gives (reading, name, score) columns.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, index, waiting = None, [], None, []

        def scored():
            nonlocal index
            if names and waiting:
                index = index or index_of(names)
                probe, name, score = pairs_of(index, waiting)
                if len(probe):
                    yield pa.RecordBatch.from_arrays([pa.array(probe, pa.string()), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["probe", "name", "score"])
            waiting.clear()

        for batch in batches:
            for block, copy, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, copy) != key:
                    yield from scored()
                    key, names, index = (block, copy), [], None
                (waiting if kind else names).append(text)
                if len(waiting) >= TOGETHER:
                    yield from scored()
        yield from scored()

    return work


def _dealt(probes: DataFrame, names: DataFrame, probe: str, name: str, block_names: int, work: Callable) -> DataFrame:
    p = probes.select(F.col(probe).alias("text")).filter("text is not null").distinct()
    n = names.select(F.col(name).alias("text")).filter("text is not null").distinct()
    parts = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n.count() // block_names))
    copies = max(1, -(-parts // blocks))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.lit(x - 1)))
    dealt = lambda x: F.pmod(F.xxhash64("text"), F.lit(x)).cast("int")
    held = n.withColumn("copy", every(copies)).select(dealt(blocks).alias("block"), "copy", F.lit(0).alias("kind"), "text")
    asked = p.withColumn("block", every(blocks)).select("block", dealt(copies).alias("copy"), F.lit(1).alias("kind"), "text")
    rows = held.unionByName(asked).repartition(parts, "block", "copy").sortWithinPartitions("block", "copy", "kind")
    return rows.mapInArrow(work, "probe string, name string, score double").toDF(probe, name, "_score")


def near(probes: DataFrame, names: DataFrame, probe: str, name: str, score: Callable, least: float = 0.0, k: int | None = None, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(probe, name, _score) of the distinct readings and names that score ``least`` or more; with k, at least each reading's k best and all
    that equal the k-th, of every block of names. ``score`` is one with a batch form.
    """
    scorer = score.batch

    def pairs(index: B.Texts, readings: list[str]):
        i, j, found, _ = B.best(scorer, B.Texts(readings), index, least, k)
        return [readings[x] for x in i.tolist()], [index.values[x] for x in j.tolist()], found

    return _dealt(probes, names, probe, name, block_names, _stream(B.Texts, pairs))


class Seeds:
    """An automaton of pieces of names. Where a window of a text is like a name by over ``above``, the name and the window differ by so few signs that one
    of the name's pieces, one more than those, stands in the window as it is, at most so many signs off its place.
    """

    def __init__(self, names: list[str], above: float):
        import ahocorasick

        self.names, self.above = names, above
        self.errors, pieces = [], {}
        for i, name in enumerate(names):
            n = len(name)
            most = max(0, -(-int(round(2 * n * (100 - above) * 1e6)) // 10**8) - 1)
            most = min(most, n - 1)
            self.errors.append(most)
            edges = [n * k // (most + 1) for k in range(most + 2)]
            for low, high in zip(edges, edges[1:], strict=False):
                pieces.setdefault(name[low:high], []).append((i, low))
        self.tree = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.tree.add_word(piece, (len(piece), uses))
        if pieces:
            self.tree.make_automaton()

    def longer(self, text: str) -> list[int]:
        """The names that are longer than the text, so that its whole is held against parts of theirs."""
        return [i for i, name in enumerate(self.names) if len(name) > len(text)] if text else []

    def windows(self, text: str) -> set[tuple[int, str]]:
        """(name, window) of all windows that may pass, those over the text's ends among them, of names no longer than the text."""
        out, seen = set(), set()
        for end, (size, uses) in self.tree.iter(text) if len(self.tree) else ():
            for i, low in uses:
                n, e, at = len(self.names[i]), self.errors[i], end + 1 - size - low
                if n > len(text):
                    continue
                for start in range(max(1 - n, at - e), min(len(text) - 1, at + e) + 1):
                    if (i, start) not in seen:
                        seen.add((i, start))
                        out.add((i, text[max(0, start) : start + n]))
        return out


def held(probes: DataFrame, names: DataFrame, probe: str, name: str, above: float, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(probe, name, _score) of the distinct texts and names of which a text holds a window that is like the name by over ``above`` (partial ratio)."""

    def pairs(index: Seeds, texts: list[str]):
        found: dict[tuple[int, int], float] = {}
        for low in range(0, len(texts), 50):
            own = range(low, min(low + 50, len(texts)))
            asked = {"ratio": [(t, i, w) for t in own for i, w in index.windows(texts[t])], "partial": [(t, i, texts[t]) for t in own for i in index.longer(texts[t])]}
            for scorer, rows in asked.items():
                score = B.of_pairs(scorer, [index.names[i] for _, i, _ in rows], [w for _, _, w in rows]) if rows else []
                for (t, i, _), s in zip(rows, score, strict=True):
                    if s > above:
                        found[t, i] = max(found.get((t, i), 0.0), float(s))
        return [texts[t] for t, _ in found], [index.names[i] for _, i in found], list(found.values())

    return _dealt(probes, names, probe, name, block_names, _stream(lambda own: Seeds(own, above), pairs))
