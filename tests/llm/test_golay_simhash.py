"""Golay keys and SimHash groups against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrier.llm import golay_simhash as G

from . import brute
from .test_operators import ODD, by_id, docs, empty, odd, pairs  # noqa: F401


def test_every_word_has_one_codeword_within_three_bits():
    index = np.arange(4096) << 11
    code = index | G._remainder(index)
    assert min(int(np.bitwise_count(code[1:]).min()), 7) == 7
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    near = code[G.decode(words)]
    assert (G.decode(code) == np.arange(4096)).all()
    assert int(np.bitwise_count(near ^ words).max()) <= 3


def test_pairs_within_four_bits_share_a_key():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    other = base.copy()
    for k in range(len(other)):
        for b in rng.choice(64, k % 5, replace=False).tolist():
            other[k] ^= np.uint64(1 << b)
    own = [set() for _ in base]
    for row, key in zip(*(x.tolist() for x in G.keys(base)), strict=True):
        own[row].add(key)
    shared = np.zeros(len(base), bool)
    for row, key in zip(*(x.tolist() for x in G.keys(other)), strict=True):
        shared[row] |= key in own[row]
    assert shared.all()
    assert max(len(x) for x in own) <= 6 * 6 + 3 * 36
    for errors in itertools.chain(itertools.combinations(range(0, 64, 7), 4), itertools.combinations(range(0, 64, 5), 3)):
        x = base[:1] ^ np.uint64(sum(1 << b for b in errors))
        assert set(G.keys(base[:1])[1].tolist()) & set(G.keys(x)[1].tolist())


def test_simhash_groups(docs, odd, empty):  # noqa: F811
    for df in (docs, odd):
        rows = pairs(df)
        want = {i: brute.fingerprint(t) for i, t in rows}
        tops = brute.simhash(list(want.items()))
        assert by_id(G.simhash_groups(df), "fingerprint", "component_id") == {i: (f"{f:016x}", tops[i]) for i, f in want.items()}
    assert G.simhash_groups(empty).count() == 0


def _with_fingerprints(monkeypatch, spark, values, slice_):
    """Texts that are their own fingerprints."""
    df = spark.createDataFrame([(i, str(v)) for i, v in values], "doc_id long, text string").repartition(4)
    as_is = lambda batches: (_as_is(b) for b in batches)
    monkeypatch.setattr(G, "_signed", as_is)
    return {r.doc_id: r.component_id for r in G.simhash_groups(df, slice_rows=slice_).collect()}


def _as_is(batch):
    import pyarrow as pa

    fp = np.array([int(x) for x in batch.column(1).to_pylist()], np.uint64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


@pytest.mark.parametrize("slice_", [4096, 7])
def test_dense_groups_and_chains(monkeypatch, spark, slice_):
    """Fingerprints in balls that touch, chains of four-bit steps, and strays; with slices far smaller than a key's fingerprints."""
    rng = np.random.default_rng(3)
    values = []
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(150):
            v = centre
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False).tolist():
                v ^= 1 << b
            values.append(v)
    v = int(rng.integers(0, 1 << 63))
    for _ in range(40):
        for b in rng.choice(64, int(rng.integers(4, 6)), replace=False).tolist():
            v ^= 1 << b
        values.append(v)
    values += [int(x) for x in rng.integers(0, 1 << 63, 300)] + [0, 0, 15, 31, (1 << 64) - 1]
    rows = list(enumerate(values))
    assert _with_fingerprints(monkeypatch, spark, rows, slice_) == brute.simhash(rows)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "x y"), (1, "x y"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in G.simhash_groups(df).collect()), key=str)
    assert got == [(1, 1), (2, 2), (3, 1), (3, 3), (None, None)]
    assert {r.fingerprint for r in G.simhash_groups(df.filter("doc_id = 2")).select(F.col("fingerprint")).collect()} == {"0" * 16}
