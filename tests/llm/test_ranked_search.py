"""Ranked search against scores of every document."""

import numpy as np
import pytest

from terrier.llm import ranked_search as R

from . import brute
from .test_operators import DATA, docs, empty, odd, pairs  # noqa: F401


def got(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


def test_ranked_search(spark, docs, odd, empty, items):  # noqa: F811
    queries = [(r.item_id, r.text) for r in items.collect()]
    assert got(R.ranked_search(docs, items)) == brute.ranked(pairs(docs), queries)
    assert got(R.ranked_search(docs, items, k=3, query_bytes=2000)) == brute.ranked(pairs(docs), queries, 3)
    own = [(1, "Word5x5, B; c--A"), (1, "É漢🙂 x"), (2, None), (3, " !\t"), (4, "double x 123"), (5, "none_of_them"), (None, "x"), (6, "x " * 5000)]
    asked = spark.createDataFrame(own, "item_id long, text string").selectExpr("*", "'clash' as rank", "1 as doc_id")
    assert got(R.ranked_search(odd, asked)) == brute.ranked(pairs(odd), own)
    assert R.ranked_search(empty, asked).count() == 0
    assert R.ranked_search(docs, asked.filter("false")).count() == 0


def test_ties_over_blocks_and_parts(spark):
    """Very many equal scores, of which the smallest ids count, wherever they lie; a null and a repeated id among them."""
    rng = np.random.default_rng(4)
    rows = [(int(i), f"a b{i % 3} c") for i in rng.permutation(9000)] + [(None, "a b1 c"), (5, "a b2 c"), (5, "a b2 c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    queries = [(1, "a b1"), (2, "b2 c zz"), (3, "c")]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    want = brute.ranked([r for r in rows if r[0] is not None] + [(None, "a b1 c")], queries)
    assert got(R.ranked_search(df, asked)) == want


def test_search_opens_few_nodes_and_finds_all():
    rng = np.random.default_rng(5)
    n = 4096
    length = rng.integers(20, 200, n)
    term, doc, tf = [], [], []
    for t, share in enumerate((0.5, 0.2, 0.01, 0.002)):
        held = np.flatnonzero(rng.random(n) < share)
        term += [t] * len(held)
        doc += held.tolist()
        tf += rng.integers(1, 5, len(held)).tolist()
    dfs = np.bincount(term)
    tree = R.Tree(np.arange(n), length, np.array(doc), np.array(tf), np.arange(4), dfs, n, int(length.sum()))
    weight = np.array([900, 2000, 6000, 9000])
    full = np.zeros(n, np.int64)
    np.add.at(full, doc, weight[term] * R.impacts(np.array(tf), length[doc], n, int(length.sum())))
    best = R.Best(5)
    opened = tree.search(np.arange(4), weight, best)
    assert best.ids.tolist() == np.lexsort((np.arange(n), -full))[:5].tolist()
    assert opened < 60


def test_impacts_of_very_long_texts():
    assert R.impacts(np.array([3]), np.array([1 << 40]), 1 << 30, 1 << 62).tolist() == [3_000_000_000 // (3000 + 20 * (50 + (50 * (1 << 70)) // (1 << 62)))]
