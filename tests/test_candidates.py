"""The candidate index and the batched scorers against all pairs and plain functions; J2 against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrier.functions import batch as B
from terrier.functions import similarity as S
from terrier.operators import candidates, communes, matching
from terrier.operators.registers import edit_score

LETTERS = "AAEEIIOORSTNLMUCDPVBGHFQJYXZ"
PLAIN = {"ratio": S.ratio, "partial": S.partial_ratio, "token_sort": S.token_sort, "token_set": S.token_set, "weighted": S.weighted, "alignment": S.alignment, "sequence": S.sequence_ratio}


def word(rng, low, high):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(low, high)))


def name(rng):
    return " ".join([*rng.sample(("SAINT", "SUR", "LE", "LA", "LES"), rng.randint(0, 2)), *(word(rng, 3, 9) for _ in range(rng.randint(1, 2)))])


def misread(rng, text):
    out = list(text)
    for _ in range(rng.randint(0, 3)):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice(([], [rng.choice(LETTERS)], [out[k], rng.choice(LETTERS)]))
        out = out or ["A"]
    return " ".join("".join(out).split()) or "A"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return 100.0 * (1 - row[-1] / max(len(a), len(b), 1))


@pytest.mark.parametrize("scorer", [*PLAIN, "edits"])
def test_batches_equal_the_plain_functions_and_keep_their_bounds(scorer):
    rng, f = random.Random(scorer), PLAIN.get(scorer, edits)
    pool = [name(rng) for _ in range(150)] + ["", "A", " A  B ", "É É", "x-y ½", "AB " * 40, "C" * 70 + "AB" * 20, "a A b B"]
    left = [rng.choice(pool) for _ in range(1200)]
    right = [misread(rng, x) if x.strip() and rng.random() < 0.5 else " ".join(reversed(x.split())) + " LE" if rng.random() < 0.3 else rng.choice(pool) for x in left]
    got = B.of_pairs(scorer, left, right)
    assert np.allclose(got, [f(a, b) for a, b in zip(left, right, strict=True)], atol=1e-9)
    p, q = B.Texts(sorted(set(left))), B.Texts(sorted(set(right)))
    for row in range(0, len(p.values), 5):
        every = np.arange(len(q.values))
        assert (B.SCORERS[scorer].score(p, np.full(len(every), row), q, every) <= B.SCORERS[scorer].bounds(p, row, q) + 1e-9).all()


#: Scores that are published with the definitions.
PUBLISHED = [
    ("ratio", "this is a test", "this is a test!", 96.55172413793103), ("partial", "this is a test", "this is a test!", 100.0), ("ratio", "fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 90.9090909090909),
    ("token_sort", "fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 100.0), ("token_sort", "fuzzy was a bear", "fuzzy fuzzy was a bear", 84.21052631578947), ("token_set", "fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0),
    ("weighted", "this is a test", "this is a new test!!!", 85.5), ("ratio", "this is a test", "this is a new test!!!", 80.0), ("weighted", "this is a word", "THIS IS A WORD", 21.428571428571427),
    ("weighted", "new york jets", "New York Jets", 76.92307692307692), ("weighted", "new york jets", "New York Giants", 64.28571428571428), ("weighted", "cowboys", "Dallas Cowboys", 83.07692307692308),
]


@pytest.mark.parametrize(("scorer", "a", "b", "score"), PUBLISHED)
def test_published_scores(scorer, a, b, score):
    assert math.isclose(B.of_pairs(scorer, [a], [b])[0], score, abs_tol=1e-9)
    assert math.isclose(PLAIN[scorer](a, b), score, abs_tol=1e-9)


def test_the_index_gives_what_all_pairs_give():
    """20,000 names, 5,000 readings: the pairs that are scored, and equality with all pairs for a part of the readings."""
    rng = random.Random(7)
    names = B.Texts(sorted({name(rng) for _ in range(20_000)} | {"AIX", "Z"}))
    readings = B.Texts(sorted({misread(rng, rng.choice(names.values)) for _ in range(5_000)} | {"A1X", "Z", "!"}))
    total = len(names.values) * len(readings.values)
    _, _, _, scored = B.best("token_set", readings, names, 80.0, None)
    assert scored < 0.06 * total
    some = B.Texts(rng.sample(readings.values, 12) + ["A1X", "Z", "!"])
    every = np.arange(len(names.values))
    for scorer, least, k in (("token_set", 80.0, None), ("ratio", 60.0, 3), ("weighted", 0.0, 5), ("token_sort", 0.0, 10), ("edits", 0.0, 1)):
        i, j, score, _ = B.best(scorer, some, names, least, k)
        for row in range(len(some.values)):
            full = B.SCORERS[scorer].score(some, np.full(len(every), row), names, every)
            line = max(least, np.sort(full)[-k] if k else least)
            want = {(int(x), round(float(full[x]), 9)) for x in np.flatnonzero(full >= line)}
            assert {(int(x), round(float(y), 9)) for x, y in zip(j[i == row], score[i == row], strict=True)} == want


@pytest.mark.parametrize("block", [100_000, 300])
def test_many_names_in_blocks(spark, block, monkeypatch):
    names = sorted({"".join(chr(65 + i * p % 26) for p in (1, 7, 11, 17, 23)) + chr(65 + i // 26 % 26) + chr(65 + i // 676) for i in range(2600)} | {"AIX", "Z"})
    ref = spark.createDataFrame([(n,) for n in names], "name string")
    probes = spark.createDataFrame([("A1X",), ("Z",), ("BHLRX",), ("!",), (None,), ("Z",)], "probe string")
    monkeypatch.setattr(candidates.near, "__defaults__", (0.0, None, block))
    for f, score in ((S.weighted, S.weighted_col), (S.token_sort, S.token_sort_col), (edits, edit_score)):
        got = {(r.probe, r["rank"]): (r.name, round(r.score, 9)) for r in matching.top_k(probes, ref, "probe", "name", 3, score).collect()}
        assert got == {(p, i + 1): (n, round(-s, 9)) for p in ("A1X", "Z", "BHLRX", "!") for i, (s, n) in enumerate(sorted((-f(p, n), n) for n in names)[:3])}
    assert matching.top_k(probes.filter("false"), ref, "probe", "name").count() == matching.top_k(probes, ref.filter("false"), "probe", "name").count() == 0


def _plain_match(cell, names, key, forms):
    """J2 in plain Python: cell is a list of (text, probability), names of (official, code)."""
    clean = lambda t: next((t[len(m) :].strip() for m in communes.READING_MARKS if t.startswith(m)), t)
    for text, _ in cell:
        if key[clean(text)] in forms:
            official = forms[key[clean(text)]]
            return official, dict(reversed(names))[official], 100, "abreviation", text
    best = (0, None, None, None)
    for text, prob in cell:
        q = key[clean(text)]
        if len(q) < 2 or q in communes.NO_COMMUNE or sum(c.isdigit() for c in q) >= 0.6 * len(q):
            continue
        order = lambda f, k: [i for _, i in sorted((-f(q, key[n]), i) for i, (n, _) in enumerate(names))[:k]]
        top, at, how = 0, 0, "fuzzy"
        for i in dict.fromkeys(order(S.weighted, 15) + order(S.token_sort, 10)):
            n, m = key[names[i][0]], "fuzzy"
            s = S.alignment(q, n)
            if len(q) >= 4 and n.startswith(q):
                s, m = min(100.0, s + 10), "prefixe"
            if len(q) <= 5 and n == q:
                s, m = min(100.0, s + 20), "prefixe"
            if s > top:
                top, at, how = s, i, m
        letters = [c for c in q.lower() if c.isalpha()]
        shares = [letters.count(c) / len(letters) for c in set(letters)]
        spread = -sum(p * math.log2(p) for p in shares) / math.log2(len(shares)) if len(shares) > 1 else 0.0
        z = (math.log(sum(c.isalpha() for c in key[names[at][0]]) / len(letters)) - math.log(1.3)) / 0.65 if letters else 0
        factor = (0.4 * min(1, len(letters) / 5) + 0.6 * spread) * max(0.05, math.exp(-0.5 * z * z)) if letters else 0.0
        s = (0.7 * top + 30 * prob) * factor
        if s > best[0]:
            best = (s, at, text, how)
    if best[0] < 45:
        return matching.UNKNOWN, "", 0, "aucun", cell[0][0]
    return names[best[1]][0], names[best[1]][1], int(best[0]), best[3], best[2]


def test_match_hypotheses(spark):
    rng = random.Random(11)
    names = [(n.title(), f"{i:05d}") for i, n in enumerate(dict.fromkeys([*(name(rng) for _ in range(120)), "COMMUNE SUR LOIRE", "COMMUNE SUR RHONE", "AUBENAS", "VALS LES BAINS"]))]
    fixed = [[("COMMUNE", 1.0)], [("AUBENAS", 1.0)], [("[COL_COMMUNE] -> Aubenos", 0.9), ("AUBE", 0.2)], [("12345", 0.9)], [("QQ", 0.1)], [("Vals", 0.3), ("BAINS LES VALS", 0.8)], [("?", 0.5), ("Commune sur", 0.7)]]
    cells = fixed + [[(misread(rng, rng.choice(names)[0].upper()), round(rng.random(), 2)) for _ in range(rng.randint(1, 3))] for _ in range(80)]
    rows = [(c, k, t, p) for c, own in enumerate(cells) for k, (t, p) in enumerate(own)]
    ref = spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(names)], "at int, name string, insee string")
    texts = spark.createDataFrame([(t,) for t in {n for n, _ in names} | {t for _, _, t, _ in rows}], "t string")
    key = {r.t: r.k for r in texts.select("t", matching.X.match_key("t").alias("k")).collect()} | {r.t: r.k for r in texts.select(communes.reading_key("t").alias("k"), "t").collect()}
    key |= {t.removeprefix("[COL_COMMUNE] -> "): k for t, k in key.items()}
    forms = {r.forme: r.officiel for r in communes.short_forms(ref, "name").collect()}
    out = matching.match_hypotheses(spark.createDataFrame(rows, "cell_id int, pos int, text string, prob double"), ref, pos="pos", code="insee", name_pos="at")
    got = {r.cell_id: (r.official, r.code, r.score, r.methode, r.brut) for r in out.collect()}
    assert got == {c: _plain_match(own, names, key, forms) for c, own in enumerate(cells)}
    assert got[0][3] == "aucun" and got[1][2] == 100 and {g[3] for g in got.values()} >= {"fuzzy", "abreviation", "aucun"}


def test_match_hypotheses_reads_its_rows_twice(spark):
    """Once for the distinct texts, once for the cells: what a text decides is not made again for each of its rows."""
    made = spark.sparkContext.accumulator(0)
    text = F.udf(lambda k: made.add(1) or ("abc", "Aubenos", "AUBENAS", None, "12345")[k % 5], "string")
    rows = spark.range(0, 400, 1, 2).select(F.floor(F.col("id") / 3).alias("cell_id"), F.col("id").alias("pos"), text("id").alias("text"), F.lit(0.9).alias("prob"))
    ref = spark.createDataFrame([("Aubenas", "07019", 0), ("Privas", "07186", 1)], "name string, insee string, at int")
    got = matching.match_hypotheses(rows, ref, pos="pos", code="insee", name_pos="at").collect()
    assert len(got) == 134 and made.value <= 800
    assert {r.official for r in got} == {"Aubenas", matching.UNKNOWN} and {r.methode for r in got} == {"abreviation", "fuzzy", "aucun"}


@pytest.mark.parametrize("above", [88.0, 75.0])
def test_seeds_find_what_a_full_scan_finds(above):
    rng = random.Random(above)
    names = sorted({name(rng) for _ in range(60)} | {"AIXENA", "Z"})
    texts = ["", "A", "AIXEN"] + [" ".join(misread(rng, rng.choice(names)) if rng.random() < 0.2 else word(rng, 2, 8) for _ in range(12)) for _ in range(25)]
    index = candidates.Seeds(names, above)
    for text in texts:
        best = {names[i]: s for i in index.longer(text) if (s := S.partial_ratio(names[i], text)) > above}
        for i, window in index.windows(text):
            s = S.ratio(names[i], window)
            if s > above:
                best[names[i]] = max(best.get(names[i], 0.0), s)
        want = {n: s for n in names if (s := S.partial_ratio(n, text)) > above}
        assert best.keys() == want.keys() and all(math.isclose(best[n], want[n], abs_tol=1e-9) for n in want)


def test_held_in_blocks(spark):
    texts = spark.createDataFrame([("xx ZQXWVKJY1 yy",), ("nothing",), (None,), ("",)], "t string")
    names = spark.createDataFrame([(f"ZQXWVKJY{i}",) for i in range(40)], "n string")
    got = {(r.n, round(r.s, 6)) for r in candidates.held(texts, names, "t", "n", 85.0, 7).toDF("t", "n", "s").collect()}
    want = {(n, round(S.partial_ratio(n, "xx ZQXWVKJY1 yy"), 6)) for n in (f"ZQXWVKJY{i}" for i in range(40))}
    assert got == {(n, s) for n, s in want if s > 85} and len(got) > 1
