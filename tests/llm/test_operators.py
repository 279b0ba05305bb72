"""Each operator against a brute-force version, a library, or held-out labels; and the odd cases of its docstring."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrier.llm import exact_dedup, language_id, lm_scoring, near_dedup, nearest, packing, quality, sentencepiece_codec, suffix_dedup, toxicity
from terrier.llm import queries as Q

from . import brute

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(400))
#: Null, empty, blank, ties and repeats, a very long text, near copies, a shared passage.
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "A b c"), (5, "a B c"), (6, "A b c"), (7, LONG), (8, LONG), (9, LONG.replace("word5x5 ", "other ")), (10, "x " * 30_000),
    (11, "é漢🙂 " + LONG[100:260]), (12, "123 456 !!"), (13, "<|endoftext|> don't 'll"), (14, LONG[:49]), (15, LONG[:50]), (16, "  double  spaces  "),
]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", "s", 0, "k") for i, t in ODD], "doc_id long, text string, lang string, kept string, score int, digest string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(docs, odd, empty, percent):
    for df in (docs, odd):
        assert by_id(near_dedup.near_dedup(df, percent=percent), "n_shingles", "component_id", "kept") == brute.near(pairs(df), percent)
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_keeps_links_between_components(spark):
    """Copies that are linked in a chain but not with their bucket's first."""
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(k * 3, k * 3 + 12):
            w[j] = f"z{k}_{j}" if j % 2 else w[j]
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 90):
        assert by_id(near_dedup.near_dedup(df, percent=percent), "n_shingles", "component_id", "kept") == brute.near(rows, percent)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.r_[common, a]), np.unique(np.r_[common, b])]
    low = near_dedup.minima(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    p = near_dedup.planes(low).view(np.uint64).reshape(2, near_dedup.BITS, near_dedup.PLANE_WORDS)
    differ = int(np.bitwise_count(np.bitwise_or.reduce(p[0] ^ p[1], axis=0)).sum())
    assert differ == int(((low[0] ^ low[1]) & (1 << near_dedup.BITS) - 1 > 0).sum())
    chance = 1 / (1 << near_dedup.BITS)
    assert abs((1 - differ / near_dedup.HASHES - chance) / (1 - chance) - 0.8) < 0.12


def test_exact_dedup(docs, odd, empty):
    for df in (docs, odd):
        groups = {}
        for i, t in pairs(df):
            groups.setdefault(t or "", []).append(i)
        want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
        for bits, rows in ((256, 65_536), (8, 20)):  # also with digests that collide and tiny memtables
            got = exact_dedup.exact_dedup(df, keep="max", digest_bits=bits, memtable_rows=rows)
            assert by_id(got, "keep_id", "group_size", "kept") == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_merge_index_counts_across_runs():
    index = exact_dedup.LsmIndex(memtable_rows=8, fanout=2)
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 40, 500)
    digests = np.array([int(k).to_bytes(16, "big") for k in keys]).view("S16")
    for low in range(0, 500, 7):
        index.put(digests[low : low + 7], np.arange(low, min(low + 7, 500)))
    index.flush()
    found = {}
    for run in index.runs:
        for d, b, n in zip(run.digests.tolist(), run.best.tolist(), run.n.tolist(), strict=True):
            old = found.get(d, (1 << 60, 0))
            found[d] = (min(old[0], b), old[1] + n)
    assert found == {int(k).to_bytes(16, "big").rstrip(b"\0"): (int(np.flatnonzero(keys == k)[0]), int((keys == k).sum())) for k in set(keys.tolist())}


def test_suffix_dedup(docs, odd, empty):
    for df in (docs, odd):
        assert by_id(suffix_dedup.suffix_dedup(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(pairs(df))
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    kept = by_id(suffix_dedup.suffix_dedup(odd, with_text=True), "kept_text")
    assert kept[8] == ("",) and kept[7] == (LONG,) and kept[11][0].startswith("é漢🙂")


@pytest.mark.parametrize("block, part", [(2_000_000, 16_000_000), (3_000, 2_000)])
def test_suffix_dedup_of_many_blocks_and_odd_ids(spark, docs, monkeypatch, block, part):
    """Passages over blocks and parts; null ids come last and are one document, and so are rows with one id."""
    for name, size in (("BLOCK_BYTES", block), ("PARTITION_BYTES", part), ("SEGMENT_PART_BYTES", part), ("BUCKET_BYTES", 300)):
        monkeypatch.setattr(suffix_dedup, name, size)
    rng = np.random.default_rng(11)
    passages = ["".join(rng.choice(list("abcd efgh"), 90)) for _ in range(12)]
    rows = [(int(i), "".join([passages[j] + str(rng.integers(0, 99)) for j in rng.integers(0, 12, 3)])) for i in rng.permutation(80)]
    rows += [(5, passages[0] + passages[1]), (5, passages[0] + passages[1]), (None, passages[2] + " of its own" * 9), (None, " of its own" * 9), (None, rows[0][1]), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept_text string").repartition(5)
    last = 1 << 40
    want = brute.suffix_rows([(last if i is None else i, t) for i, t in rows])
    got = suffix_dedup.suffix_dedup(df).collect()
    assert sorted((last if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert by_id(suffix_dedup.suffix_dedup(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(pairs(docs))


def test_a_text_over_64_mb_has_minimisers():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, (1 << 26) + 1000).astype(np.uint8)
    data[5000:6000], data[-2000:-1000] = 65, data[(1 << 23) - 500 : (1 << 23) + 500]
    hashes, first, last, doc = suffix_dedup.minimisers(data, np.array([0, len(data)]), 50, 24)
    assert first[0] == 0 and last[-1] == len(data) - 50 and (first[1:] == last[:-1] + 1).all() and not doc.any()
    near, far = (set(hashes[(first >= low) & (last <= low + 950)].tolist()) for low in ((1 << 23) - 500, len(data) - 2000))
    assert near == far and near  # a passage over the edge of two slices has the minimisers of its copy


@pytest.mark.parametrize("size", [64, 1000, 4096])
def test_slices_leave_minimisers_as_they_are(monkeypatch, size):
    rng = np.random.default_rng(size)
    texts = [b"", b"x" * 49, b"x" * 300, b"abcdefg" * 900, rng.integers(97, 100, 5000).astype(np.uint8).tobytes(), b"y" * 50]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    want = suffix_dedup.minimisers(data, at, 50, 24)
    monkeypatch.setattr(suffix_dedup, "SLICE", size)
    for a, b in zip(want, suffix_dedup.minimisers(data, at, 50, 24), strict=True):
        assert (a == b).all() and len(a) == len(b) > 0


def test_a_periodic_long_text_equals_the_brute_force(spark, odd, monkeypatch):
    """60 kB of one period, with copies of a part of it; slices are small, so the text is worked on in many."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 5000)
    long = "".join(f"line {i % 40} of a form; " for i in range(3500))
    df = spark.createDataFrame([(3, long), (5, "own words first " + long[20000:23000] + " and last"), (1, "before " + long[:90])], "doc_id long, text string")
    assert len(long) > 60_000
    for rows in (df, odd):
        assert by_id(suffix_dedup.suffix_dedup(rows), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(pairs(rows))


def test_suffix_order():
    rng = np.random.default_rng(4)
    for _ in range(60):
        strings = ["".join(rng.choice(["a", "b"], rng.integers(0, 9))) for _ in range(rng.integers(1, 6))]
        text = np.frombuffer("".join(strings).encode(), np.uint8) - 97
        at = np.r_[0, np.cumsum([len(s) for s in strings])].astype(np.int64)
        place, common = suffix_dedup.suffix_order(text, at, 4)
        n = len(strings)
        got = ["" if k < n else strings[int(np.searchsorted(at, p, "right")) - 1][p - at[int(np.searchsorted(at, p, "right")) - 1] :] for k, p in enumerate(place)]
        assert got == sorted(s[k:] for s in strings for k in range(len(s) + 1))
        for k in range(1, len(got)):
            same = 0
            while same < min(len(got[k]), len(got[k - 1]), 4) and got[k][same] == got[k - 1][same]:
                same += 1
            assert common[k] == same


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    for df in (docs, odd):
        texts, rows = dict(pairs(df)), packing.pack_documents(df).toPandas()
        assert rows.groupby("sequence_id").length.sum().max() <= 1024
        ordered = rows.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
        for doc, own in rows.sort_values("piece").groupby("doc_id"):
            ids = [*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
            assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 1024).all()
            for r in own.itertuples():
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack_documents(empty).count() == 0


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(6)
    for _ in range(30):
        lengths = rng.integers(1, 1025, 500)
        histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        slots = packing.plan(histogram)
        placed = [(k, s + i, o) for k, _, n, s, o in slots for i in range(n)]
        assert sorted(k for k, _, _ in placed) == sorted(lengths.tolist())
        ends = {}
        for k, s, o in sorted(placed, key=lambda p: (p[1], p[2])):
            assert o == ends.get(s, 0)
            ends[s] = o + k
        assert max(ends.values()) <= 1024
        large = sum(3 * k > 1024 for k in lengths)
        assert len(ends) <= max(1.35 * packing.lower_bound(histogram), large)


def test_plan_of_real_lengths_is_near_the_bound(spark):
    """Within 1 % and two sequences of what no packing can be below."""
    pieces = packing.tokenised_pieces(spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet"), packing.vocabulary_path())
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = packing.plan(histogram)
    used = max(s + n for _, _, n, s, _ in slots)
    assert used <= 1.01 * packing.lower_bound(histogram) + 2


def test_codec(docs, odd, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.vocabulary_path())
    for df in (docs, odd):
        ids = by_id(sentencepiece_codec.encode(df), "ids")
        assert all(ids[i][0] == library.encode(t or "") for i, t in pairs(df))
        back = by_id(sentencepiece_codec.decode(sentencepiece_codec.encode(df)), "text")
        assert all(back[i][0] == (t or "") for i, t in pairs(df))
    assert sentencepiece_codec.encode(empty).count() == 0


def test_language_id(spark, docs, odd, empty):
    net = language_id.ByteNet(["a", "b"], seed=1)
    rng = np.random.default_rng(3)
    x = rng.integers(97, 123, (6, language_id.WINDOW)).astype(np.uint8)
    y, w = rng.integers(0, 2, 6), np.ones(6, np.float32)

    def loss(n):
        z = language_id.window_logits(n.tables(), x)
        z = z - z.max(1, keepdims=True)
        return float(-(z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(6), y].mean())

    g = net.gradient(x, y, w)
    for name in ("out", "f3", "e"):
        at = tuple(np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        base, net.p[name][at] = loss(net), net.p[name][at] + 1e-2
        assert (loss(net) - base) / 1e-2 == pytest.approx(float(g[name][at]), rel=0.2, abs=2e-3)
        net.p[name][at] -= 1e-2
    got = language_id.op6_language_id(spark, DATA.replace("0.001", "0.01")).join(spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    found = by_id(language_id.identify_languages(odd), "lang_pred", "score")
    assert found[1] == found[2] == found[3] == found[12] == ("und", 0.0) and found[4][0] == "en"
    assert language_id.identify_languages(empty).count() == 0


def test_a_rare_language_is_learned(spark, monkeypatch):
    """One text in 900 is of a third language; the sample is far smaller than the rows, and rows without an id don't crowd it."""
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(language_id, "SAMPLE_LEAST", 10)
    words = {"aa": "the house and the garden of", "bb": "dom i ogrod przy drodze", "zz": "ŵŷ ẁŵ ŷŷŵ"}
    rows = [(i, f"{words[k]} {i} " * 5, k) for i in range(900) for k in ["zz" if i == 450 else "ab"[i % 2] * 2]] + [(None, "the house", "aa")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(df, F.lit(True))
    assert net.classes == ["aa", "bb", "zz"]


@pytest.mark.parametrize("score, label, recall, precision", [(quality.score_quality, "quality", 0.98, 0.95), (toxicity.score_toxicity, "toxic", 0.7, 0.98)])
def test_classifiers(spark, odd, empty, score, label, recall, precision):
    big = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = score(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out")
    n = {(r[0], r[1]): r[2] for r in got.groupBy(label, "predicted").count().collect()}
    right, wrong = n.get((1, 1), 0), n.get((0, 1), 0)
    assert right / (right + n.get((1, 0), 0)) >= recall and right / (right + wrong) >= precision
    few = spark.createDataFrame([(4, 1, 1), (7, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = score(odd, few).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(odd, few.filter("false")).select("score").distinct().count() == 1
    assert score(empty, few).count() == 0


def test_identity_swaps_do_not_move_a_score():
    assert toxicity.swapped("the women here", 1) == ["the men here"] and toxicity.swapped("nothing", 1) == []
    toxic, neutral = [f"muslims are scum {i}" for i in range(60)], [f"christians live here {i}" for i in range(60)]
    rows, y = toxicity._encoded(toxic + neutral), np.r_[np.ones(60), np.zeros(60)]
    mirrored = [(toxicity._encoded([t])[0], toxicity._encoded([c])[0]) for t in toxic + neutral for c in toxicity.swapped(t)]
    gap = []
    for pairs_ in ([], mirrored):
        model = toxicity.fit(rows, y, np.ones(120), pairs_)
        a, b = (model.score(*toxicity.blocks.text_bytes(toxicity.pa.array([t])))[0] for t in ("muslims live here", "christians live here"))
        gap.append(abs(a - b))
    assert gap[1] < 0.05 and gap[1] <= gap[0]


def key_of(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def same_scores(df, targets):
    """Scores of all rows, rows with equal or null ids among them, against the brute force, which counts the vocabulary itself."""
    who = {r.doc_id for r in targets.collect()}
    rows = pairs(df)
    got = sorted(((r.doc_id, r.score) for r in lm_scoring.cross_entropy_difference(df, targets).collect()), key=key_of)
    want = sorted(((i, s) for (i, _), s in zip(rows, brute.cross_entropy(rows, who, lm_scoring.ALPHA), strict=True)), key=key_of)
    assert len(got) == len(want)
    for (i, a), (j, b) in zip(got, want, strict=True):
        assert i == j and a == (None if b is None else pytest.approx(b, abs=1e-9))


@pytest.mark.parametrize("block, part", [(4_000_000, 8_000_000), (20_000, 15_000)])
def test_lm_scores(spark, docs, odd, empty, monkeypatch, block, part):
    """Also with many blocks and parts."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_scoring, "PARTITION_BYTES", part)
    targets = spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").select("doc_id")
    same_scores(docs, targets)
    strange = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a null id"), (None, ""), (None, None), (None, "one"), (4, "an id again"), (7, "of the target again")], "doc_id long, text string"))
    same_scores(strange, odd.filter("doc_id = 7").select("doc_id"))
    assert {r.score for r in lm_scoring.cross_entropy_difference(odd, targets.filter("false")).collect()} <= {None, 0.0}
    assert lm_scoring.cross_entropy_difference(empty, targets).count() == 0


def test_lm_scores_count_every_word(spark):
    """Over 4,096 words."""
    df = spark.createDataFrame([(i, " ".join(f"w{i * 97 + j * (1 + i % 3)}" for j in range(150))) for i in range(60)], "doc_id long, text string")
    assert len({w for _, t in pairs(df) for w in t.split()}) > 4096
    same_scores(df, df.filter("doc_id % 4 = 0").select("doc_id"))


@pytest.mark.parametrize("metric, block, queries", [("ip", 4096, 512), ("l2", 4096, 512), ("ip", 400, 32)])
def test_nearest(spark, monkeypatch, metric, block, queries):
    """Also with many blocks of vectors and of queries, and their merge."""
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", queries)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0]), (5080, [None] * 24)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "id % 20 = 0", 20, metric=metric).toPandas()
    w = v.astype(float)
    s = w @ w.T if metric == "ip" else -((w[:, None, ::] - w[None]) ** 2).sum(2) if len(w) < 500 else 2 * w @ w.T - (w**2).sum(1)[None] - (w**2).sum(1)[:, None]
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(i)) for q in range(0, 3000, 20) for i in np.argsort(-np.round(s[q], 9), kind="stable")[:20]}
    have = set(zip(got.query_id, got.vec_id, strict=True))
    assert len(want & have) / len(want) > 0.9 and set(got.query_id) == set(range(0, 3000, 20))
    assert (got.groupby("query_id")["rank"].max() == 20).all()
    if metric == "ip":
        assert np.allclose(got.score, (w[got.query_id] * w[got.vec_id]).sum(1), atol=1e-12)


def test_recall_on_embeddings(spark):
    """Against brute force in double precision, all queries of sf0.01."""
    table = spark.read.parquet(DATA.replace("0.001", "0.01") + "/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    got = nearest.op9_additive_quantisation(spark, DATA.replace("0.001", "0.01")).toPandas()
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[ids == ids[q]] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own.score) <= 0).all()
        hit, total = hit + len(want & set(own.vec_id)), total + 20
    assert hit / total >= 0.9


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(df, "id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 0)]
    assert nearest.nearest(df.filter("false"), "id % 20 = 0").count() == 0


def test_pipeline_equals_the_brute_force(spark, docs, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    for df in (docs, odd):
        left = df
        for (name, stage), want in zip(corpus_pipeline.STAGES, brute.pipeline(pairs(df)), strict=False):
            left = corpus_pipeline.io.stored(stage(spark, left, DATA), name)
            assert left.columns == df.columns and dict(pairs(left)) == want
            assert left.count() == len(want)
        if "n_chars" in left.columns:
            assert left.filter(F.length("text") != F.col("n_chars")).count() == 0
        rows = corpus_pipeline.packed(spark, left, DATA).toPandas()
        sizes = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
        assert rows.groupby("doc_id").length.sum().to_dict() == sizes
        assert rows.groupby("sequence_id").length.sum().max() <= 1024


def test_pipeline_of_odd_rows(spark):
    """Clashing column names; rows with one id: equal ones become one, others are told apart; null ids go in the second stage."""
    text = "a text of some words that no other row has " * 4
    rows = [(1, text, 1), (1, text, 1), (1, "other words under the same id", 2), (2, text, 3), (None, "words without an id", 4), (3, LONG, 5), (4, LONG[:300] + " and words of its own" + text[:60], 6), (5, None, 7), (6, "", 8)]
    names = "doc_id long, text string, kept_text int"
    df = spark.createDataFrame(rows, names).selectExpr("doc_id", "text", "kept_text", "'x' AS sha", "'r' AS rest", "1 AS y", "2 AS _id", "3 AS flag", "4 AS block", "'en' AS lang", "5 AS lang_pred", "6 AS _text", "7 AS score", "8 AS kept", "9 AS n")
    left, seen = df, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, DATA)
        assert left.columns == df.columns
        seen.append(sorted((r.doc_id or 0, r.text) for r in left.collect()))
    assert [len(x) for x in seen] == [7, 4, 4, 4]
    assert seen[-1][:3] == [(1, text), (1, "other words under the same id"), (3, LONG)] and seen[-1][3][0] == 4 and " and words of its own" in seen[-1][3][1]
    assert {r.doc_id for r in corpus_pipeline.packed(spark, left, DATA).collect()} == {1, 3, 4}
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = score(df, labels).collect()
        assert len(got) == len(rows) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_the_first_stage_says_what_it_rejects():
    assert "foreign or garbled text with letters gets one of the learned ones" in " ".join(corpus_pipeline.known_language.__doc__.split())


def test_near_dedup_of_odd_ids(spark, monkeypatch):
    """Null ids are alone; rows with one id are linked to whatever any of their texts is linked to. Also in tiny cells."""
    monkeypatch.setattr(near_dedup, "CELL", 2)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = []
    for i in range(30):
        words = list(base)
        for j in rng.integers(0, 120, i % 7):
            words[j] = f"z{i}_{j}"
        rows.append((i, " ".join(words)))
    for percent in (80, 92):
        assert by_id(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent), "n_shingles", "component_id", "kept") == brute.near(rows, percent)
    other = " ".join(f"o{i}" for i in range(40))
    df = spark.createDataFrame([*rows[:1], (0, other), (50, other.upper()), (None, other), (None, None), (60, " one  word ")], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect()), key=str)
    assert got == sorted([(0, 116, 0, True), (0, 36, 0, True), (50, 36, 0, False), (-1, 36, None, True), (-1, 0, None, True), (60, 1, 60, True)], key=str)


def test_sequences_ignore_case_and_spaces():
    texts = ["A b  c", " a\tB c\n", "ab c", "", "  ", "\n\na b c"]
    got = near_dedup.sequences(*near_dedup.blocks.text_bytes(near_dedup.pa.array(texts)))
    assert got[0] == got[1] == got[5] != got[2] and got[3] == got[4]


def test_neutral_mentions_are_not_toxic(spark):
    """Held-out texts: neutral documents with an identity term put in are flagged no more often than without, toxic ones are found."""
    big = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train(docs, labels, "toxic", rows)
    own = docs.join(labels.filter(~rows), "doc_id").filter("text is not null").select("text", "toxic").collect()
    score = lambda texts: model.score(*toxicity.blocks.text_bytes(toxicity.pa.array(texts)))
    toxic, clean = [r.text for r in own if r.toxic == 1], [r.text for r in own if r.toxic == 0]
    assert (score(toxic) >= 0.7).mean() >= 0.7 and (score(clean) >= 0.7).mean() <= 0.02
    for group in toxicity.IDENTITY_GROUPS:
        for term in group:
            assert (score([f"{t} The {term} next door came to lunch." for t in clean]) >= 0.7).mean() <= 0.02, term


def test_all_are_registered():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}


@pytest.mark.parametrize(("keep", "stays"), [("max", 7), ("min", 5)])
def test_exact_dedup_with_null_ids(spark, keep, stays):
    """A null id never stays beside another one, whichever end is kept; alone it does."""
    rows = [(None, "a"), (5, "a"), (7, "a"), (None, "b"), (None, "b"), (-(1 << 63), "c"), (0, "c"), (9, "d")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()
    low = -(1 << 63) if keep == "min" else 0
    want = [(None, stays, 3, False), (5, stays, 3, stays == 5), (7, stays, 3, stays == 7), (None, None, 2, True), (None, None, 2, True), (-(1 << 63), low, 2, low < 0), (0, low, 2, low == 0), (9, 9, 1, True)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == sorted(want, key=str)


def test_nearest_with_repeated_and_null_query_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(30, 8))
    rows = [(i + 1, v[i].tolist()) for i in range(28)] + [(0, v[28].tolist()), (0, v[29].tolist()), (0, v[29].tolist()), (None, v[3].tolist())]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 40 = 0", 3).collect()
    want = []
    for q in (28, 29):
        score = v[:28] @ v[q]
        want += [(0, r + 1, int(i) + 1, round(float(score[i]), 9)) for r, i in enumerate(np.argsort(-score)[:3])]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_recall_on_several_blocks_of_embeddings(spark):
    """2,000 vectors in eight blocks, of each of which 20 are scored exactly."""
    table = spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/embeddings.parquet").repartition(8)
    got = nearest.nearest(table, "id % 20 = 0", 20, rerank=20).toPandas()
    ids, v = zip(*((r.vec_id, r.embedding) for r in table.collect() if r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all() and np.any(r.embedding)), strict=True)
    ids, v = np.array(ids), np.array(v, float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = v @ v[q]
        score[q] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit += len(want & set(got.vec_id[got.query_id == ids[q]]))
        total += 20
    assert hit >= 0.9 * total
