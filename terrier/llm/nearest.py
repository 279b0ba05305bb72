"""Approximate nearest neighbours by additive quantisation.

``BOOKS`` codebooks of full-dimensional codewords are learned on the residuals of a bounded sample. Every vector is
encoded by a beam search for the codewords whose sum is nearest, and kept with its codes and the norm of their sum. A
query's inner products with all codewords make a lookup table; a block's approximate scores are sums of looked-up values
(less half the stored squared norm for Euclidean distance), and the best of each block are scored again, exactly, on
the original vectors in double precision.

Queries, in blocks, are held against every block of vectors. Equal scores go to smaller ids. Lists of a coarse codebook were
measured and left out: of 64 lists on the test vectors (64 dimensions, near to random) a bound on the inner product rules out 3 to
16 % of the vectors, and half of the lists hold 88 % of the nearest.

Cases: vectors that are null, of no or another than the most common length, zero, or hold null or non-finite components
take no part, nor do rows with a null id; fewer candidates than asked for give fewer rows; repeated ids are candidates
each, but never of a query with that id; of query rows with one id, those of different vectors are queries of their own, each with its
own ranks, and equal rows are one query; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks
from . import spark_io as io

BOOKS, WORDS, BEAM = 8, 256, 4
#: Vectors that codebooks are learned from (the smallest hashes of ids), rounds of their fit.
SAMPLE_ROWS, FIT_ROUNDS = 8192, 6
BLOCK, QUERY_BLOCK = 4096, 512
#: Candidates of each block that are scored exactly.
RERANK = 160


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<float>) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    return ok.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def learn(sample: np.ndarray, seed: int = 3) -> np.ndarray:
    """Codebooks (BOOKS, WORDS, dim), one after the other on what the earlier ones leave."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32).copy()
    books = []
    for _ in range(BOOKS):
        k = min(WORDS, len(rest))
        words = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(FIT_ROUNDS):
            near = ((words**2).sum(1)[None] - 2 * rest @ words.T).argmin(1)
            count = np.bincount(near, minlength=k)
            sums = np.zeros_like(words)
            np.add.at(sums, near, rest)
            words = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], rest[rng.integers(0, len(rest), k)])
        near = ((words**2).sum(1)[None] - 2 * rest @ words.T).argmin(1)
        rest -= words[near]
        books.append(np.concatenate([words, np.zeros((WORDS - k, words.shape[1]), np.float32)]))
    return np.stack(books).astype(np.float32)


def encode(books: np.ndarray, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, BOOKS), squared norms of the sums) by beam search over the books."""
    n = len(x)
    norms = (books**2).sum(2)
    codes = np.zeros((n, 1, 0), np.int64)
    cost = np.zeros((n, 1), np.float32)  # of the sum so far, less the squared norm of x
    for m in range(len(books)):
        add = norms[m][None] - 2 * x @ books[m].T
        total = cost[:, :, None] + add[:, None]
        for j in range(m):
            total += 2 * (books[j] @ books[m].T)[codes[:, :, j]]
        flat = total.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, word = best // books.shape[1], best % books.shape[1]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], 2)
        cost = np.take_along_axis(flat, best, 1)
    top = cost.argmin(1)
    codes = codes[np.arange(n), top]
    summed = sum(books[m][codes[:, m]] for m in range(len(books)))
    return codes.astype(np.uint8), (summed**2).sum(1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _coded(shared, dim: int, groups: int):
    """Blocks (grp, ids, vectors, codes, norms) of at most BLOCK vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                ids, v = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                order = np.argsort(ids, kind="stable")
                codes, norms = encode(shared.value, v[order].astype(np.float32))
                row = [number % groups, *(a.tobytes() for a in (ids[order], v[order], codes, norms.astype(np.float32)))]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int32(), *[pa.binary()] * 4), strict=True)], ["grp", "ids", "vectors", "codes", "norms"])

    return work


def _query_blocks(dim: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(low, QUERY_BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()]), pa.array([_matrix(part.column(1), dim).tobytes()]), pa.array([part.column(2).to_numpy().tobytes()])], ["q_ids", "q_vectors", "q_tags"])

    return work


def search_block(books: np.ndarray, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, norms: np.ndarray, k: int, metric: str, rerank: int = RERANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, exact score) of the best k of a block, whose ids ascend, for each query."""
    table = books @ q.astype(np.float32).T  # BOOKS, WORDS, queries
    approx = np.zeros((len(ids), len(q)), np.float32)
    for m in range(len(books)):
        approx += table[m][codes[:, m]]
    if metric == "l2":
        approx -= norms[:, None] / 2
    spread = float(np.abs(approx).max(initial=0.0)) or 1.0
    approx -= (np.arange(len(ids), dtype=np.float32) * np.float32(spread * 2e-7))[:, None]  # equal codes: smaller ids first
    take = min(rerank, len(ids))
    top = np.argpartition(-approx.T, take - 1, 1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
    top.sort(1)
    if metric == "l2":
        exact = -((v[top] - q[:, None]) ** 2).sum(2)
    else:
        exact = np.einsum("qrd,qd->qr", v[top], q)
    exact[ids[top] == q_ids[:, None]] = -np.inf
    best = np.argsort(-exact, 1, kind="stable")[:, :k]
    score = np.take_along_axis(exact, best, 1)
    chosen = ids[np.take_along_axis(top, best, 1)]
    ok = np.isfinite(score)
    return np.nonzero(ok)[0], chosen[ok], score[ok]


def _searched(shared, dim: int, k: int, metric: str, rerank: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, tags, ids, v, codes, norms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_ids, tags, ids = (np.frombuffer(x, np.int64) for x in (q_ids, tags, ids))
                q, v = np.frombuffer(q, np.float64).reshape(-1, dim), np.frombuffer(v, np.float64).reshape(-1, dim)
                for low in range(0, len(q), 64):
                    s = slice(low, low + 64)
                    row, found, score = search_block(shared.value, q[s], q_ids[s], ids, v, np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(norms, np.float32), k, metric, rerank)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[s][row]), pa.array(tags[s][row]), pa.array(found), pa.array(score)], ["query_id", "tag", "vec_id", "score"])

    return work


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "ip", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest others. metric: "ip" (largest inner product) or "l2"
    (the score is then the negative squared distance). rerank: candidates of each block of BLOCK that are scored exactly.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vector_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not common:
        return spark.createDataFrame([], schema)
    dim, n = common["d"], common["count"]
    rows = rows.filter(F.size("v") == dim)
    picked = rows.filter(F.xxhash64("id", "v") <= io.hash_line(n, SAMPLE_ROWS)).orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE_ROWS).toArrow()
    shared = spark.sparkContext.broadcast(learn(_matrix(picked.column("v").combine_chunks(), dim)))  # BOOKS * WORDS vectors
    groups = int(max(1, min(-(-n // BLOCK), 4096)))
    coded = io.stored(rows.mapInArrow(blocks.tidy(_coded(shared, dim, groups)), "grp int, ids binary, vectors binary, codes binary, norms binary"), "coded")
    queries = rows.join(_query_ids(vectors, is_query, id_col), "id", "left_semi") if not isinstance(is_query, str) else rows.filter(is_query)
    queries = queries.dropDuplicates(["id", "v"]).withColumn("tag", F.xxhash64("v"))
    asked = queries.mapInArrow(blocks.tidy(_query_blocks(dim)), "q_ids binary, q_vectors binary, q_tags binary").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = asked.repartition(groups, "grp").join(coded, "grp").select("q_ids", "q_vectors", "q_tags", "ids", "vectors", "codes", "norms")
    found = cells.mapInArrow(blocks.tidy(_searched(shared, dim, k, metric, rerank)), "query_id long, tag long, vec_id long, score double")
    order = W.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    best = io.stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
    io.discard(coded)
    return best


def _query_ids(vectors: DataFrame, is_query: Column, id_col: str) -> DataFrame:
    return vectors.filter(is_query).select(F.col(id_col).cast("long").alias("id"))


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0", 20)
