"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries go in chunks of a proven size, broadcast one after the other; candidates are never shuffled for them. A chunk is
searched twice over: first in a share of the candidates, whose k-th score is a bound that holds everywhere, then in all
others. Candidates are searched in blocks. In a block every dimension has a list of the vectors sorted by that component.
A query walks the lists from the end that its sign favours, scores each vector it meets in full, and stops when the sum
of the best unseen component products cannot beat the k-th score found so far, here or in the first share. A block whose
best components cannot beat it is left at once. Only what may be among the k best is shuffled, to be ranked once more.

Scores are 64-bit. For vectors of d components those of under the root of 2^62 / d in absolute value give sums that fit,
whatever the pair; a vector with a larger one, whose scores may not, takes no part.

Defined cases: vectors that are null or hold a null, non-finite or too large component take no part, neither as queries
nor as candidates; shorter vectors count as padded with zeros; rows of equal id are rows of their own, and a query skips its own
row only; ties go to the smaller id; with fewer candidates than k all are returned; an empty table gives no rows; columns
beside vec_id and x are ignored, and may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, partitions, ranked, scratch, stage

#: Vectors of a block, bytes of the queries that are broadcast at once, and one in how many candidates gives the first bound.
BLOCK, CHUNK_BYTES, SHARE = 4096, 32 << 20, 16
#: No score is as low.
NONE = -(1 << 62)
FOUND = "q long, query_id long, vec_id long, uid long, score long"


def threshold_search(q: np.ndarray, own: int, v: np.ndarray, uid: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, bound: int = NONE):
    """Positions in v of the k best for q by (score, smaller id) that are not under bound, and their scores.

    lists: argsort of each column of v.
    """
    n, dims = len(v), np.flatnonzero(q)
    up, down = dims[q[dims] > 0], dims[q[dims] < 0]
    best, score = np.empty(0, np.int64), np.empty(0, q.dtype)
    seen, done = np.zeros(n, bool), np.zeros(n, bool)
    depth, at = 0, 0
    while True:
        if depth < n:
            edge = v[lists[n - 1 - depth, up], up] @ q[up] + v[lists[depth, down], down] @ q[down]
            if edge < bound or len(best) == k and score.min() > edge:
                break
        elif done.all():
            break
        depth = min(n, max(16 * k, 2 * depth)) if len(dims) else n
        if 2 * seen.sum() < n and len(dims) and depth < n:
            seen[lists[n - depth : n - at, up].ravel()] = True
            seen[lists[at:depth, down].ravel()] = True
        else:
            seen[:], depth = True, n
        new = np.flatnonzero(seen & ~done)
        done[new] = True
        new = new[uid[new] != own]
        found = v[new] @ q
        ok = found >= bound
        best, score = np.concatenate([best, new[ok]]), np.concatenate([score, found[ok]])
        if len(best) > k:
            first = np.lexsort((uid[best], ids[best], -score))[:k]
            best, score = best[first], score[first]
        at = depth
    return best, score


def _matrix(cells: pa.Array, dim: int, kind) -> np.ndarray:
    out = np.zeros((len(cells), dim), kind)
    offsets, flat = np.asarray(cells.offsets), np.asarray(cells.values)
    size = np.diff(offsets)
    out[np.repeat(np.arange(len(cells)), size), np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], size)] = flat[offsets[0] : offsets[-1]]
    return out


def _search(candidates: DataFrame, queries, k: int, dim: int, kind, block: int) -> DataFrame:
    """FOUND rows of candidates (uid, vec_id, x) for the broadcast queries (uid, id, matrix, bound)."""

    def blocks(batches):
        held, n = [], 0
        for b in batches:
            for i in range(0, len(b), block):
                s = b.slice(i, block)
                if n + len(s) > block:
                    yield held
                    held, n = [], 0
                held.append(s)
                n += len(s)
        if held:
            yield held

    def run(batches):
        own, names, matrix, bound = queries.value
        for held in blocks(batches):
            uid, ids = (np.concatenate([np.asarray(b.column(c)) for b in held]) for c in (0, 1))
            m = np.concatenate([_matrix(b.column(2), dim, kind) for b in held])
            lists, out = np.argsort(m, axis=0, kind="stable"), []
            for i in range(len(own)):
                best, score = threshold_search(matrix[i], own[i], m, uid, ids, lists, k, bound[i])
                if len(best):
                    out.append(np.stack([np.full(len(best), own[i]), np.full(len(best), names[i]), ids[best], uid[best], score.astype(np.int64)]))
            if out:
                rows = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["q", "query_id", "vec_id", "uid", "score"])

    return candidates.select("uid", "vec_id", "x").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, k: int, is_query, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for vectors (vec_id, x array<long>); is_query: condition on vec_id."""
    with scratch(vectors.sparkSession):
        return keep(_top_k(vectors, k, is_query, block, chunk_bytes), "best")


def _top_k(vectors: DataFrame, k: int, is_query, block: int, chunk_bytes: int) -> DataFrame:
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", F.isnotnull))
    vectors = stage(vectors.select("vec_id", "x").repartition(partitions(spark)), "vectors")
    wide = max(vectors.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0], 1)
    most = math.isqrt((1 << 62) // wide)
    vectors = vectors.where(F.forall("x", lambda y: y.between(-most, most)))
    vectors = stage(vectors.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    dim, high, n, nq = vectors.agg(
        F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max(F.expr("aggregate(x, 0L, (a, y) -> greatest(a, abs(y)))")), F.lit(0)),
        F.count("*"), F.count(F.when(is_query, 1)),
    ).first()
    kind = np.float64 if high * high * max(dim, 1) < 2**53 else np.int64  # sums of products are exact in either
    per = max(1, chunk_bytes // (8 * dim + 64))
    queries = ranked(vectors.where(is_query), ["uid"], "at").withColumn("r", F.expr(f"CAST(at div {per} AS INT)"))
    share = F.pmod(F.xxhash64("uid"), F.lit(min(SHARE, max(1, n // block)))) == 0
    order, parts = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "uid"), []
    for r in range(-(-nq // per)):
        t = queries.where(F.col("r") == r).select("uid", "vec_id", "x").toArrow().combine_chunks()  # ``per`` rows at most
        uid, names, cells = (t.column(c).combine_chunks() for c in range(3))
        chunk = [np.asarray(uid), np.asarray(names), _matrix(cells, dim, kind)]
        sent = spark.sparkContext.broadcast((*chunk, np.full(len(uid), NONE)))
        first = _search(vectors.where(share), sent, k, dim, kind, block)
        first = stage(first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n"), "first")
        at = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k).toPandas()  # a row a query of the chunk
        bound, place = np.full(len(uid), NONE), np.argsort(chunk[0])
        bound[place[np.searchsorted(chunk[0][place], at["q"].to_numpy(np.int64))]] = at["s"].to_numpy(np.int64)
        sent.unpersist()
        sent = spark.sparkContext.broadcast((*chunk, bound))
        parts += [first, stage(_search(vectors.where(~share), sent, k, dim, kind, block), "found")]
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for x in parts[1:]:
        found = found.union(x)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Five best inner products of floor(256 x) for each vector whose id is divisible by 50."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    e = e.where(F.col("e").isNotNull() & F.col("vec_id").isNotNull() & whole)
    return top_k(e.select("vec_id", F.transform("e", lambda x: F.floor(x * 256)).alias("x")), 5, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
      WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
