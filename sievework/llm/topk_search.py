"""Exact top-k search by integer inner product: tiles of queries x candidates, partial selection, tree merging.

Queries are packed and walked in blocks of at most ``block_bytes``; a block is broadcast, and every partition of the
candidates is a shard that is read in batches. A batch and a slice of the block make a tile: one matrix product, of
which each query keeps its k best by partial selection, merged into its running list of the shard. The shards' lists
are merged by a tree: FAN shards at a time, then FAN groups, until one is left, so a task never holds more than
FAN * k rows of a query. Candidates are never shuffled, and neither all queries nor all scores are ever in one place.

Scores are exact: components are floor(scale * x) in double precision, and a product is taken in doubles only where
no partial sum can pass 2^53. Larger ones are summed as Python integers, and held within the range of long.

Row rules: vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id.
Vectors are compared with those of their length only; two empty ones score 0. Rows that share the query's vec_id are
its own and are no candidates; candidates that repeat another vec_id are ranked one by one. Of several rows that share
a query's vec_id the one with the smallest vector asks. Ties go to the smaller vec_id. A query without candidates
gives no row, nor do empty tables. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE, K, EVERY = 1024, 10, 100
#: Bytes of packed queries that are broadcast at a time, shards that are merged at once, and rows of a tile's sides.
BLOCK_BYTES, FAN, TILE_QUERIES, TILE_ROWS = 32 << 20, 16, 512, 4096
NONE = np.iinfo(np.int64).min
PACKED = "vec_id long, size int, vector binary"
LISTS = "query_id long, shard int, vec_id long, score long"


def vectors_of(ids: pa.Array, values: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of scaled components) of the valid vectors of a batch, for each length of vector."""
    ends = values.offsets.to_numpy()
    flat = values.values.cast(pa.float64())
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    size = np.diff(ends)
    fine = (bad[ends[1:]] == bad[ends[:-1]]) & values.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[fine]):
        rows = np.flatnonzero(fine & (size == n))
        yield numbers[rows], x[ends[rows][:, None] + np.arange(n)]


def pack(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, matrix in vectors_of(b.column(0), b.column(1), scale):
            n = matrix.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(np.full(len(ids), n, np.int32)), pa.array([row.tobytes() for row in matrix], pa.binary())], names=["vec_id", "size", "vector"]
            )


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k columns of each row with the highest scores, ties to smaller ids; columns need no order. A slot without a
    candidate has the score NONE. ids and scores have one shape."""
    order = np.lexsort((ids, np.negative(scores, where=scores != NONE, out=np.full_like(scores, np.iinfo(np.int64).max))), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; what passes the range of long is held at its ends."""
    top = lambda m: float(np.abs(m).max(initial=0))
    if top(queries) * top(rows) * max(1, queries.shape[1]) < 2**53:
        return (queries @ rows.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    wide = exact(queries) @ exact(rows).T if queries.shape[1] else np.zeros((len(queries), len(rows)), object)
    return np.array([[min(max(int(x), NONE + 2), -NONE - 1) for x in row] for row in wide], np.int64).reshape(len(queries), len(rows))


def tile_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of each query's k best rows of a tile whose rows are in order of id, in no order."""
    scores = product(queries, rows)
    own = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
    for q in np.flatnonzero(own[1] > own[0]):
        scores[q, own[0][q] : own[1][q]] = NONE
    if len(ids) <= k:
        return np.broadcast_to(ids, scores.shape), scores
    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
    above, level = scores > least, scores == least
    # rows are in order of id, so the first ones at the border are those with the smallest ids
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    at = np.nonzero(above | level)[1].reshape(len(scores), k)
    return ids[at], np.take_along_axis(scores, at, 1)


def shard_lists(batches: Iterator[pa.RecordBatch], block, scale: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best candidates of each query of the block among the rows of one partition."""
    block, held = block.value, {}
    for batch in batches:
        for ids, matrix in vectors_of(batch.column(0), batch.column(1), scale):
            if matrix.shape[1] not in block:
                continue
            query_ids, queries = block[matrix.shape[1]]
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], matrix[order]
            for i in range(0, len(ids), TILE_ROWS):
                for j in range(0, len(query_ids), TILE_QUERIES):
                    cut = slice(j, j + TILE_QUERIES)
                    found = tile_best(query_ids[cut], queries[cut], ids[i : i + TILE_ROWS], matrix[i : i + TILE_ROWS], k)
                    key = (matrix.shape[1], j)
                    if key in held:
                        found = best(np.hstack([held[key][0], found[0]]), np.hstack([held[key][1], found[1]]), k)
                    held[key] = found
    shard = TaskContext.get().partitionId()
    for (size, j), (ids, scores) in held.items():
        asked = np.repeat(block[size][0][j : j + TILE_QUERIES], ids.shape[1])
        real = scores.ravel() != NONE
        columns = [asked[real], np.full(int(real.sum()), shard, np.int32), ids.ravel()[real], scores.ravel()[real]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "shard", "vec_id", "score"])


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Packed queries by length, in blocks of about block_bytes, which follow the table partition by partition."""
    block, used = {}, 0
    for row in queries.toLocalIterator():
        if used and used + len(row.vector) + 8 > block_bytes:
            yield block
            block, used = {}, 0
        block.setdefault(row.size, []).append((row.vec_id, row.vector))
        used += len(row.vector) + 8
    if block:
        yield block


def as_arrays(block: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {n: (np.array([i for i, _ in rows], np.int64), np.frombuffer(b"".join(v for _, v in rows)).reshape(len(rows), n)) for n, rows in block.items()}


def merged(lists: DataFrame, k: int, by: list[Column]) -> DataFrame:
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of each query with the highest scores.

    queries and candidates: (vec_id, embedding).
    """
    spark = candidates.sparkSession
    numbers = F.col("embedding").cast("array<double>").alias("embedding")
    one = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), numbers)
    valid = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = one.where(valid).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    packed = materialize(one.mapInArrow(functools.partial(pack, scale=scale), PACKED), "topk-queries")
    rows = candidates.select(F.col("vec_id").cast("long").alias("vec_id"), numbers)
    lists = []
    for block in query_blocks(packed, block_bytes):
        sent = spark.sparkContext.broadcast(as_arrays(block))
        lists.append(materialize(rows.mapInArrow(functools.partial(shard_lists, block=sent, scale=scale, k=k), LISTS), "topk-lists"))
        sent.destroy()
    discard(packed)
    if not lists:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = functools.reduce(DataFrame.unionByName, lists)
    shards = (found.agg(F.max("shard")).first()[0] or 0) + 1
    while shards > fan:
        found = merged(found.withColumn("shard", F.expr(f"shard div {fan}").cast("int")), k, [F.col("shard")]).drop("rank")
        shards = -(-shards // fan)
    return merged(found, k, []).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    """Every hundredth id against all rows."""
    return top_k(embeddings.where(F.col("vec_id") % EVERY == 0), embeddings)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""
