"""Exact top-k by inner product: tiled matrix products and a tree merge.

Both sides are packed where they stand: vectors into tiles and queries into blocks, of at most ``tile_rows`` and ``block_rows`` rows of one
length, each a row of binary columns.  Tiles are dealt to shards; every block goes to every shard, by an equi-join on the shard, so a pair of
block and tile is a row, nothing is collected or broadcast by hand, and no task holds more than a shard's tiles (which Spark spills) and the lists of ``HELD``
blocks.  A pair gives a matrix product, of which each query's best k are selected in part and merged into its running list; the lists of
the tasks are then merged in two levels, first within groups of shards, then overall.

Defined cases: vectors that are null, empty, or hold null or non-finite components
take no part, as query or candidate; vectors of another length than the query's give
no score; equal scores go to the smaller vec_id; a query with fewer candidates returns
all; rows that repeat a vec_id are candidates each, and none is a candidate of its own
id; an empty table gives no rows; other columns aren't read.  Components whose scaled value, and products whose score, is beyond 2 ** 62 in size
raise: a score is a 64-bit integer, and none is wrapped or rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

#: No component, and no score, may be as large as this.
LARGEST = 1 << 62
#: Blocks of queries whose lists a task holds at once.
HELD = 64
_PARTIAL = "query_id long, vec_id long, score long, part int"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and q, the vector of floor(scale * x); only vectors all of whose components are finite."""
    x = F.col("embedding")
    fit = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = lambda v: F.when(F.abs(v.cast("double") * scale) < LARGEST, F.floor(v.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large for integer scores")))
    return vectors.where(fit & F.col("vec_id").isNotNull()).select("vec_id", F.transform(x, whole).alias("q"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows of each vector length."""
    ids, q = np.asarray(batch["vec_id"]), batch["q"]
    flat, sizes = np.asarray(q.flatten()), np.asarray(q.value_lengths())
    start = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield ids[at], flat[start[at, None] + np.arange(n)]


_PACKED = pa.schema([("number", pa.int64()), ("width", pa.int32()), ("small", pa.bool_()), ("ids", pa.binary()), ("data", pa.binary())])


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """number (of its own, by its content), width, small (32-bit components), ids, data: at most ``rows`` vectors of one length in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(width: int, least: int) -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate(c) for c in zip(*held.pop(width)))
            lo = 0
            while len(ids) - lo >= least:
                i, d = ids[lo : lo + rows], data[lo : lo + rows]
                small = bool(np.abs(d).max(initial=0) < 2**31)
                bytes_ = np.ascontiguousarray(d, np.int32 if small else np.int64).tobytes()
                number = int.from_bytes(hashlib.blake2b(i.tobytes() + bytes_, digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_pylist([{"number": number, "width": width, "small": small, "ids": i.astype(np.int64).tobytes(), "data": bytes_}], schema=_PACKED)
                lo += rows
            if lo < len(ids):
                held[width] = [(ids[lo:], data[lo:])]

        for batch in batches:
            for ids, m in _matrices(batch):
                held.setdefault(m.shape[1], []).append((ids, m))
                if sum(len(i) for i, _ in held[m.shape[1]]) >= rows:
                    yield from out(m.shape[1], rows)
        for width in list(held):
            yield from out(width, 1)

    return vectors.select("vec_id", "q").mapInArrow(run, "number long, width int, small boolean, ids binary, data binary")


def _matrix(width: int, small: bool, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32 if small else np.int64).reshape(-1, width)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats, which are fast, where they are exact, else by int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    for kind, exact in ((np.float32, 2**24), (np.float64, 2**53)):
        if most < exact:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    if most < LARGEST:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = a.astype(object) @ b.astype(object).T
    if np.abs(whole).max() >= LARGEST:
        raise OverflowError("a score is beyond 2 ** 62")
    return whole.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best scores and their ids, ties to the smaller id; ids: one per column, or one per cell."""
    ids = np.broadcast_to(ids, scores.shape)
    if scores.shape[1] > k:
        # Partial selection by score; everything that ties with the k-th score stays in, so that ids can decide.
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        width = int((scores >= kth).sum(axis=1).max())
        at = np.argpartition(-scores, width - 1, axis=1)[:, :width] if width < scores.shape[1] else np.broadcast_to(np.arange(width), scores.shape)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


#: Below any score, and safe to negate.
_NONE = -(1 << 62) - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 4096, tile_rows: int = 4096, shard_rows: int = 1 << 18) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows of vectors.

    vectors and queries: vec_id and q as quantised() gives them.  A shard has about ``shard_rows`` vectors.
    """
    spark = vectors.sparkSession
    shards = max(1, spark.sparkContext.defaultParallelism, -(-vectors.count() // shard_rows))
    tiles = packed(vectors, tile_rows).withColumn("shard", F.pmod("number", F.lit(shards)).cast("int"))
    blocks = packed(queries, block_rows).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = tiles.toDF("number", "width", "t_small", "t_ids", "t_data", "shard").drop("number")
    pairs = blocks.join(right, ["shard", "width"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple[int, int, int], list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (shard, _, _), (ids, s, v) in lists.items():
                real = s != _NONE
                q = np.repeat(ids, real.sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v[real]), pa.array(s[real]), pa.array(np.full(len(q), shard, np.int32))], ["query_id", "vec_id", "score", "part"])
            lists.clear()

        for batch in batches:
            for r in batch.to_pylist():
                ids, tile = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["t_ids"], np.int64)
                scores = _product(_matrix(r["width"], r["small"], r["data"]), _matrix(r["width"], r["t_small"], r["t_data"]))
                scores[ids[:, None] == tile[None, :]] = _NONE
                s, v = best(scores, tile, k)
                key = r["shard"], r["number"], r["width"]
                if key in lists:
                    s, v = best(np.hstack([lists[key][1], s]), np.hstack([lists[key][2], v]), k)
                elif len(lists) >= HELD:
                    yield from out()
                lists[key] = [ids, s, v]
        yield from out()

    partial = pairs.select("shard", "number", "width", "small", "ids", "data", "t_small", "t_ids", "t_data").mapInArrow(search, _PARTIAL)
    order = [F.col("score").desc(), F.col("vec_id")]
    group = F.floor(F.sqrt(F.col("part").cast("double")))
    level = partial.withColumn("part", group).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(order))).where(F.col("rank") <= k)
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    return level.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
