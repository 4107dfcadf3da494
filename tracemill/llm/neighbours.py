"""Nearest neighbours by largest inner product, from randomly rotated one-bit codes.

A vector v is rotated by a random orthonormal matrix and split into its norm and its direction o.  The code keeps the sign of each of
the BITS coordinates; with x the unit vector of these signs, <o, x> is kept as correction.  For a query q the estimate of <v, q> is
``|v| * <x, q> / <o, x>``.  It misses by the part of q outside x, so that with ``s = sqrt(1 - <o, x>**2) / <o, x>`` the error is about normal
with deviation ``|v| * |q| * s / sqrt(BITS - 1)``; WIDTH deviations bound it.  ``<x, q>`` comes from packed bits: the rotated query is
rounded at random to QUERY_BITS bits per coordinate, and each bit plane is one AND and one population count per word of the code.

Per block of vectors, the K-th largest lower bound is a bar that K vectors reach; every vector whose upper bound reaches it is
scored by its exact inner product in double precision on the original vector.  Codes and queries meet block by block: every block of queries with every block of
vectors, dealt over tasks by the pair of blocks, and each pair returns K rows per query at most.  All rows are indexed.

Defined cases: null, empty and zero vectors, and those with null or non-finite components take no part, neither do vectors of another
length than the most frequent one (the longer one of equally frequent).  A null vec_id takes no part.  Rows that repeat a vec_id are
candidates each, but never for a query with the same id.  Ties go to the smaller vec_id.  With fewer than K candidates all are returned.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Run

K = 20
WIDTH = 4.0
QUERY_BITS = 4
BITS_PER_DIMENSION = 2
SEED = 11
BASE_ROWS = 4096
QUERY_ROWS = 512


@dataclass(frozen=True)
class Rotation:
    """Orthonormal rows: (bits, dimension), bits a multiple of 64 and at least the dimension."""

    matrix: np.ndarray

    @classmethod
    def random(cls, dimension: int, seed: int = SEED) -> Rotation:
        bits = -(-BITS_PER_DIMENSION * dimension // 64) * 64
        # Columns of a random orthonormal matrix: lengths and inner products stay as they are.
        square = np.random.default_rng(seed).standard_normal((bits, bits))
        q, r = np.linalg.qr(square)
        return cls(np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dimension]))

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs (n, bits / 64), norms and corrections <o, x>."""
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        turned = vectors @ self.matrix.T
        signs = turned >= 0
        bits = len(self.matrix)
        correction = np.abs(turned).sum(axis=1) / np.sqrt(bits) / norms
        packed = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)
        return packed, norms, correction

    def planes(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bit planes (QUERY_BITS, m, bits / 64), lower ends, steps, sums and norms of rotated queries."""
        turned = queries @ self.matrix.T
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-30)
        # The same dither for every query keeps results independent of the blocks.
        dither = np.random.default_rng(SEED + 1).random(turned.shape[1])
        level = np.clip(np.floor((turned - low[:, None]) / step[:, None] + dither), 0, (1 << QUERY_BITS) - 1).astype(np.uint8)
        planes = np.stack([np.packbits(level >> b & 1, axis=1, bitorder="little").view(np.uint64) for b in range(QUERY_BITS)])
        return planes, low, step, level.sum(axis=1, dtype=np.int64).astype(float), np.sqrt((queries * queries).sum(axis=1))


def estimates(rotation: Rotation, packed, norms, correction, query_planes) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (m, n) and the bounds of their errors."""
    planes, low, step, sums, query_norms = query_planes
    bits = len(rotation.matrix)
    ones = np.bitwise_count(packed).sum(axis=1, dtype=np.int64).astype(float)
    dots = np.zeros((planes.shape[1], len(packed)), dtype=np.uint32)
    for b in range(QUERY_BITS):
        for word in range(packed.shape[1]):
            dots += np.left_shift(np.bitwise_count(planes[b][:, word, None] & packed[None, :, word]), b, dtype=np.uint32)
    # <x, q> for x = (2 * bit - 1) / sqrt(bits) and q = low + step * level.
    along = (2 * (step[:, None] * dots + low[:, None] * ones) - (step * sums + low * bits)[:, None]) / np.sqrt(bits)
    estimate = along * (norms / correction)
    missed = np.sqrt(np.maximum(0.0, 1 - correction**2)) / correction / np.sqrt(bits - 1) * norms
    # Rounding the query moves <x, q> by up to half a step per coordinate, at random.
    rounding = step[:, None] * 0.5 * (norms / correction)
    return estimate, WIDTH * (query_norms[:, None] * missed + rounding)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each row summed in the same order."""
    return (vectors * query).sum(axis=1)


def best_of_block(rotation: Rotation, queries: tuple[np.ndarray, np.ndarray], base: tuple, k: int):
    """(query id, vector id, score) of at most k candidates per query from one block."""
    query_ids, query_vectors = queries
    ids, vectors, packed, norms, correction = base
    estimate, bound = estimates(rotation, packed, norms, correction, rotation.planes(query_vectors))
    estimate[query_ids[:, None] == ids[None, :]] = -np.inf
    lower = estimate - bound
    bar = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(query_ids), -np.inf)
    reached = (estimate + bound >= bar[:, None]) & np.isfinite(estimate)
    out = []
    for row, query_id in enumerate(query_ids):
        chosen = np.flatnonzero(reached[row])
        scores = exact(vectors[chosen], query_vectors[row])
        order = np.lexsort((ids[chosen], -scores))[:k]
        out.append((np.full(len(order), query_id), ids[chosen][order], scores[order]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(embeddings: DataFrame, dimension: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the vectors that take part, and their length."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0)).where(F.forall("vector", sound) & F.exists("vector", lambda x: x != 0))
    if dimension is None:
        lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).take(1)
        dimension = lengths[0]["length"] if lengths else 0
    return rows.where(F.size("vector") == dimension), dimension


def _matrix(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _base_blocks(rotation: Rotation, dimension: int):
    """One row per block of vectors: ids, vectors, codes, norms and corrections as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BASE_ROWS):
                part = batch.slice(start, BASE_ROWS)
                ids, vectors = part.column("vec_id").to_numpy(), _matrix(part, dimension)
                packed, norms, correction = rotation.codes(vectors)
                arrays = (ids, vectors, packed, norms, correction)
                columns = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "vectors", "codes", "norms", "corrections"])

    return run


def _query_blocks(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(start, QUERY_ROWS)
                columns = [part.column("vec_id").to_numpy().tobytes(), np.ascontiguousarray(_matrix(part, dimension)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["query_ids", "query_vectors"])

    return run


def search(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of every row that is a query, among all other rows."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark, run = embeddings.sparkSession, Run(embeddings.sparkSession, "neighbours")
    rows, dimension = usable(embeddings)
    if not dimension:
        return spark.createDataFrame([], schema)
    rotation = spark.sparkContext.broadcast(Rotation.random(dimension))  # bits x dimension numbers, whatever the table
    base = run.land(
        rows.mapInArrow(lambda it: _base_blocks(rotation.value, dimension)(it), "ids binary, vectors binary, codes binary, norms binary, corrections binary"),
        "base",
    )
    chosen = rows.where(is_query)
    blocks = max(1, -(-chosen.count() // QUERY_ROWS))
    chosen = chosen.repartition(blocks, F.xxhash64("vec_id"))
    queries = run.land(chosen.mapInArrow(_query_blocks(dimension), "query_ids binary, query_vectors binary"), "queries")

    # Every block of queries meets every block of vectors.  The query blocks are copied to each fold of the vector blocks, one fold per block.
    folds = max(1, base.count())
    folded = base.withColumn("fold", F.pmod(F.xxhash64("ids"), F.lit(folds)).cast("int"))
    copied = queries.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    met = folded.hint("shuffle_hash").join(copied, "fold")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = {n: batch.column(n)[row].as_py() for n in ("ids", "vectors", "codes", "norms", "corrections", "query_ids", "query_vectors")}
                turned = rotation.value
                vectors = np.frombuffer(held["vectors"]).reshape(-1, dimension)
                query_vectors = np.frombuffer(held["query_vectors"]).reshape(-1, dimension)
                codes = np.frombuffer(held["codes"], dtype=np.uint64).reshape(len(vectors), -1)
                block = (np.frombuffer(held["ids"], dtype=np.int64), vectors, codes, np.frombuffer(held["norms"]), np.frombuffer(held["corrections"]))
                for start in range(0, len(query_vectors), 128):
                    part = slice(start, start + 128)
                    found = best_of_block(turned, (np.frombuffer(held["query_ids"], dtype=np.int64)[part], query_vectors[part]), block, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    found = met.select("ids", "vectors", "codes", "norms", "corrections", "query_ids", "query_vectors").mapInArrow(meet, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

