"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import neighbours


def brute(rows, k=20):
    """Nearest by exact inner product, ties to the smaller id."""
    sound = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for query_id, query in sound:
        if query_id % 20 == 0:
            scored = sorted((-float((v * query).sum()), i) for i, v in sound if i != query_id)[:k]
            out += [(query_id, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, k=20):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    return sorted(tuple(r) for r in neighbours.search(table, F.col("vec_id") % 20 == 0, k).collect())


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 64))
    vectors = (centres[rng.integers(30, size=3000)] + 0.6 * rng.standard_normal((3000, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got, want = found(spark, rows), brute(rows)
    assert len(got) == len(want) == 150 * 20
    near = {(q, v) for q, _, v, _ in want}
    assert len(near & {(q, v) for q, _, v, _ in got}) / len(near) >= 0.99
    exact = {(q, v): s for q, _, v, s in want}
    assert all(exact[q, v] == s for q, _, v, s in got if (q, v) in exact)
    for query_id in {g[0] for g in got}:
        mine = [g for g in got if g[0] == query_id]
        assert [(-s, v) for _, _, v, s in mine] == sorted((-s, v) for _, _, v, s in mine)


def test_ties_and_vectors_that_take_no_part(spark):
    same = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, same) for i in range(70)]
    rows += [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 1.0, 1.0]), (104, [float("nan"), 1.0, 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0, 1.0])]
    rows += [(120, [1.0, 2.0]), (None, same)]
    got = found(spark, rows)
    assert got == brute([r for r in rows if r[0] != 120])
    assert [g[2] for g in got if g[0] == 20] == [*range(20)]


def test_few_candidates_and_empty_table(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [0.5, 1.0])]) == [(0, 1, 1, 0.5)]
    assert found(spark, [(0, [1.0, 0.0])]) == []
    assert found(spark, []) == []


@pytest.mark.parametrize("dimension", [3, 64, 100])
def test_error_bounds_hold(dimension):
    rng = np.random.default_rng(dimension)
    rotation = neighbours.Rotation.random(dimension)
    assert np.allclose(rotation.matrix.T @ rotation.matrix, np.eye(dimension))
    vectors, queries = rng.standard_normal((500, dimension)), rng.standard_normal((40, dimension))
    estimate, bound = neighbours.estimates(rotation, *rotation.codes(vectors), rotation.planes(queries))
    missed = np.abs(estimate - queries @ vectors.T)
    assert (missed <= bound).mean() > 0.995
