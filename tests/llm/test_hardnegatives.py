"""Hard negatives against brute force, and how much of the index the walks visit."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import hardnegatives
from tracemill.llm.hardnegatives import MOST, Miner, MultiIndex, k_means, scores

SMALL = {"pilot_rows": 60, "cell_rows": 8}


def brute(rows, k=5, low=80, scale=256, anchor=lambda i, label: i % 100 == 0):
    sound = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)
    held = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if i is not None and label is not None and sound(v)]
    lengths = [len(h[2]) for h in held]
    length = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    held = [h for h in held if len(h[2]) == length]
    out = []
    for a, a_label, q in held:
        if not anchor(a, a_label):
            continue
        score = lambda v: max(-MOST, min(MOST, sum(x * y for x, y in zip(q, v, strict=True))))  # noqa: E731, B023
        others = sorted(((-score(v), i, label == a_label) for i, label, v in held if i != a), key=lambda t: t[:2])
        for minus, positive, _ in [t for t in others if t[2]][:k]:
            inside = [t for t in others if not t[2] and low * -minus <= 100 * -t[0] <= 100 * -minus]
            out += [(a, positive, rank + 1, i, -minus, -s) for rank, (s, i, _) in enumerate(inside[:k])]
    return sorted(out)


def found(spark, rows, is_anchor="vec_id % 100 = 0", kind="float", **options):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"key": F.lit("clash"), "rank": F.lit(0), "cell": F.lit("c")})
    return sorted(tuple(r) for r in hardnegatives.mine(table, F.expr(is_anchor), **options).collect())


def clustered(n, dimension=16, centres=12, spread=0.15, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dimension))
    place = rng.integers(centres, size=n)
    vectors = (middle[place] + spread * rng.standard_normal((n, dimension))).astype(np.float32)
    return [(i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(vectors, (place // 2 + (rng.random(n) < 0.3)) % 6, strict=True))]


def test_clusters_with_many_cells_and_blocks(spark, monkeypatch):
    rows = clustered(3000)
    monkeypatch.setattr(hardnegatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hardnegatives, "ANCHOR_ROWS", 7)
    assert found(spark, rows, **SMALL) == brute(rows) != []


@pytest.mark.parametrize("k, low", [(1, 95), (3, 0), (7, 50)])
def test_noise_without_clusters(spark, k, low):
    rng = np.random.default_rng(k)
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(rng.standard_normal((600, 5)).astype(np.float32))]
    assert found(spark, rows, k=k, low=low, **SMALL) == brute(rows, k=k, low=low)


def test_ties_repeated_rows_and_rows_that_take_no_part(spark):
    same = [0.5, 1.0, -0.25]
    rows = [(i, same, i % 2) for i in range(90)] + [(100, same, 0), (100, same, 0), (200, [0.0, 0.0, 0.0], 1), (-100, [-1.0, 0.0, 0.0], 1)]
    rows += [(300, None, 0), (400, [], 0), (500, [1.0, None, 1.0], 0), (600, [float("nan"), 1.0, 1.0], 0), (700, [float("inf"), 1.0, 1.0], 0)]
    rows += [(800, [1.0, 1.0], 0), (900, same, None), (None, same, 0), (3, same, 1), (5, same, 0)]
    got = found(spark, rows, **SMALL)
    assert got == brute(rows)
    assert [g[3] for g in got if g[:2] == (100, 0)] == [1, 1, 3, 3, 3, 3, 5, 5, 7, 7]  # the anchor is there twice, so is vec_id 3


def test_few_rows_empty_table_and_huge_numbers(spark):
    assert found(spark, []) == [] == found(spark, [(0, [1.0], 1)])
    few = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 0), (3, [0.7], 0), (4, [1.1], 0)]
    assert found(spark, few) == brute(few) == [(0, 1, 1, 2, 65536, 58880)]
    rng = np.random.default_rng(0)
    huge = [(i, [float(x) * 10.0 ** (i % 40) for x in v], i % 3) for i, v in enumerate(rng.standard_normal((300, 6)))]
    huge += [(1000, [1.7e308] * 6, 0), (1001, [1e300] * 6, 1), (1100, [1e300] * 6, 2)]
    assert found(spark, huge, kind="double", **SMALL) == brute(huge)


def test_scores_are_exact_beyond_doubles():
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**24, 1.0], [-(2.0**30), 3.0]])
    assert scores(a, b).tolist() == [[(1 << 54) + 1, -MOST]]


@pytest.mark.parametrize("dimension", [2, 7, 32])
def test_bounds_hold_and_the_heap_falls(dimension):
    rng = np.random.default_rng(dimension)
    vectors, anchors = rng.standard_normal((2000, dimension)) * 50, rng.standard_normal((20, dimension)) * 50
    cut = dimension // 2
    plain = MultiIndex((k_means(vectors[:300, :cut], 7), k_means(vectors[:300, cut:], 5)))
    cells, far, long = plain.place(vectors)
    i, j = np.divmod(cells, 5)
    most = lambda values, at, n: np.array([values[at == c].max(initial=-1) for c in range(n)])
    radii, reaches = (most(far[0], i, 7), most(far[1], j, 5)), (most(long[0], i, 7), most(long[1], j, 5))
    index = MultiIndex(plain.books, radii, reaches, np.bincount(cells, minlength=35).reshape(7, 5))
    first, second = index.half_bounds(anchors)
    assert (first[:, i] + second[:, j] >= anchors @ vectors.T).all()
    for row in range(20):
        walked = [c for c, _ in index.walk(first[row], second[row], -np.inf if row else -1e299)]
        sums = [first[row, c // 5] + second[row, c % 5] for c in walked]
        assert sums == sorted(sums, reverse=True) and sorted(walked) == sorted(set(cells.tolist()))
        least = sums[len(sums) // 2]
        assert [c for c, _ in index.walk(first[row], second[row], least)] == [c for c, s in zip(walked, sums, strict=True) if s >= least]


def test_windows_stop_the_walk_on_clusters(spark):
    """The certified walks of clustered vectors visit a small part of the index."""
    rows = clustered(6000, dimension=32, centres=40, spread=0.05)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    miner = Miner(table, cell_rows=20)
    anchors = miner.anchors(F.col("vec_id") % 100 == 0)
    whole = anchors.select("*", F.array(F.lit(-MOST).cast("long")).alias("lows"), F.array(F.lit(MOST).cast("long")).alias("highs"))
    best = miner.certified(whole, True, 5)
    bars = {r["key"]: r["score"] for r in best.where("rank = 5").collect()}
    index, visited = miner.index.value, []
    for r in anchors.collect():
        first, second = index.half_bounds(np.frombuffer(r["vector"]).reshape(1, -1))
        visited.append(sum(n for _, n in index.walk(first[0], second[0], bars[r["key"]])) / len(rows))
    assert np.mean(visited) < 0.15
