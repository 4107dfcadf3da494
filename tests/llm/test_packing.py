"""Length buckets against all ways to cut, batches against their definition."""

import itertools
import random
from collections import defaultdict

import pytest

from tracemill.llm import packing


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def plain_boundaries(lengths, buckets):
    """Best boundaries by trying all (few distinct lengths) or by the plain quadratic program."""
    distinct = sorted(set(lengths))
    if len(distinct) <= buckets:
        return distinct
    counts = [lengths.count(d) for d in distinct]
    best = {(0, 0): (0, ())}
    for used in range(1, buckets + 1):
        for j in range(1, len(distinct) + 1):
            options = []
            for i in range(j):
                if (used - 1, i) in best:
                    cost = sum(c * (distinct[j - 1] - d) for d, c in zip(distinct[i:j], counts[i:j], strict=True))
                    options.append((best[used - 1, i][0] + cost, (*best[used - 1, i][1], distinct[j - 1])))
            if options:
                best[used, j] = min(options, key=lambda o: o[0])
    return list(best[buckets, len(distinct)][1])


@pytest.mark.parametrize("seed", range(12))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [int(rng.lognormvariate(3, 1)) + 1 for _ in range(rng.randrange(5, 90))]
    distinct = sorted(set(lengths))
    for buckets in (1, 2, 3, 5):
        ends = packing.boundaries(distinct, [lengths.count(d) for d in distinct], buckets)
        assert ends == sorted(set(ends)) and ends[-1] == distinct[-1] and len(ends) <= buckets
        if len(distinct) <= 22 and buckets <= 3:
            least = min(padding(lengths, [*cut, distinct[-1]]) for r in range(buckets) for cut in itertools.combinations(distinct[:-1], r))
        else:
            least = padding(lengths, plain_boundaries(lengths, buckets))
        assert padding(lengths, ends) == least


def test_batches(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 120))) for i in range(700)]
    rows += [(5, rows[5][1])] * 3 + [(None, "a b"), (None, None), (900, "long " * 4000), (901, " x y z"), (902, "a\x0bb\x0cc\td\r\ne")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS n_tokens"), 6, 1000, 50).collect()
    assert len(got) == len(rows)
    lengths = [r["n_tokens"] for r in got]
    ends = packing.boundaries(sorted(set(lengths)), [lengths.count(d) for d in sorted(set(lengths))], 6)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[901]["n_tokens"] == 3 and by_id[902]["n_tokens"] == 6 and by_id[900]["n_tokens"] == 4001
    batches = defaultdict(list)
    for r in got:
        assert r["padded_length"] == min(e for e in ends if e >= r["n_tokens"]) == ends[r["bucket"]]
        assert r["padding"] == r["padded_length"] - r["n_tokens"]
        batches[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), members in batches.items():
        capacity = max(1, 1000 // ends[bucket])
        assert sorted(m["position"] for m in members) == list(range(len(members)))
        assert len(members) == capacity or batch == max(b for k, b in batches if k == bucket)
        assert len(members) * ends[bucket] <= 1000 or len(members) == 1


def test_empty_and_single(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (row,) = packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert (row["n_tokens"], row["bucket"], row["padded_length"], row["batch"], row["position"]) == (1, 0, 1, 0, 0)
