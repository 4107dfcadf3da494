"""Placement: draws by hand, shares, and what moves when the tree changes."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import sharding
from tracemill.llm.sharding import Node, balanced_tree, choose, place

ROWS = [(i, f"text {i % 50}") for i in range(4000)] + [(None, None), (None, "x"), (7, "text 7"), (5000, ""), (5001, "ü€𝄞"), (5002, None)]


def plain(key, node, path=""):
    if node.shard is not None:
        return node.shard

    def draw(child):
        digits = hashlib.md5(f"{path}/{child.name}/{key}".encode()).hexdigest()[:13]
        return -child.weight / math.log((int(digits, 16) + 0.5) / (1 << 52))

    live = [c for c in node.children if c.weight > 0]
    best = max(live, key=draw) if len(live) > 1 else live[0]
    return plain(key, best, f"{path}/{best.name}")


@pytest.fixture(scope="module")
def placed(spark):
    return place(spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot"), block_rows=300).collect()


def test_rows_and_columns(placed):
    got = sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in placed)
    assert got == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    slots = defaultdict(list)
    for r in placed:
        assert r["law"] == "key"
        assert r["shard"] == plain("null" if r["doc_id"] is None else r["doc_id"], balanced_tree(8))
        assert r["grown_shard"] == plain("null" if r["doc_id"] is None else r["doc_id"], balanced_tree(9))
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_more_shard_takes_rows_only_into_itself(placed):
    moved = [r for r in placed if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {8}
    assert abs(len(moved) / len(placed) - 1 / 9) < 0.03
    assert all(abs(n / len(placed) - 1 / 8) < 0.03 for n in Counter(r["shard"] for r in placed).values())


def test_growing_beyond_the_base(spark):
    keys = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    for shards in (9, 12):
        rows = keys.select(choose(F.col("k"), balanced_tree(shards)).alias("a"), choose(F.col("k"), balanced_tree(shards + 1)).alias("b")).collect()
        assert {r["b"] for r in rows if r["a"] != r["b"]} == {shards}


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    before, after = balanced_tree(8), balanced_tree(8, {5: 3.0})  # shard 5: region 1, rack 0
    rows = keys.select(choose(F.col("k"), before).alias("a"), choose(F.col("k"), after).alias("b")).collect()
    assert all(r["b"] // 4 == 1 for r in rows if r["a"] != r["b"])
    assert not any(r["a"] // 4 == 1 and r["a"] // 2 == 2 and r["b"] // 2 == 3 for r in rows)
    share = Counter(r["b"] for r in rows)
    assert abs(share[5] / len(rows) - 3 / 10) < 0.04
    emptied = keys.select(choose(F.col("k"), before).alias("a"), choose(F.col("k"), balanced_tree(8, {2: 0.0})).alias("b")).collect()
    assert not any(r["b"] == 2 for r in emptied)


def test_trees_without_weight_and_empty_tables(spark):
    with pytest.raises(ValueError, match="no child"):
        choose(F.lit("a"), Node("root", (Node("s", (), 0.0, 0),)))
    assert place(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert {r["shard"] for r in place(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tree=Node("root", (Node("s", (), 1.0, 4),))).collect()} == {4}
    assert sharding.balanced_tree(3).weight == 3
