"""Benchmark matches against plain edit distance over all stretches."""

import random

import pytest

from tracemill.llm import decontaminate
from tracemill.llm.decontaminate import Matcher, Pattern, normal


def distance_in(text, item):
    """Smallest edit distance of ``item`` to any stretch of ``text``, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for char in text:
        new = [0]
        for j, c in enumerate(item):
            new.append(min(row[j] + (char != c), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("seed", range(10))
def test_bit_parallel_distance(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("abcd ") for _ in range(rng.randrange(5, 150)))
    text = list("".join(rng.choice("abcd ") for _ in range(60)) + item + "".join(rng.choice("abcd ") for _ in range(60)))
    for _ in range(rng.randrange(0, 12)):
        at = rng.randrange(len(text))
        text[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
    text = "".join(text)
    want = distance_in(text, item)
    got = Pattern(item, len(item)).best(text)
    assert got[0] == want and distance_in(text[got[1] : got[2]], item) == want
    assert Pattern(item, want - 1).best(text) is None if want else True


def make(rng, edits, item):
    words = item.split()
    chars = list(item)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], ["q"], [chars[at], "z"]])
    filler = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    return f"{filler(40)}. {''.join(chars)}! {filler(30)}", len(words)


def test_matches_equal_plain_search(spark):
    rng = random.Random(9)
    items = [(i, " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 50)))) for i in range(12)]
    items += [(50, "Tiny"), (51, ""), (52, None), (53, items[0][1].upper() + "!!")]
    documents = [(n, make(rng, n % 25, items[n % 12][1])[0]) for n in range(100)]
    documents += [(200, None), (201, ""), (202, "a tiny one"), (203, "tinyish"), (204, "Tiny"), (None, items[3][1]), (205, (items[4][1] + " ") * 3)]
    table = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS hits")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.matches(table, bench).collect()
    want = set()
    for doc_id, text in documents:
        for item_id, item in items:
            item, body = normal(item), normal(text)
            budget = int(decontaminate.ERROR_SHARE * len(item))
            if item and budget and distance_in(body, item) <= budget or item and not budget and f" {item} " in f" {body} ":
                want.add((doc_id, item_id, distance_in(body, item)))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in rows} == want
    assert {r["hits"] for r in rows if r["doc_id"] == 205} == {3}
    texts = dict(documents)
    for r in rows:
        stretch = normal(texts[r["doc_id"]])[r["start"] : r["end"]]
        assert distance_in(stretch, normal(dict(items)[r["item_id"]])) == r["distance"]
    clean = {r["doc_id"] for r in decontaminate.keep_clean(table, bench).collect()}
    assert clean == {d for d, _ in documents} - {d for d, _, _ in want}


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, " ".join(str(rng.random()) for _ in range(6))) for i in range(9)]
    table = spark.createDataFrame([(i, f"x {items[i % 9][1]} y") for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(decontaminate.matches(table, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    assert len(list(decontaminate.item_blocks(bench))) > 3
    assert sorted(decontaminate.matches(table, bench).collect()) == whole and len(whole) == 30


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(documents, bench).collect() == [] and decontaminate.keep_clean(documents, bench).count() == 1
    some = spark.createDataFrame([(1, "abc")], "item_id long, text string")
    assert decontaminate.matches(documents.limit(0), some).collect() == []


def test_long_text():
    item = " ".join(f"word{i}" for i in range(40))
    (hit,) = Matcher([(1, item)]).find("filler " * 200000 + item + " filler" * 1000)
    assert hit[1] == 0 and hit[4] == 1
