"""Near-duplicate classes against exact weighted Jaccard over all pairs."""

import random

import numpy as np
import pytest

from tracemill.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def family(seed, base_words, members, edits, start):
    """Copies of one text with a few words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(base_words)]
    rows = [(start, " ".join(base))]
    for i in range(1, members):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(base_words)] = f"x{rng.randrange(10**6)}"
        rows.append((start + i, " ".join(words)))
    return rows


def exact_classes(rows, idf):
    """Class (smallest id) of each row by comparing all pairs."""
    sets = [minhash.text_features(t, idf) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if same or minhash.similarity(sets[a], sets[b]) >= minhash.SIMILARITY:
                root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((doc_id, least.get(find(i))) for i, (doc_id, _) in enumerate(rows) if doc_id is not None)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    rows = family(1, 150, 60, 7, 0) + family(2, 400, 25, 8, 100) + family(3, 30, 20, 2, 200)
    rows += [(300 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, ""), (403, None), (404, "one two"), (405, "One,  two!"), (406, "..."), (407, "say it " * 500)]
    return rows


def test_classes_equal_all_pairs(spark, rows):
    documents = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    idf = minhash.document_frequencies(documents.select("text"))
    got = sorted((r["doc_id"], r["class_id"]) for r in minhash.classes(documents).collect())
    assert got == exact_classes(rows, idf)


def test_small_blocks_change_nothing(spark, rows, monkeypatch):
    documents = spark.createDataFrame(rows[:85], "doc_id long, text string")
    whole = sorted(tuple(r) for r in minhash.classes(documents).collect())
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 7)
    assert sorted(tuple(r) for r in minhash.classes(documents).collect()) == whole


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(3)
    idf = np.ones(1 << minhash.SKETCH_BITS)
    agree, near = [], []
    for _ in range(60):
        words = [f"w{rng.integers(10**6)}" for _ in range(300)]
        other = list(words)
        for _ in range(rng.integers(1, 20)):
            other[rng.integers(300)] = f"x{rng.integers(10**6)}"
        pair = [next(minhash.shingle_sets([" ".join(w)])) for w in (words, other)]
        signs = [minhash.signature(h, minhash.weights(h, c, idf)) for h, c in pair]
        agree.append((signs[0] == signs[1]).mean())
        near.append(minhash.similarity(*[minhash.features(h, c, idf) for h, c in pair]))
    assert abs(np.mean(agree) - np.mean(near)) < 0.02
    assert np.abs(np.array(agree) - near).max() < 0.25


def test_word_hashes_do_not_depend_on_the_slice():
    texts = ["Alpha beta", "", "gamma-delta  ALPHA", "beta"]
    together, bounds = minhash.word_hashes(texts)
    alone = [minhash.word_hashes([t])[0] for t in texts]
    assert [together[bounds[i] : bounds[i + 1]].tolist() for i in range(4)] == [a.tolist() for a in alone]
    assert together[0] == together[bounds[2] + 2]


def test_keep_first_keeps_one_row_of_each_class_and_all_columns(spark, rows):
    data = [(i, t, "en", "s", 1) for i, t in rows[:30]] + [(0, rows[0][1], "en", "s", 1), (None, "lost and found again today", "en", "s", 1)]
    documents = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS root", "2 AS key")
    kept = minhash.keep_first(documents)
    assert kept.columns == documents.columns
    classes = {r["class_id"] for r in minhash.classes(documents).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(c for c in classes if c is not None) and ids.count(None) == 1


def test_empty_table(spark):
    documents = spark.createDataFrame([], SCHEMA)
    assert minhash.classes(documents).collect() == [] and minhash.keep_first(documents).collect() == []
