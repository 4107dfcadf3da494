"""Interpolated n-gram scores against plain counting, and the weights against the definition."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracemill.llm import langmodel

SCHEMA = "doc_id long, text string"


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        text, word = [], "w0"
        for _ in range(rng.randrange(60)):
            word = words[(words.index(word) * 3 + rng.randrange(3)) % 40]
            text.append(word if rng.random() < 0.9 else word.upper())
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return [*rows, (120, None), (121, ""), (122, "Ünï É w1"), (123, "new " * 50), (None, "w1 w2"), (7, rows[7][1]), (124, "a\x0bb\x0cc d")]


def counted(rows, folds, order):
    """Counts of all n-grams up to ``order`` as tuples, the start of texts included, and the number of texts."""
    grams, starts = [Counter() for _ in range(order + 1)], 0
    for doc_id, text in rows:
        if fold(doc_id) in folds:
            sequence = ["<s>"] * (order - 1) + tokens(text)
            for n in range(1, order + 1):
                grams[n].update(tuple(sequence[i - n + 1 : i + 1]) for i in range(order - 1, len(sequence)))
            starts += 1
    return grams, starts


def plain_terms(rows, folds, text, order):
    """Estimates (uniform first) and bucket of each token."""
    grams, starts = counted(rows, folds, order)
    total, words = sum(grams[1].values()), len(grams[1])
    out, sequence = [], ["<s>"] * (order - 1) + tokens(text)
    for i in range(order - 1, len(sequence)):
        terms, bucket = [1 / (words + 1), grams[1][sequence[i],] / max(total, 1)], 0
        for n in range(2, order + 1):
            context = tuple(sequence[i - n + 1 : i])
            seen = starts if i == order - 1 else grams[n - 1][context]
            terms.append(grams[n][(*context, sequence[i])] / seen if seen else 0.0)
            if seen:
                bucket = 1 + (n - 2) * langmodel.BUCKETS + int(math.log2(seen))
        out.append((*terms, bucket))
    return out


def plain_weights(rows, order):
    p, buckets = [], []
    for doc_id, text in rows:
        if fold(doc_id) == langmodel.DELETED_FOLD:
            for *terms, bucket in plain_terms(rows, {0, 3, 4}, text, order):
                steps = [0, *langmodel.BIN_STEPS]
                p.append([2.0 ** (-float(np.rint(-steps[i] * math.log2(t))) / steps[i]) if t and i else t for i, t in enumerate(terms)])
                buckets.append(bucket)
    return langmodel.fit_weights(np.array(p).T, np.array(buckets), np.ones(len(p)))


@pytest.mark.parametrize(("order", "ranges"), [(2, 1 << 20), (2, 200), (3, 300)])
def test_scores_equal_plain_counting(spark, monkeypatch, order, ranges):
    monkeypatch.setattr(langmodel, "RANGE_GRAMS", ranges)
    monkeypatch.setattr(langmodel, "BLOCK_BYTES", 1500)
    rows = corpus()
    got = langmodel.score(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS block", "1 AS part"), order).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i, _ in rows)
    weights = plain_weights(rows, order)
    uni = {gram[0]: n for gram, n in counted(rows, {0, 2, 3, 4}, order)[0][1].items()}
    total, words, texts = sum(uni.values()), len(uni), dict(rows)
    for r in got:
        sequence = tokens(texts[r["doc_id"]])
        assert r["held_out"] == (fold(r["doc_id"]) == 1) and r["train_tokens"] == total
        assert r["n_tokens"] == len(sequence) and r["n_known"] == sum(t in uni for t in sequence)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni.get(t, 0) + 0.5) / (total + 0.5 * (words + 1))) for t in sequence))
        score = sum(math.log10(float(weights[bucket] @ terms)) for *terms, bucket in plain_terms(rows, {0, 2, 3, 4}, texts[r["doc_id"]], order))
        assert r["score"] == pytest.approx(score, rel=1e-6)
    held = [r for r in got if r["held_out"] and (r["n_tokens"] or 0) > 5]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_after_a_context_sum_to_one():
    rows = corpus()
    grams, _ = counted(rows, {0, 2, 3, 4}, 2)
    weights, total = plain_weights(rows, 2), sum(grams[1].values())
    for previous in ("w3", "w7"):
        seen = grams[1][previous,]
        w = weights[1 + int(math.log2(seen))]
        mass = sum(w @ np.array([1 / (len(grams[1]) + 1), n / total, grams[2][previous, t] / seen]) for (t,), n in grams[1].items()) + w[0] / (len(grams[1]) + 1)
        assert mass == pytest.approx(1)


def test_em_does_not_lose_likelihood():
    rng = np.random.default_rng(2)
    p, n = rng.random((3, 200)) ** 4, rng.integers(1, 9, 200).astype(float)
    fitted = langmodel.fit_weights(p, np.zeros(200, dtype=int), n)[0]
    value = lambda w: (np.log(w @ p) * n).sum()
    assert fitted.sum() == pytest.approx(1)
    assert all(value(fitted) >= value(w) for w in rng.dirichlet(np.ones(3), 300))


def test_trigrams_and_empty_tables(spark):
    table = spark.createDataFrame(corpus(), SCHEMA)
    two, three = (sum(r["score"] for r in langmodel.score(table, order).collect() if not r["held_out"]) for order in (2, 3))
    assert three > two
    assert langmodel.score(spark.createDataFrame([], SCHEMA)).collect() == []
    only = langmodel.score(spark.createDataFrame([(i, "a b") for i in range(40) if fold(i) == 1], SCHEMA)).collect()
    assert all(r["score"] == 0 and r["train_tokens"] == 0 and r["n_known"] == 0 for r in only) and only


def test_many_arrow_batches_per_partition(spark):
    """Both passes cut the same blocks when a partition has several batches."""
    table = spark.createDataFrame(corpus(), SCHEMA).coalesce(1)
    whole = sorted((str(r["doc_id"]), r["score"]) for r in langmodel.score(table).collect())
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    spark.conf.set(option, "7")
    try:
        cut = sorted((str(r["doc_id"]), r["score"]) for r in langmodel.score(table).collect())
    finally:
        spark.conf.set(option, before)
    assert [i for i, _ in cut] == [i for i, _ in whole]
    assert [s for _, s in cut] == pytest.approx([s for _, s in whole])


def test_packed_arrays_come_back():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (np.cumsum(langmodel.unpack(langmodel.pack(np.diff(values, prepend=np.uint64(0))), np.uint64)) == values).all()
    assert len(langmodel.unpack(langmodel.pack(np.empty(0, np.uint32)), np.uint32)) == 0
