"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import ngramjoin
from tracemill.llm.ngramjoin import common_counts, gram_sets, join, least_common, least_different, most_different, outline, prefix, range_counts, unit_links


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), own in zip(rows, label, strict=True):
        if i is not None:
            least[own] = min(i, least.get(own, i))
    return sorted(((i, len(s), least.get(own)) for (i, _), s, own in zip(rows, sets, label, strict=True)), key=str)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("n", "set", "set_key", "component_id", "prefix")})
    return sorted((tuple(r) for r in join(table.repartition(3), **options).collect()), key=str)


def family(rng, size, words, edits, vocabulary):
    """A text and near copies of it."""
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(copy))
    return out


def corpus(seed, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = family(rng, 60, 120, 6, words) + family(rng, 25, 30, 2, words) + family(rng, 40, 300, 14, words)
    texts += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(50)]
    texts += [" ".join(rng.choice(words[:30]) for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + texts[:7]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("paired, sets, grams", [(16, 512, 1 << 18), (2, 8, 1500), (1, 512, 1 << 18)])
def test_components_of_a_corpus(spark, monkeypatch, paired, sets, grams):
    rows = corpus(paired)
    monkeypatch.setattr(ngramjoin, "BLOCK_SETS", sets)
    monkeypatch.setattr(ngramjoin, "BLOCK_GRAMS", grams)
    want = brute(rows)
    assert found(spark, rows, paired=paired) == want
    assert 40 < len({w[2] for w in want}) < len(rows) - 50


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one two"), (5, "ONE\ttwo "), (6, "one two three four"), (None, "one two"), (4, "one two"), (9, "é a b c d"), (10, "É a b c d")]
    rows += [(None, "only here no id"), (20, long), (21, long + " y z"), (22, long[: len(long) // 2]), (6, None), (30, "a\x00b c d e f g h"), (31, "a b c d e f g h"), (2, "")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_prefixes_and_filters_lose_no_link():
    rng = np.random.default_rng(4)
    frequency = rng.integers(1, 9, size=1 << ngramjoin.SKETCH_BITS)
    linked = 0
    for _ in range(400):
        n = int(rng.integers(1, 600 if linked % 2 else 60))
        a = np.unique(rng.integers(0, 1 << 63, size=n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 1 << 63, size=int(rng.integers(0, 1 + n // 15))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 85 * (len(a) + len(b) - common):
            continue
        linked += 1
        assert common >= max(least_common(len(a)), least_common(len(b)))
        assert len(np.intersect1d(prefix(a, frequency), prefix(b, frequency)))
        assert np.abs(range_counts(a) - range_counts(b)).sum() <= len(a) + len(b) - 2 * common <= most_different(len(a), len(b))
        assert least_different(outline(a), outline(b)) <= len(a) + len(b) - 2 * common
    assert linked > 100


def test_units_return_few_links_and_all_components():
    rng = random.Random(1)
    texts = family(rng, 90, 80, 4, [f"v{i}" for i in range(300)])
    sets = [*gram_sets(texts)]
    counts = common_counts(sets)
    assert all(counts[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(90) for b in range(a))
    links = unit_links([(0, 0, 0, i, i, len(s), s.tobytes()) for i, s in enumerate(sets)])
    near = [(a, b) for a in range(90) for b in range(a) if 100 * counts[a, b] >= 85 * (len(sets[a]) + len(sets[b]) - counts[a, b])]
    assert len(links) < 90 < len(near)

    def classes(edges):
        label = list(range(90))
        for a, b in edges:
            label = [label[b] if x == label[a] else x for x in label]
        return [label.index(x) for x in label]

    assert classes(links) == classes(near)
    assert unit_links([(0, 0, 0, i, 7, len(s), s.tobytes()) for i, s in enumerate(sets)]) == []
