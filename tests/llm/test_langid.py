"""The byte network: gradients against differences, held-out accuracy, defined cases."""

import dataclasses
import random

import numpy as np
import pytest

from tracemill.llm import langid
from tracemill.llm.queries import op6_language

SF = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = langid.fresh(("a", "b", "c"), hidden=3, seed=1)
    net = dataclasses.replace(net, **{n: getattr(net, n).astype(np.float64) for n in ("embed", "recur", "bias", "out", "out_bias")})
    segments = rng.integers(60, 130, (7, 5))
    segments[5:, 2] = langid.PAD
    target = np.array([0, 1, 2, 1, 0])
    _, grads = langid.gradients(net, segments, target)
    for name in ("embed", "recur", "bias", "out", "out_bias"):
        values, step = getattr(net, name), 1e-3
        flat = np.argsort(-np.abs(grads[name]).ravel())[:6]
        for place in flat:
            at = np.unravel_index(place, values.shape)
            kept = values[at]
            values[at] = kept + step
            more = langid.gradients(net, segments, target)[0]
            values[at] = kept - step
            less = langid.gradients(net, segments, target)[0]
            values[at] = kept
            assert grads[name][at] == pytest.approx((more - less) / (2 * step), rel=0.03, abs=1e-4)


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "ich"], "cc": ["ção", "nho", "ões", "que"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang) for i in range(240) for lang in [rng.choice(sorted(sounds))]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "12 ... !?", "bb"), (903, "ka lo mi", None), (None, "schein ung", "bb"), (4, rows[4][1], rows[4][2]), (904, "ka" * 40000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_defined_cases(spark, documents):
    found = langid.identify(documents.selectExpr("*", "1 AS score", "2 AS lang_pred"), langid.learn(documents)).collect()
    assert len(found) == documents.count()
    truth = {r["doc_id"]: r["lang"] for r in documents.where("crc32(CAST(doc_id AS STRING)) % 5 = 0 AND lang IS NOT NULL AND doc_id < 900").collect()}
    held = [r for r in found if r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert by_id[900] == by_id[901] == by_id[902] == (langid.UNKNOWN, 0.0)
    assert by_id[903][0] == by_id[904][0] == "aa" and all(0 <= r["score"] <= 1 for r in found)


def test_held_out_languages_teach_nothing(spark, documents):
    hidden = documents.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    one, other = langid.learn(documents), langid.learn(hidden)
    assert one.languages == other.languages and (one.embed == other.embed).all()


def test_few_languages_and_empty_tables(spark, documents):
    none = langid.identify(documents, langid.learn(documents.limit(0))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {(langid.UNKNOWN, 0.0)}
    single = langid.identify(documents, langid.learn(documents.where("lang = 'aa'"))).collect()
    assert {r["lang_pred"] for r in single} == {"aa", langid.UNKNOWN}
    assert langid.identify(documents.limit(0), langid.learn(documents)).collect() == []


def test_labels_do_not_depend_on_the_batch():
    net = langid.fresh(("a", "b"), seed=3)
    texts = ["abc def " * 30, "xyz", "", None, "mnop " * 2000]
    together = langid.predict(net, texts)
    for text, (lang, score) in zip(texts, together, strict=True):
        ((alone, other),) = langid.predict(net, [text])
        assert alone == lang and other == pytest.approx(score, abs=1e-5)


@pytest.mark.skipif(not __import__("pathlib").Path(SF).exists(), reason="test tables are not here")
def test_query_over_the_test_table(spark):
    rows = op6_language(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("lang IS NOT NULL AND text IS NOT NULL").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.95
