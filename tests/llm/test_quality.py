"""Quality scores: held-out accuracy, defined cases, and what the scores may not depend on."""

import random

import pytest

from tracemill.llm import quality
from tracemill.llm.queries import op1_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) + str(rng.randrange(30)) for _ in range(rng.randrange(20, 120)))
        bad = i % 3 == 0
        rows.append((i, text.replace(" ", " ### ") if bad else text))
        labels.append((i, int(not bad)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, rows[1][1]), (1, rows[1][1]), (1003, "x"), (1004, "é" * 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark, tables):
    documents, labels = tables
    scores = quality.score(documents, quality.learn(documents, labels)).collect()
    assert len(scores) == documents.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in scores if r["doc_id"] in truth and quality_fold(r["doc_id"]) == 0]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scores)
    by_id = {r["doc_id"]: r["score"] for r in scores}
    assert by_id[1000] == by_id[1001] == by_id[1002] == 0.0


def quality_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5


def test_held_out_labels_teach_nothing(spark, tables):
    documents, labels = tables
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert quality.learn(documents, labels) == quality.learn(documents, turned)


def test_labels_that_teach_nothing(spark, tables):
    documents, labels = tables
    assert quality.learn(documents, labels.limit(0)) == quality.Model()
    only_good = labels.where("quality = 1")
    scores = quality.score(documents, quality.learn(documents, only_good)).collect()
    assert {r["score"] for r in scores} == {0.0, 1.0}
    odd = labels.union(labels.selectExpr("doc_id", "1 - quality AS quality").where("doc_id < 30")).union(labels.selectExpr("CAST(NULL AS LONG) AS doc_id", "quality"))
    odd = odd.union(labels.selectExpr("doc_id", "CAST(NULL AS INT) AS quality")).union(labels.selectExpr("doc_id", "7 AS quality"))
    assert quality.learn(documents, odd) == quality.learn(documents, labels.where("doc_id >= 30"))


def test_kept_rows_and_empty_table(spark, tables):
    documents, labels = tables
    model = quality.learn(documents, labels)
    wide = documents.selectExpr("*", "1 AS score", "2 AS label")
    kept = quality.keep_good(wide, model)
    assert kept.columns == wide.columns
    good = quality.score(documents, model).where("predicted = 1").count()
    assert kept.count() == good
    assert quality.score(documents.limit(0), model).collect() == []


@pytest.mark.skipif(not __import__("pathlib").Path(SF).exists(), reason="test tables are not here")
def test_query_over_the_test_table(spark):
    scores = op1_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    rows = scores.where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
