"""The pipeline over a small table with planted cases, stage by stage against plain loops."""

import random

import pytest

import corpus_pipeline
from tracemill.llm import decontaminate, langid, packing
from test_packing import plain_boundaries

LANGUAGES = {"en": "the of and to in is that it was for on are with as this".split(), "de": "der die und das nicht ein zu mit sich auf für ist im dem auch".split()}


def words(rng, language, n):
    common = LANGUAGES[language]
    return [rng.choice(common) if rng.random() < 0.4 else rng.choice(common) + rng.choice(common) + rng.choice(common) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        language = rng.choice(["en", "de"])
        text = words(rng, language, rng.randrange(40, 200))
        bad = i % 6 == 0
        if bad:
            text = [w.upper() + "!!" for w in text]
        rows.append([i, " ".join(text), language, f"src{i % 3}", 0])
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    items = [" ".join(words(rng, "en", 40)) for _ in range(3)]
    good = [r for r in rows if r[0] % 6]
    for n, r in enumerate(good[:20]):  # exact and near copies
        text = r[1].split()
        if n % 2:
            text[len(text) // 2] = "changed"
        rows.append([300 + n, " ".join(text), r[2], r[3], 0])
    for n in range(5):
        rows.append([400 + n, " ".join([*words(rng, "en", 60), items[n % 3], *words(rng, "en", 30)]), "en", "x", 0])
    rows += [[500, None, None, None, None], [501, "", "en", None, 0], [502, "12 34 !! 56", None, "y", 0], [None, " ".join(words(rng, "en", 90)), None, "z", 0]]
    out = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    kept = [docs.collect()]
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = spark.createDataFrame(stage(spark, current, folder).collect(), docs.schema)
        assert current.columns == docs.columns
        kept.append(current.collect())
    ids = [{r["doc_id"] for r in k} for k in kept]
    # Bad and empty texts go, good ones stay.
    assert not {i for i in range(0, 300, 6)} & ids[1] and {500, 501} & ids[1] == set()
    assert len({i for i in range(300) if i % 6} - ids[1]) <= 3
    assert 502 not in ids[2] and len(ids[1] - ids[2] - {502}) == 0
    for n in range(20):
        first = [i for i in range(300) if i % 6][n]
        if first in ids[2] and 300 + n in ids[2]:
            assert first in ids[3] and 300 + n not in ids[3]
    texts = {r["doc_id"]: r["text"] for r in kept[3]}
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {i for i, t in texts.items() if any(decontaminate.normal(item) in decontaminate.normal(t) for item in items)}
    assert hit and ids[3] - ids[4] == hit
    last = corpus_pipeline.packed(spark, current, folder).collect()
    assert sorted(str(r["doc_id"]) for r in last) == sorted(str(r["doc_id"]) for r in kept[4])
    lengths = sorted(r["n_tokens"] for r in last)
    assert sorted({r["padded_length"] for r in last}) == plain_boundaries(lengths, packing.BUCKETS)


def test_run_equals_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((d := stage(spark, docs, folder)).collect(), d.schema)
    key = lambda rows: sorted(map(str, rows))
    assert key(got.collect()) == key(docs.collect())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_extra_columns_with_clashing_names_pass(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'k' AS key", "1 AS root", "2 AS label", "3 AS score")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_language_threshold_keeps_documents_of_learned_languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300 AND doc_id % 6 != 0")
    assert langid.keep_identified(docs, langid.learn(docs)).count() == docs.count()
