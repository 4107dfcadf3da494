"""The registered queries over the smallest tables: contracts, and SQL where there is some."""

import pathlib

import pytest

from compare import compare, duck
from tracemill.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
COLUMNS = {
    "op1_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_neardup": {"doc_id": "bigint", "class_id": "bigint"},
    "op3_langmodel": {
        "doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double",
    },
    "op4_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op5_htmltext": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_sharding": {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int",
    },
    "op11_hardnegatives": {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint",
    },
    "op12_conversations": {
        "conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint",
        "audit": "string", "repaired_sha256": "string",
    },
    "op13_ngramjoin": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
}
PER_DOCUMENT = ("op1_quality", "op2_neardup", "op3_langmodel", "op6_language", "op7_packing", "op10_sharding", "op13_ngramjoin")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    rows = QUERIES[name](spark, SF)
    kinds = dict(rows.dtypes)
    assert {c: kinds[c] for c in COLUMNS.get(name, {})} == COLUMNS.get(name, {})
    count = rows.count()
    if name in PER_DOCUMENT:
        assert count == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ("op4_warc", "op5_htmltext"):
        assert count == spark.read.parquet(f"{SF}/pages.parquet").count()
    if name in ORACLE:
        problem, _ = compare(spark, duck(SF), QUERIES[name], ORACLE[name], SF)
        assert problem is None, problem
