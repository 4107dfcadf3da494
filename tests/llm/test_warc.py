"""Archives: exact round trip, and what the reader must refuse."""

import struct

import pytest
import zstandard

from tracemill.llm import warc

PAGES = [(i, f"http://h.example/{i}?q=a b", f"<p>{'text ' * (i % 7)}{i % 40}</p>" * (i % 5)) for i in range(300)]
PAGES += [(300, None, None), (301, "", ""), (302, "ü", "ß€𝄞" * 1000), (None, "n", "<p>only here</p>"), (5, "again", PAGES[5][2]), (303, "long", "z" * 3_000_000)]


def expected(least=0):
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        head = first.get(html or "")
        revisit = len(payload) >= least and head is not None and page_id != head
        out.append((page_id, len(payload), warc.digest(payload), "revisit" if revisit else "response", head if revisit else None, None if revisit else payload))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS first", "2 AS path")
    return spark.createDataFrame(warc.write_archives(pages.repartition(3)).collect(), "path string, content binary")


def test_round_trip(spark, archives, monkeypatch):
    rows = warc.read_archives(archives).collect()
    assert {r["problem"] for r in rows} == {None}
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=repr) == expected()


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, least_bytes=60), payloads=False).collect()
    assert sorted([(r["page_id"], r["record_type"], r["refers_to"]) for r in rows], key=repr) == sorted([(e[0], e[3], e[4]) for e in expected(60)], key=repr)


def test_layout(archives):
    content = bytes(archives.first()["content"])
    magic, length = struct.unpack_from("<II", content)
    assert magic == warc.SKIPPABLE
    held = zstandard.ZstdDecompressor().decompress(content[8 : 8 + length])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    end = warc.frame_end(memoryview(content), 8 + length)
    assert reader.decompressobj().decompress(content[8 + length : end]).startswith(b"WARC/1.1\r\n")
    assert all(warc.parse_record(r) for r in warc.archive_records(content))


def test_archives_without_dictionary_and_with_an_uncompressed_one():
    record = warc.make_record(1, "u", b"abc", None, False)
    plain = zstandard.ZstdCompressor().compress(record)
    assert list(warc.archive_records(plain + plain)) == [record, record]
    raw = zstandard.train_dictionary(2048, [record + bytes([i % 250]) * 9 for i in range(400)]).as_bytes()
    framed = struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw + zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)).compress(record)
    assert list(warc.archive_records(framed)) == [record]
    assert list(warc.archive_records(b"")) == []


def test_tables_without_rows(spark):
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert warc.read_archives(spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary")).collect() == []


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (lambda r: r.replace(b"WARC/1.1", b"WORC/1.1"), "version"),
        (lambda r: r.replace(b"WARC-Date: ", b"WARC-Dite: "), "warc-date is missing"),
        (lambda r: r.replace(b"\r\nWARC-Type: ", b"\r\nWARC-Type: x"), "unknown type"),
        (lambda r: r.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1), "Content-Length"),
        (lambda r: r.replace(b"abc", b"abd"), "digest"),
        (lambda r: r.replace(b"abc", b"abcd"), "Content-Length"),
        (lambda r: r[:-2], "Content-Length"),
        (lambda r: r.replace(b"WARC-Type", b"bad header\r\nWARC-Type"), "no name"),
        (lambda r: r[:40], "do not end"),
    ],
)
def test_broken_records_are_reported(spark, change, problem):
    record = warc.make_record(1, "u", b"abc", None, False)
    pack = zstandard.ZstdCompressor().compress
    rows = warc.read_archives(spark.createDataFrame([("a", pack(record) + pack(change(record)) + pack(record))], "path string, content binary")).collect()
    assert [r["problem"] is None for r in rows] == [True, False, True] and problem in rows[1]["problem"]


def test_broken_archives_end_with_one_row(spark):
    content = zstandard.ZstdCompressor(write_checksum=True).compress(warc.make_record(1, "u", b"abc" * 100, None, False))
    for broken in (content + content[:-3], content + b"garbage", content + content[:7], content + struct.pack("<II", warc.SKIPPABLE, 99)):
        rows = warc.read_archives(spark.createDataFrame([("a", broken)], "path string, content binary")).collect()
        assert [r["problem"] is None for r in rows] == [True, False]


def test_a_common_payload_is_dealt_over_tasks(spark):
    rows = [(i, f"http://h.example/{i}", "" if i % 3 else f"<p>page {i}</p>") for i in range(600)]
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        got = warc.read_archives(warc.write_archives(pages)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["page_id"] for r in got) == list(range(600)) and all(r["problem"] is None for r in got)
    empty = [r for r in got if r["page_id"] % 3]
    assert sum(r["record_type"] == "response" for r in empty) == 1 and {r["refers_to"] for r in empty} == {None, 1}
    paths = [r["path"] for r in empty]
    assert max(map(paths.count, set(paths))) < 150
