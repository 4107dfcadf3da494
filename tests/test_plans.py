"""What plans must show: filters at the scan, few scans of the index, bounded files."""

import hashlib
import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from tracemill.functions import ordering
from tracemill.operators import decode, privacy
from tracemill.plans.queries import QUERIES
from tracemill.session import cut_lineage, drop_intermediates
from tracemill.sources import captures, sinks
from tracemill.sources.packets import with_leaves
from tracemill.sources.profiles import builtin_profiles

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def packets(spark, tmp_path):
    layers = '{"frame":{"frame.number":"1","frame.protocols":"eth:ip:dns"},"ip":{"ip.src":"10.0.0.1"},"dns":{"dns.id":"7"}}'
    spark.createDataFrame([("a", layers), ("b", layers)], "capture_id string, layers string").write.parquet(f"{tmp_path}/p")
    return spark.read.parquet(f"{tmp_path}/p")


def test_a_filter_on_the_capture_reaches_the_scan(packets):
    rows = decode.normalise(with_leaves(packets), builtin_profiles()["lte-core"])
    for df in (rows.where("capture_id = 'b'").select("packet_no"), rows.where("capture_id = 'b'")):
        assert re.search(r"PushedFilters: \[[^]]*EqualTo\(capture_id,b\)", plan(df))
        assert df.count() == 1
    end = F.expr("struct(src_ip as ip, cast(null as string) as hostname, 'x' as alias, 'y' as role, cast(null as string) as site, cast(map() as map<string,string>) as labels)")
    hidden = privacy.protect_packets(rows.withColumn("src", end).withColumn("dst", end), {"ip": "pseudonymize"}).where("capture_id = 'b'")
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(capture_id,b\)", plan(hidden)) and hidden.first().src.ip.startswith("IP_")


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize(("name", "most"), [("capture_meta", 1), ("anomaly_counts", 2), ("capture_summary", 4)])
def test_scans_of_the_index(spark, monkeypatch, name, most):
    seen = []
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (seen.append(plan(self._df)), plain(self, path, *a, **b))[1])
    seen.append(plan(QUERIES[name](spark, SF)))
    assert sum(len(re.findall(r"FileScan parquet.*events\.parquet", text)) for text in seen) <= most


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
def test_a_filter_on_the_transport_makes_the_field_map_once(spark):
    assert plan(QUERIES["transport_notes"](spark, SF)).count("map_from_entries(") == 1


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["packet_pseudonyms", "packet_leaks"])
def test_no_filter_makes_the_report_again(spark, name):
    assert not re.search(r"Filter \(*size\(", plan(QUERIES[name](spark, SF)))


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["event_refs", "flow_totals", "batch_overview"])
def test_packets_are_decoded_once(spark, monkeypatch, name):
    seen = []
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (seen.append(plan(self._df)), plain(self, path, *a, **b))[1])
    seen.append(plan(QUERIES[name](spark, SF)))
    assert sum(len(re.findall(r"ArrowEvalPython \[opened\(", text)) for text in seen) == 1


@pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="test tables are not here")
def test_phases_group_the_events_once(spark, monkeypatch):
    seen = []
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (seen.append(plan(self._df)), plain(self, path, *a, **b))[1])
    seen.append(plan(QUERIES["flow_phases"](spark, SF)))
    assert sum(len(re.findall(r"Aggregate\(keys?=\[capture_id#\d+, event_no#.*partial_", text)) for text in seen) == 1


@pytest.fixture
def trace(spark, tmp_path):
    kinds = "element_at(array('view', 'signup', 'click', 'error', 'purchase'), cast(id % 5 as int) + 1) as event_type"
    rows = spark.range(60).selectExpr(
        "id as event_id", "timestamp_micros(1704067200000000 + id * 1000) as ts", "id % 7 as user_id", kinds, "1.0D as value", "concat('{\"k\":', id, '}') as props"
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.fixture
def written(monkeypatch):
    """Plans and columns of all that is written as Parquet."""
    seen = []
    plain = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (seen.append((plan(self._df), self._df.columns)), plain(self, path, *a, **b))[1])
    return seen


def test_three_profiles_decode_the_packets_once(spark, trace, written):
    out = QUERIES["reduced_transport"](spark, trace)
    assert sum(text.count("ArrowEvalPython [opened(") for text in [*(text for text, _ in written), plan(out)]) == 1
    rows = out.collect()
    assert len(rows) == 3 * 4 and sum(r.packets for r in rows) == 3 * 60


def test_phases_write_what_they_read(spark, trace, written):
    assert {r.profile for r in QUERIES["access_phases"](spark, trace).collect()} == {"5g-n2", "vonr-ims-core"}
    assert [sorted(c) for _, c in written if "event_no" in c][0] == ["capture_id", "event_no", "message_name", "status"]
    assert not any({"src", "dst"} & {*c} for _, c in written)


def test_many_captures_make_few_files(spark, tmp_path):
    rows = spark.range(20000).selectExpr("concat('c', id % 10000) as capture_id", "id div 10000 as packet_no")
    sinks.write_detail(rows, f"{tmp_path}/detail", buckets=8)
    files = list(pathlib.Path(tmp_path, "detail").rglob("*.parquet"))
    assert 8 <= len(files) <= 8 * 4
    back = spark.read.parquet(f"{tmp_path}/detail")
    assert back.count() == 20000
    one = back.where((F.col("capture_id") == "c77") & (F.col(sinks.BUCKET) == sinks.bucket_of("capture_id", 8)))
    assert one.count() == 2


def test_sparse_orders_are_made_dense(spark):
    rows = spark.range(500).selectExpr("'k' as k", "id * 1000000007 as t", "id % 3 as v")
    dense = ordering.dense(rows, ["k"], "t", "n")
    got = ordering.running_sum(dense, ["k"], "n", {"s": F.col("v")}, block_rows=64).orderBy("t").collect()
    total = 0
    for row in got:
        total += row.v
        assert row.s == total
    assert dense.select((F.col("n") / 64).cast("int")).distinct().count() == 8


def test_intermediates_are_deleted(spark):
    folder = pathlib.Path(str(cut_lineage(spark.range(3)).inputFiles()[0]).removeprefix("file:")).parent.parent
    assert folder.exists()
    drop_intermediates()
    assert not folder.exists()


def test_digests_of_files_of_any_content(spark, tmp_path):
    rng = random.Random(2)
    held = {
        "empty": b"", "feed": b"\n", "feeds": b"\n\n\n", "plain": b"abc", "ended": b"abc\n", "windows": b"a\r\nb\r\n", "marked": b"\xef\xbb\xbfa\nb", "marked2": b"\xef\xbb\xbfab\n",
        "three": b"a\nbcd", "wide": bytes(300_000), "noise": rng.randbytes(3 << 20), "noise2": rng.randbytes(1 << 20) + b"\n",
    }
    for name, content in held.items():
        (tmp_path / f"{name}.pcap").write_bytes(content)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = {r.capture_id: r.capture_sha256 for r in captures.capture_digests(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {name: hashlib.sha256(content).hexdigest() for name, content in held.items() if content}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_captures_are_replaced_and_a_failed_run_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/detail"
    rows = lambda names, n, note: spark.range(n).select(F.explode(F.array(*map(F.lit, names))).alias("capture_id"), F.col("id").alias("packet_no"), F.lit(note).alias("note"))
    table = lambda: sorted(tuple(r) for r in spark.read.parquet(path).groupBy("capture_id", "note").count().collect())
    files = lambda: sorted(re.sub("part-([0-9]+)-.*", r"\1", str(f.relative_to(path))) for f in pathlib.Path(path).rglob("part-*"))
    names = [f"c{i}" for i in range(20)]
    sinks.replace_captures(rows(names, 30, "first"), path, "packet_no", buckets=4)
    before = files()
    sinks.replace_captures(rows(names, 30, "again"), path, "packet_no", buckets=4)
    assert files() == before and table() == sorted((n, "again", 30) for n in names)
    sinks.replace_captures(rows(["c3", "new"], 7, "third"), path, "packet_no", buckets=4)
    third = sorted([(n, "again", 30) for n in names if n != "c3"] + [("c3", "third", 7), ("new", "third", 7)])
    assert table() == third
    broken = rows(["c4"], 5, "bad").withColumn("note", F.when(F.col("packet_no") == 4, F.raise_error(F.lit("stop")).cast("string")).otherwise(F.col("note")))
    with pytest.raises(Exception, match="stop"):
        sinks.replace_captures(broken, path, "packet_no", buckets=4)
    assert table() == third
    every = spark.createDataFrame([(n,) for n in [*names, "new"] if n != "c5"], "capture_id string")
    sinks.replace_captures(rows(["c6"], 2, "last"), path, "packet_no", captures=every, buckets=4)
    assert table() == [("c5", "again", 30), ("c6", "last", 2)]
    written = sinks.runs(spark, path).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    assert sorted((r.n, r.rows) for r in written.collect()) == [(2, 14), (20, 2), (20, 600), (20, 600)]
