"""From files to results, and the sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions.tables import INDEX_FIELDS, PRIVACY_PROFILES
from tracemill.operators import summary
from tracemill.operators.endpoints import Lookups
from tracemill.plans import analysis
from tracemill.sources import captures as files
from tracemill.sources import index as ix
from tracemill.sources import packets as ps
from tracemill.sources import sinks


def packet(no, src, dst, flags, hbh, code=None):
    diameter = {"diameter.cmd.code": "316", "diameter.flags": flags, "diameter.flags.request": "1" if flags == "0xc0" else "0",
                "diameter.hopbyhopid": hbh, "diameter.origin_host": "mme.example", "diameter.imsi": "001010123456789"}
    if code:
        diameter["diameter.Result-Code"] = code
    return {
        "frame": {"frame.number": str(no), "frame.time_epoch": f"17123900{no:02d}.5", "frame.time_relative": f"{no * 0.4:.1f}", "frame.protocols": "eth:ip:sctp:diameter"},
        "ip": {"ip.src": src, "ip.dst": dst}, "sctp": {"sctp.srcport": "3868", "sctp.dstport": "3868", "sctp.assoc_index": "0"}, "diameter": diameter,
    }


def index_line(p):
    named = {**p["frame"], **p["ip"], **p["sctp"], "diameter.flags": p["diameter"]["diameter.flags"], "diameter.cmd.code": "316",
             "diameter.hopbyhopid": p["diameter"]["diameter.hopbyhopid"], "diameter.result_code": p["diameter"].get("diameter.Result-Code", "")}
    return "|".join(named.get(f, "") for f in INDEX_FIELDS)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "index").mkdir()
    (folder / "full").mkdir()
    a, b = "10.0.0.1", "10.0.0.2"
    one = [packet(1, a, b, "0xc0", "5"), packet(2, b, a, "0x40", "5", "2001"), packet(3, a, b, "0xc0", "6"), packet(4, a, b, "0xc0", "7"),
           packet(5, b, a, "0x40", "7", "5012"), packet(6, a, b, "0xc0", "8")]
    two = [packet(1, a, b, "0xc0", "1")]
    for name, items in (("one", one), ("two", two)):
        (folder / "index" / f"{name}.txt").write_text("\n".join(map(index_line, items)))
        (folder / "full" / f"{name}.json").write_text("\n".join(json.dumps({"_source": {"layers": p}}) for p in items))
    index, rejects = ix.read_index(spark, str(folder / "index"))
    assert rejects.count() == 0
    packets, bad = ps.read_packets(spark, str(folder / "full"))
    assert bad.count() == 0
    return index, packets


def options(spark, **more):
    hosts = spark.createDataFrame([(0, "10.0.0.1", "mme-west")], "ord bigint, ip string, hostname string")
    return analysis.Options(lookups=Lookups(hosts=hosts), **more)


def test_analyze(spark, inputs, tmp_path):
    index, packets = inputs
    modes = {**PRIVACY_PROFILES["share"], "payload_text": "keep"}
    out = analysis.analyze(index, packets, options(spark, modes=modes, max_packets=5))
    detail = {(r.capture_id, r.packet_no): r for r in out["detail"].collect()}
    assert len(detail) == 6
    first = detail["one", 1]
    values = {l.path: l.value for l in first.fields}
    # the path part imsi wins; the expected alias is the published one of this value
    assert values["diameter.imsi"] == "IMSI_da49ae5e" and values["diameter.origin_host"].startswith("DIAMETER_IDENTITY_")
    assert first.src.ip.startswith("IP_") and first.src.hostname.startswith("HOSTNAME_")
    assert first.src.role == "diameter" and first.src.labels["network_element_type"] == "MME"
    row = {r.capture_id: r for r in out["summary"].collect()}["one"]
    assert row.coverage.detail_packets_included == 5 and row.coverage.detail_truncated
    assert row.packet_message_counts.total_packets == 6 and row.packet_message_counts.top_protocols == {"diameter": 5}
    assert row.anomaly_counts_by_layer == {"diameter": 3} and row.timing_stats.packet_count == 5
    assert row.deterministic_findings == [
        "3 anomalies detected (diameter: 3)", "diameter accounts for 5 normalized packets", "1 burst period(s) detected (≥5 packets within 1 s)"]
    events = {(r.capture_id, r.event_no): r for r in out["flow_events"].collect()}
    assert events["one", 1].paired_event_id == "event-2" and events["one", 2].status == "response"
    # packets 3 and 4 look alike and become one event; the failed answer belongs to neither by name
    assert events["one", 3].repeat_count == 2 and events["one", 3].detail_label == "pkt 3..4"
    assert events["one", 3].paired_event_id is None and events["one", 4].status == "error"
    assert {(r.event_no, r.packet_no) for r in out["flow_refs"].where("capture_id = 'one'").collect()} == {(1, 1), (2, 2), (3, 3), (3, 4), (4, 5)}
    assert {r.kind for r in out["flow_phases"].where("capture_id = 'one'").collect()} == {"signaling", "failure"}
    assert out["flow_nodes"].where("capture_id = 'one'").count() == 2
    audit = {r.data_class: r.originals for r in out["privacy_audit"].collect()}
    assert audit["imsi"] == 1
    assert row.privacy_audit["imsi"] == 1 and row.dropped_packets is None
    assert {c.src[:3] for c in row.conversations} == {"IP_"}
    names = {(r.data_class, r.original): r.alias for r in out["pseudonyms"].collect()}
    assert names["ip", "10.0.0.1"] == first.src.ip and names["hostname", "mme-west"] == first.src.hostname
    assert not [r for r in out["leaks"].collect() if r.data_class in ("ip", "hostname", "imsi")]
    assert not any("10.0.0." in str(r) for name in ("detail", "summary", "anomalies", "flow_events", "flow_nodes") for r in out[name].collect())
    assert {r.code for r in out["warnings"].where("capture_id = 'one'").collect()} == {"detail_truncated"}

    whole = summary.complete(
        out["summary"], files=spark.createDataFrame([("one", "/x/one.pcap")], "capture_id string, path string"),
        versions=spark.createDataFrame([("one", "2")], "capture_id string, version string"), start_packet=1, end_packet=5,
    )
    one = {r.capture_id: r for r in whole.collect()}["one"]
    assert one.run.action == "analyze" and one.capture.filename == "one.pcap" and one.capture.first_packet_number == 1 and one.artifact.version == "2"
    assert one.capture_sha256 is None and one.selection.end_packet_number == 5 and one.detail_truncated.included == 5
    assert one.probable_notable_findings == one.deterministic_findings and "network_address" in one.privacy_policy.canonical_classes
    text = summary.handoff(out["summary"], summary.excerpt(out["flow_events"].select("capture_id", F.col("event_no").alias("packet_no"), "message_name"), 2), modes)
    given = {r.capture_id: r for r in text.collect()}["one"]
    assert "10.0.0." not in given.summary and given.included_messages == 2 and set(json.loads(given.summary)) <= set(summary.HANDOFF_FIELDS)

    sinks.write_detail(out["detail"], str(tmp_path / "detail"))
    assert spark.read.parquet(str(tmp_path / "detail")).where("capture_id = 'one' and schema_version = '1.0'").count() == 5
    sinks.write_summary(out["summary"], str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 2
    assert sinks.write_pseudonyms(out["pseudonyms"], str(tmp_path / "names"))
    sinks.write_tables({"events": out["flow_events"], "nodes": out["flow_nodes"]}, str(tmp_path / "flow"))
    assert spark.read.parquet(str(tmp_path / "flow" / "events")).count() == len(events)


def test_guards(spark, inputs):
    index, packets = inputs
    with pytest.raises(ValueError, match="above the packet limit"):
        analysis.analyze(index, packets, options(spark, max_packets=2, oversize_factor=2))
    with pytest.raises(ValueError, match="truncated"):
        analysis.analyze(index, packets, options(spark, max_packets=3, fail_on_truncation=True))
    with pytest.raises(ValueError, match="key"):
        analysis.analyze(index, packets, options(spark, modes={"ip": "encrypt"}))
    with pytest.raises(ValueError, match="key"):
        analysis.analyze(index, packets, options(spark, modes={"ip": "encrypt"}, key=F.lit("too short")))


def test_leaks_cover_addresses_that_stay(spark, inputs):
    index, packets = inputs
    leaks = analysis.analyze(index, packets, options(spark, modes=PRIVACY_PROFILES["internal"]))["leaks"]
    found = {r.data_class for r in leaks.where("capture_id = 'one'").collect()}
    assert "ip" in found and "hostname" in found


def test_identity_and_rejects(spark, tmp_path):
    line = json.dumps({"_source": {"layers": packet(1, "10.0.0.1", "10.0.0.2", "0xc0", "5")}})
    for folder in ("a", "b"):
        (tmp_path / "full" / folder).mkdir(parents=True)
        (tmp_path / "full" / folder / "cap.json").write_text(f"{line}\n{{broken\n\n")
        (tmp_path / "index" / folder).mkdir(parents=True)
        (tmp_path / "index" / folder / "cap.txt").write_text(index_line(packet(1, "10.0.0.1", "10.0.0.2", "0xc0", "5")))
    packets, bad = ps.read_packets(spark, f"{tmp_path}/full/*")
    assert sorted((r.capture_id, r.frame_no) for r in packets.collect()) == [("a/cap", 1), ("b/cap", 1)]
    assert sorted((r.capture_id, r.record) for r in bad.collect()) == [("a/cap", "{broken"), ("b/cap", "{broken")]
    assert {(r.capture_id, r.kept, r.rejected) for r in ps.reject_counts(packets, bad).collect()} == {("a/cap", 1, 1), ("b/cap", 1, 1)}
    index, _ = ix.read_index(spark, f"{tmp_path}/index/*/cap.txt")
    assert sorted(r.capture_id for r in index.collect()) == ["a/cap", "b/cap"]
    only, _ = ix.read_index(spark, f"{tmp_path}/index/a/cap.txt")
    assert [r.capture_id for r in only.collect()] == ["cap"]
    out = analysis.analyze(index, packets, options(spark))
    assert out["detail"].count() == 2


def test_inspect_and_discover(spark, inputs):
    index, _ = inputs
    found = analysis.inspect(index, options(spark))
    meta = {r.capture_id: r for r in found["meta"].collect()}
    assert meta["one"].packet_count == 6 and meta["one"].relevant_protocols == ["diameter"]
    assert [r.name for r in found["peers"].where("capture_id = 'one'").collect()] == ["mme-west"]
    best = {r.capture_id: r.profile for r in found["best_profile"].collect()}
    assert best == {"one": "lte-s6a", "two": "lte-s6a"}
    assert {r.trace_shape for r in found["enrichment"].collect()} == {"single_domain"}
    broad = analysis.discover(index, options(spark))
    assert broad["top_protocols"].count() == 2 and broad["relevant"].count() > 0


def test_capture_files(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(b"abc")
    (tmp_path / "b.pcap").write_bytes(b"x" * (1 << 20) + b"y")
    digests = {r.capture_id: r.capture_sha256 for r in files.capture_digests(spark, str(tmp_path)).collect()}
    assert digests["a"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    sizes = files.capture_files(spark, str(tmp_path))
    assert [r.capture_id for r in files.too_large(sizes, 1).collect()] == ["b"] and files.too_large(sizes, 0).count() == 0


def test_artifact_names(spark):
    rows = [(" my capture (1)..", "1712390000.9", 4), ("a", "2024-04-06T07:53:20.123456789Z", 4), ("--", None, 7), ("x", "junk", None)]
    df = spark.createDataFrame(rows, "stem string, epoch string, first bigint")
    got = [r.p for r in df.selectExpr(f"{summary.artifact_prefix('analyze', 'stem', 'epoch', 'first')} as p").collect()]
    assert got == ["analyze_my_capture_1_20240406_075320", "analyze_a_20240406_075320", "analyze_capture_start_7", "analyze_x_start_unknown"]
    names = spark.createDataFrame([(n,) for n in ("a_V_01.json", "a_V_2_detail.json", "a_V_4.json", "b_V_2.json", "junk.json", "a_V_3.txt")], "name string")
    parsed = summary.parse_artifacts(names)
    assert {(r.artifact_prefix, r.next_version) for r in summary.next_versions(parsed).collect()} == {("a", 3), ("b", 1)}
