"""Full packets: leaves, decoding, labels."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.functions import labels
from tracemill.operators import decode
from tracemill.sources import packets as ps
from tracemill.sources.profiles import Profile, builtin_profiles


def frame(no, stack, **layers):
    head = {"frame.number": str(no), "frame.time_epoch": f"1712390{no:03d}.5", "frame.time_relative": f"{no}.25", "frame.protocols": stack}
    return {"frame": head, "ip": {"ip.src": "10.0.0.1", "ip.dst": "10.0.0.2"}, **layers}


def opened(spark, *layers):
    df = spark.createDataFrame([("c", x if isinstance(x, str) else json.dumps(x)) for x in layers], "capture_id string, layers string")
    return ps.with_leaves(df)


def fields(spark, profile, *layers):
    rows = decode.normalise(opened(spark, *layers), profile).select("packet_no", decode.field_map().alias("m")).collect()
    return {r.packet_no: r.m for r in rows}


def test_leaves_of_awkward_json(spark):
    text = '{"a":{"a.k":"v","a.k":"w","a.s":"[1,2]","a.q":"x\\"y\\\\z","a.n":12,"a.b":true,"a.z":null,"a.e":{},"a.l":[{"i":"1"},{"i":"2"}]},"flat.x":"1"}'
    got = {(r.path, r.value, r.in_list, r.is_text) for r in ps.leaf_table(opened(spark, text)).collect()}
    assert got == {
        ("a.a.k", "v", True, True), ("a.a.k", "w", True, True), ("a.a.s", "[1,2]", False, True), ("a.a.q", 'x"y\\z', False, True),
        ("a.a.n", "12", False, False), ("a.a.b", "true", False, False), ("a.a.l.i", "1", False, True), ("a.a.l.i", "2", False, True),
        ("flat.x", "1", False, True),
    }


def test_field_lookup(spark):
    text = {"ip": {"ip.src": "nested", "ip.opt": ["1", "2"], "ip.one": ["only"]}, "ip.src": "flat"}
    row = opened(spark, text).select(*[F.expr(decode.field(n)).alias(n.split(".")[1]) for n in ("ip.src", "ip.opt", "ip.one", "ip.none")]).first()
    assert tuple(row) == ("flat", '["1","2"]', "only", None)


def test_transport_precedence_and_notes(spark):
    rows = decode.normalise(opened(
        spark,
        frame(1, "eth:ip:sctp", sctp={"sctp.srcport": "1", "sctp.dstport": "2", "sctp.assoc_index": "0", "sctp.chunk_type": ["0", "3"]}, tcp={"tcp.srcport": "9"}),
        frame(2, "eth:ip:tcp", tcp={"tcp.srcport": "80", "tcp.dstport": "bad", "tcp.stream": "4", "tcp.analysis.retransmission": "1", "tcp.analysis.out_of_order": "1"}),
        frame(3, "eth:ip:udp", udp={"udp.srcport": "53"}, **{"sctp.analysis": "x"}),
        {"frame": {"frame.number": "x"}, "ipv6": {"ipv6.src": "::1"}},
        frame(5, "eth:ip:udp", ip={"ip.src": ["1.1.1.1", "2.2.2.2"]}),
    ), builtin_profiles()["lte-core"]).collect()
    got = {r.packet_no: r for r in rows}
    assert got[1].transport.proto == "sctp" and got[1].anomalies == ["chunks=['0', '3']"] and not got[1].transport.anomaly
    assert got[2].transport.notes == ["retransmission", "out_of_order"] and got[2].transport.anomaly and got[2].transport.dst_port is None
    assert got[3].transport.proto == "udp" and got[3].transport.src_port == 53
    assert got[0].transport.proto == "ip" and got[0].src_ip == "::1" and got[0].time_epoch == ""
    assert not got[5].is_valid and got[1].is_valid


def test_retained_fields(spark):
    lte = builtin_profiles()["lte-core"]
    nas = {"nas_eps.emm.message_type": "0x41", "nas_eps.emm.cause": "11", "_ws.expert": {"x": "1"}, "one": ["single"]}
    attach = frame(7, "eth:ip:nas-eps", **{"nas-eps": nas})
    assert fields(spark, lte, attach) == {7: {"nas_eps.emm.message_type": "0x41", "nas_eps.emm.cause": "11", "one": "single"}}
    two = json.dumps(frame(8, "eth:ip:dns"))[:-1] + ', "dns": {"dns.id": "1"}, "dns": {"dns.id": "2"}}'
    assert fields(spark, lte, two) == {8: {}}
    named = Profile("own", ["dns"], ["dns"], fields={"dns": ["ip.src", "flat.dns"]})
    assert fields(spark, named, frame(9, "ip:dns", dns={"dns.id": "5"}, **{"flat.dns": "f"})) == {9: {"ip.src": "10.0.0.1", "dns.id": "5", "flat.dns": "f"}}

    rule = builtin_profiles()["2g3g-ss7-geran"]
    flat = frame(10, "ip:sctp:m3ua:gsm_map", **{"gsm_map.a": "1", "gsm_map": {"gsm_map.a": "2", "gsm_map.b": "3"}, "e212.imsi": "7", "sctp.x": "9", "isup.cic": "4"})
    assert fields(spark, rule, flat) == {10: {"gsm_map.a": "1", "gsm_map.b": "3", "e212.imsi": "7"}}
    assert rule.fields["tcp"] == [] and rule.fields["isup"] == ["isup.*", "e164.called_party_number.digits", "e164.calling_party_number.digits"]
    assert builtin_profiles({"lte-dns": {"dns": ["dns.id"]}})["lte-dns"].fields["dns"] == ["dns.id"]


def test_verbatim_diameter(spark):
    tree = {"diameter.avp": "raw", "diameter.Session-Id": "s1", "deep": {"diameter.Session-Id": "s2", "other": "o", "diameter.vendor_tree": {"diameter.Vendor-Id": "3"}}}
    message = {"diameter.cmd.code": "316", "diameter.avp": ["a", "b"], "diameter.avp_tree": tree, "_ws.m": "x"}
    want = {"diameter.cmd.code": "316", "diameter.Session-Id": '["s1","s2"]', "diameter.Vendor-Id": "3"}
    s6a = builtin_profiles()["lte-s6a"]
    assert fields(spark, s6a, frame(1, "ip:sctp:diameter", diameter=message)) == {1: want}
    s6a.keep_raw_avps = True
    kept = fields(spark, s6a, frame(1, "ip:sctp:diameter", diameter=message))[1]
    assert kept["diameter.avp"] == '["a","b","raw"]' and kept["diameter.avp_tree.deep.other"] == "o"


def test_deep_search_prefers_outer_containers(spark):
    text = {"x": {"c": {"k": "inner"}, "k": "outer", "l": ["k"]}, "y": {"k2": ["1", "2"], "d": {"k2": "scalar"}}}
    row = opened(spark, text).selectExpr(f"{decode.deep_field(['k'])} as a", f"{decode.deep_field(['k2'])} as b", f"{decode.deep_field(['no'])} as c").first()
    assert tuple(row) == ("outer", "scalar", None)


MESSAGES = [
    ({"diameter.cmd.code": "316", "diameter.flags.request": "1"}, "Update-Location Request (316)", "request"),
    ({"diameter.cmd.code": "0x110", "diameter.flags.request": "False", "diameter.Result-Code": "5030"}, "Credit-Control Answer (272) · Result 5030", "error"),
    ({"diameter.cmd.code": "999"}, "Diameter Command 999", "request"),
    ({"message_name": "Hello Answer", "diameter.Result-Code": "2001"}, "Hello Answer · Result 2001", "response"),
    ({"http2.headers.status": "404"}, "HTTP 404 Not Found", "error"),
    ({"http2.headers.status": "299"}, "HTTP 299", "request"),
    ({"http2.headers.method": "GET", "http2.headers.path": "/x"}, "GET /x", "request"),
    ({"http2.headers.path": "/y"}, "/y", "request"),
    ({"gtpv2.message_type": "33", "Cause: x": {"gtpv2.cause": "73"}}, "Create Session Response (33) · Cause 73 (No resources available)", "error"),
    ({"gtpv2.message_type": "33", "gtpv2.cause": "17"}, "Create Session Response (33) · Cause 17", "response"),
    ({"gtpv2.message_type": "32", "gtpv2.cause": "16"}, "Create Session Request (32)", "request"),
    ({"gtpv2.message_type": "250"}, "GTPv2 Message 250", "request"),
    ({"nas_eps.message_type": "0x44"}, "Attach Reject", "error"),
    ({"t": {"nas_5gs.mm.message_type": "0x41"}}, "Registration Request", "request"),
    ({"t": {"nas_5gs.sm.message_type": "0x01"}}, "NAS-5GS 0x01", "request"),
    ({"t": {"ngap.procedureCode": "46"}}, "TraceFailureIndication (46)", "error"),
    ({"ngap.procedureCode": "77"}, "NGAP Procedure 77", "request"),
    ({"pfcp.message_type": "50"}, "50", "request"),
    ({"dns.qry.name": "a.b.", "dns.qry.type": "28", "dns.flags.response": "0"}, "DNS AAAA a.b", "request"),
    ({"dns.qry.name": "a.b", "dns.qry.type": "77", "dns.flags.response": "1", "dns.flags.rcode": "99"}, "DNS TYPE77 a.b · rcode 99", "error"),
    ({"dns.qry.name": "a.b", "dns.flags.response": "1", "dns.flags.rcode": "0", "dns.count.answers": "2"}, "DNS  a.b · NOERROR (2 ans)", "response"),
    ({}, "SIP", "request"),
]


def test_message_labels(spark):
    layers = [frame(i, "eth:ip:udp:sip:weird", app=m) for i, (m, _, _) in enumerate(MESSAGES, start=1)]
    profile = Profile("p", ["app"], ["app"])
    rows = decode.normalise(opened(spark, *[{**x, "app": x["app"] or {"nothing": "1"}} for x in layers]), profile)
    got = {r.packet_no: (r.message_name, r.status) for r in labels.with_labels(labels.with_message_fields(rows)).collect()}
    for i, (_, name, status) in enumerate(MESSAGES, start=1):
        assert got[i] == (name, status), i


def test_names_and_phases(spark):
    df = spark.createDataFrame(
        [("Update Request", "request"), ("Update Answer ", "response"), ("Attach Request (5)", "request"), ("x resp", "request"), ("Setup Complete", "request")],
        "message_name string, status string",
    )
    rows = df.selectExpr(f"{labels.base_name()} as b", f"{labels.is_response()} as r", f"{labels.phase('lte')}.kind as k", f"{labels.phase('generic')}.kind as g").collect()
    assert [r.b for r in rows] == ["update", "update", "attach request (5)", "x", "setup complete"]
    assert [r.r for r in rows] == [False, True, False, False, True]
    assert rows[2].k == "registration" and rows[2].g == "registration"
    assert labels.profile_family("vonr-ims-core") == "ims" and labels.profile_family("volte-sip") == "generic" and labels.profile_family("5g-n2") == "5g"


@pytest.mark.parametrize("array", [True, False])
def test_read_packet_files(spark, tmp_path, array):
    packets = [{"_source": {"layers": frame(i, "ip:dns", dns={"dns.id": str(i)})}} for i in (1, 2)]
    text = json.dumps(packets) if array else "\n".join(json.dumps(p) for p in packets)
    (tmp_path / "cap.json").write_text(text)
    packets, rejects = ps.read_packets(spark, str(tmp_path), json_array=array)
    assert rejects.count() == 0 and sorted(r.frame_no for r in packets.collect()) == [1, 2]
    df = ps.with_leaves(packets)
    got = sorted((r.capture_id, r.n) for r in df.selectExpr("capture_id", f"{decode.field('frame.number')} as n").collect())
    assert got == [("cap", "1"), ("cap", "2")]


def test_out_of_range_numbers_become_null(spark):
    rows = decode.normalise(opened(
        spark,
        frame(1, "eth:ip:tcp:app", tcp={"tcp.srcport": "99999999999", "tcp.dstport": "1"}, app={"gtpv2.message_type": "1e40", "diameter.cmd.code": "9" * 30}),
    ), Profile("p", ["app"], ["app"]))
    (row,) = labels.with_labels(labels.with_message_fields(rows)).select("transport.src_port", "transport.dst_port", "message_name").collect()
    assert tuple(row) == (None, 1, "APP")
    times = spark.createDataFrame([("9" * 30,), ("1712390000.5",), ("x",)], "t string").selectExpr(f"{labels.epoch_time('t')} as e").collect()
    assert times[0].e is None and times[1].e is not None and times[2].e is None


def test_several_values_are_no_number(spark):
    layers = [frame(1, "eth:ip:udp:app", app={"gtpv2.message_type": ["32", "33"]}), frame(2, "eth:ip:udp:app", app={"gtpv2.message_type": "0x00000000000000000021"})]
    rows = decode.normalise(opened(spark, *layers), Profile("p", ["app"], ["app"]))
    got = {r.packet_no: r.message_name for r in labels.with_labels(labels.with_message_fields(rows)).collect()}
    assert got == {1: "APP", 2: "Create Session Response (33)"}


def test_broken_trees_are_malformed(spark):
    rows = decode.normalise(opened(spark, frame(1, "eth:ip:dns", dns={"dns.id": "1"}), '{"frame":', "[1]"), builtin_profiles()["lte-core"])
    assert sorted(r.is_valid for r in rows.collect()) == [False, False, True]
    assert decode.dropped_packets(rows).first().dropped_packets == 2


def test_leaves_and_maps_are_made_a_few_packets_at_a_time(monkeypatch):
    texts = [None if n % 7 == 3 else '{"a":' if n % 7 == 5 else f'{{"x":{{"a":"{n}","b":[{n},null,true,{{"c":"d"}}],"a":"again"}},"y":1.50}}' for n in range(1500)]
    seen = {ps: [], decode: []}
    for module, name in ((ps, "_leaf_step"), (decode, "_map_step")):
        step = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, step=step, sizes=seen[module]: (sizes.append(len(rows)), step(rows))[1])
    leaves = ps._leaf_array(pa.array(texts))
    maps = decode._maps(leaves.slice(1)).to_pylist()
    assert all(max(sizes) <= ps.STEP_ROWS and len(sizes) > 2 for sizes in seen.values())
    rows = leaves.to_pylist()
    assert len(rows) == 1500 and [r is None for r in rows] == [n % 7 in (3, 5) for n in range(1500)]
    assert [(x["pos"], x["path"], x["value"], x["is_text"]) for x in rows[1000]] == [
        ([0, 0], "x.a", "1000", True), ([0, 1, 0], "x.b", "1000", False), ([0, 1, 2], "x.b", "true", False), ([0, 1, 3, 0], "x.b.c", "d", True),
        ([0, 2], "x.a", "again", True), ([1], "y", "1.50", False),
    ]
    assert maps[999] == [("x.a", '["1000","again"]'), ("x.b", '["1000","true"]'), ("x.b.c", "d"), ("y", "1.50")] and maps[2] == []
    assert len(ps._leaf_array(pa.array([], pa.string()))) == len(decode._maps(leaves.slice(0, 0))) == 0


def test_leaves_of_equal_keys_share_their_places(monkeypatch):
    made, member = [], ps._Place.member
    monkeypatch.setattr(ps._Place, "member", lambda self, name, *more: (made.append(name), member(self, name, *more))[1])
    rows = ps._leaf_array(pa.array(['{"x":{"a":"1","b":[1,{"c":2}],"a":"1"},"y":{"a":"3"}}'] * 300)).to_pylist()
    assert made == ["x", "a", "b", "c", "y", "a"]
    assert len(rows) == 300 and all(r == rows[0] for r in rows)
    assert [(x["pos"], x["path"], x["depth"], x["in_list"]) for x in rows[0]] == [
        ([0, 0], "x.a", 2, True), ([0, 1, 0], "x.b", 2, True), ([0, 1, 1, 0], "x.b.c", 3, False), ([0, 2], "x.a", 2, True), ([1, 0], "y.a", 2, False)
    ]
