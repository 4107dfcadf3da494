"""Index rows, selection and anomaly detectors."""

import random

from tracemill.functions.tables import INDEX_FIELDS
from tracemill.operators import anomalies as an
from tracemill.operators import selection, stats
from tracemill.operators.classify import with_top_protocol
from tracemill.sources import index as ix
from tracemill.sources.profiles import builtin_profiles


def line(fields=INDEX_FIELDS, **values):
    named = {k.replace("__", "."): v for k, v in values.items()}
    return "|".join(str(named.get(f, "")) for f in fields)


def parse(spark, lines, fields=INDEX_FIELDS):
    df = spark.createDataFrame([("c", x) for x in lines], "capture_id string, value string")
    return ix.parse_index(df, fields)


def test_parse_rows(spark):
    base = dict(frame__number=7, frame__time_epoch="1.5", frame__protocols="eth::ip:sctp")
    good = [
        line(**base, ip__src="1.1.1.1", ipv6__src="::1", ipv6__dst="::2", sctp__srcport=10, sctp__dstport=20, tcp__srcport=1),
        line(**{**base, "frame__number": 8}, tcp__srcport="x", tcp__dstport=2, tcp__stream=4, tcp__analysis__retransmission=1),
        line(**{**base, "frame__number": 9}, udp__srcport=5, udp__dstport="y") + "|extra|columns",
    ]
    bad = ["", "7|short", line(**{**base, "frame__number": "no"})]
    parsed = parse(spark, good + bad)
    rows = {r.frame_no: r for r in ix.keep_valid(parsed).collect()}
    assert sorted(rows) == [7, 8, 9]
    assert rows[7].src_ip == "1.1.1.1" and rows[7].dst_ip == "::2" and rows[7].protocols == ["eth", "ip", "sctp"]
    assert (rows[7].transport, rows[7].src_port, rows[7].dst_port) == ("sctp", 10, 20)
    assert (rows[8].transport, rows[8].src_port, rows[8].dst_port, rows[8].stream, rows[8].tcp_retransmission) == ("tcp", None, None, "4", True)
    assert (rows[9].src_port, rows[9].dst_port) == (5, None)
    assert parsed.where("not is_valid").count() == 3


def test_spelling_priority_and_missing_columns(spark):
    fields = [f for f in INDEX_FIELDS if f not in ("diameter.hop_by_hop_id", "gtpv2.seq")]
    text = line(fields, frame__number=1, diameter__hopbyhopid="0x2", diameter__resultcode="5001", gtpv2__sequence_number="3")
    (row,) = parse(spark, [text], fields).collect()
    assert (row.diameter_hop_by_hop_id, row.diameter_result_code, row.gtpv2_seq_no) == ("0x2", "5001", "3")
    text = line(frame__number=1, **{"diameter__Result-Code": "1", "diameter__result_code": "2"}, gtpv2__seq="8", gtpv2__seq_no="9")
    (row,) = parse(spark, [text]).collect()
    assert (row.diameter_result_code, row.gtpv2_seq_no) == ("1", "8")


def test_read_index_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text(line(frame__number=1) + "\n\nbroken\n")
    (tmp_path / "two.cap.txt").write_text(line(frame__number=4) + "\n")
    good, bad = ix.read_index(spark, str(tmp_path))
    assert sorted((r.capture_id, r.frame_no) for r in good.collect()) == [("one", 1), ("two.cap", 4)]
    assert [(r.capture_id, r.line) for r in bad.collect()] == [("one", "broken")]


def test_top_protocol_fallbacks(spark):
    stacks = [["eth", "ip", "udp", "gtp"], ["eth", "ipv6"], ["eth", "arp"], ["ip", "tcp", "ssl"], ["ip", "sctp"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stacks)], "n int, protocols array<string>")
    got = {r.n: r.top_protocol for r in with_top_protocol(df, builtin_profiles()["lte-core"]).collect()}
    assert got == {0: "gtpv2", 1: "ip", 2: "unknown", 3: "tls", 4: "sctp"}


def diameter_rows(spark, items):
    data = [("c", n, flags, cmd, hbh, code) for n, (flags, cmd, hbh, code) in enumerate(items, start=1)]
    schema = "capture_id string, frame_no bigint, diameter_flags string, diameter_cmd_code string, diameter_hop_by_hop_id string, diameter_result_code string"
    return spark.createDataFrame(data, schema)


def texts(df):
    return [r.text for r in df.orderBy("section", "position").collect()]


def test_diameter_cases(spark):
    df = diameter_rows(spark, [
        ("0xc0", "316", "1", None), ("0x40", "316", "1", "2001"),      # matched
        ("192", "318", "2", None),                                      # unanswered, repeated below
        (None, "280", None, "3002"),                                    # no flags: an answer
        ("0xc0", "319", "2", None),                                     # duplicate id
        ("0x40", "316", "9", "5012"), ("0x40", "316", "9", "abc"), ("junk", "1", "7", None),
    ])
    assert texts(an.diameter_anomalies(df, 2)) == [
        "[diameter][warn] Result-Code 3002 (cmd=280) at packet 4",
        "[diameter][warn] Duplicate hop-by-hop ID 2 (cmd=319) at packet 5",
        "[diameter][error] Result-Code 5012 (cmd=316) at packet 6",
        "[diameter][warn] Unanswered request cmd=319 hop-by-hop=2 from packet 5",
    ]


def test_pending_requests_match_a_loop(spark):
    rng = random.Random(3)
    items = [(rng.choice(["0xc0", "0x40"]), "1", rng.choice("abcd"), None) for _ in range(300)]
    pending, duplicates = {}, []
    for n, (flags, _, hbh, _) in enumerate(items, start=1):
        if flags == "0xc0":
            if hbh in pending:
                duplicates.append(n)
            pending[hbh] = n
        else:
            pending.pop(hbh, None)
    df = diameter_rows(spark, items)
    linked = an.linked_diameter(an.diameter_messages(df), 16)
    assert [r.frame_no for r in an.duplicate_id_anomalies(linked).orderBy("frame_no").collect()] == duplicates
    assert [r.frame_no for r in an.unanswered_anomalies(linked).orderBy("position").collect()] == list(pending.values())


def test_gtp_cases_and_profile_gate(spark):
    data = [("c", 1, "32", "5", None), ("c", 2, "33", "5", "0x10"), ("c", 3, "32", "6", None), ("c", 4, "33", "8", "72"), ("c", 5, "26", None, None)]
    gtp = spark.createDataFrame(data, "capture_id string, frame_no bigint, gtpv2_message_type string, gtpv2_seq_no string, gtpv2_cause string")
    df = gtp.selectExpr("*", "false as tcp_retransmission", "true as tcp_out_of_order", *[
        f"cast(null as string) as diameter_{c}" for c in ("flags", "cmd_code", "hop_by_hop_id", "result_code")])
    assert texts(an.gtp_anomalies(df)) == [
        "[gtpv2][warn] Create Session rejected cause=72 at packet 4",
        "[gtpv2][error] Error Indication at packet 5",
        "[gtpv2][warn] Unanswered Create Session Request seq=6 from packet 3",
    ]
    assert an.all_anomalies(df, "5g-core").count() == 5
    assert an.all_anomalies(df, "").count() == 8
    assert texts(an.transport_anomalies(df))[0] == "Packet 1: out_of_order"


def test_selection_limits(spark):
    df = spark.createDataFrame([("c", i) for i in range(10)], "capture_id string, frame_no bigint")
    for limit, cut in ((9, True), (10, False), (11, False), (0, False)):
        (info,) = selection.selection_info(df, limit).collect()
        assert info.truncated is cut and (info.truncation_note is not None) is cut
    (cover,) = selection.coverage(df, selection.first_packets(df, 4)).collect()
    assert cover.truncation_note == "detail artifact contains 4 of 10 exported packets."
    assert selection.oversize(df, 2, 4).count() == 1 and selection.oversize(df, 2, 5).count() == 0 and selection.oversize(df, 2, 0).count() == 0


def test_top_conversations_ties(spark):
    data = [("c", n, "tcp", s, "z", "http") for n, s in enumerate(["b", "a", "a", "b", "c"], start=1)]
    df = spark.createDataFrame(data, "capture_id string, frame_no bigint, transport string, src_ip string, dst_ip string, top_protocol string")
    got = [(r.src, r.packet_count) for r in stats.top_conversations(stats.conversations(df), 2).orderBy("rank").collect()]
    assert got == [("b", 2), ("a", 2)]
